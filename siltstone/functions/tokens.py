"""Token counts by a model's own vocabulary."""

from __future__ import annotations

import base64


class BpeCounter:
    """Counts tokens by a byte-pair vocabulary in a tiktoken rank file; sent to tasks by its path, opened on first use."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern, self._encoding = path, pattern, None

    def __getstate__(self):
        return {"path": self.path, "pattern": self.pattern, "_encoding": None}

    def __call__(self, text: str) -> int:
        if self._encoding is None:
            import tiktoken

            with open(self.path, "rb") as rows:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rows)}
            self._encoding = tiktoken.Encoding("own", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return len(self._encoding.encode_ordinary(text))
