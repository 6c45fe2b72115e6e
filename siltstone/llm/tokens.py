"""Tokenizer files, and token counts of whole texts.

A tokenizer is named by the path of its file: ``.json`` is read by
``tokenizers``, ``.model`` by ``sentencepiece``. Files are never copied or
trained; each Python worker opens one once and keeps it.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import each, table

#: Texts go to the library in batches of about this many bytes of UTF-8; a text of
#: more than SPLIT_CHARS characters is cut at safe boundaries first.
BATCH_BYTES = 1 << 18
SPLIT_CHARS = 1 << 15

_OPEN: dict = {}


def opened(path: str):
    """The tokenizer in ``path``, opened once per process."""
    if path not in _OPEN:
        if path.endswith(".model"):
            import sentencepiece

            _OPEN[path] = sentencepiece.SentencePieceProcessor(model_file=path)
        elif path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _OPEN[path] = model
        else:
            raise ValueError(f"no library for {path}")
    return _OPEN[path]


_SAFE = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def safe_pieces(text: str, size: int = SPLIT_CHARS) -> list[str]:
    """Cut a text at spaces between two ASCII letters, about every ``size`` characters, dropping the space.

    A sentencepiece model writes a space as the mark that starts a word and puts
    one before each text, so the part after a dropped space is encoded as it was
    inside the text. This holds where no piece has the mark after another
    character (see ``can_split``), and beside letters: runs of spaces, and a literal
    mark beside a space, have pieces of their own. A text without such a space
    stays whole.
    """
    parts, start = [], 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if not cut:
            break
        parts.append(text[start : cut.start()])
        start = cut.end()
    return [*parts, text[start:]]


def can_split(model) -> bool:
    """Whether pieces of this sentencepiece model never reach over the start of a word."""
    mark = "▁"
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    starts = [len(x) for x in model.encode(["a", " a"])]
    return not any(mark in p.lstrip(mark) for p in pieces) and starts == [1, 2]


def lengths(path: str, texts: list[str]) -> list[int]:
    """Tokens of each text, without begin, end or added special tokens."""
    model = opened(path)
    if path.endswith(".json"):
        return [len(e) for part in _balanced(texts) for e in model.encode_batch_fast(part, add_special_tokens=False)]
    if ("split", path) not in _OPEN:
        _OPEN["split", path] = can_split(model)
    parts = [safe_pieces(t) if _OPEN["split", path] and len(t) > SPLIT_CHARS else [t] for t in texts]
    counts = iter([len(ids) for part in _balanced([p for one in parts for p in one]) for ids in model.encode(part, num_threads=1)])
    return [sum(next(counts) for _ in one) for one in parts]


def _bytes(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8"))


def _balanced(texts: Iterable[str], size: int | None = None) -> Iterator[list[str]]:
    """Batches of about ``size`` bytes (BATCH_BYTES by default), in order."""
    size = size or BATCH_BYTES
    batch, held = [], 0
    for t in texts:
        batch.append(t)
        held += _bytes(t)
        if held >= size:
            yield batch
            batch, held = [], 0
    if batch:
        yield batch


def token_counts(docs: DataFrame, path: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_tokens, over_limit``.

    Whole texts are encoded and only lengths leave the Python worker. A null text
    is an empty one, with no token; ids may be null or repeat, each row is counted
    by itself. Other columns are ignored, an empty table gives an empty one. No shuffle.
    """

    text = F.coalesce(F.col(text_col), F.lit(""))

    @F.arrow_udf("long")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield pa.array([n for part in _balanced(each(texts), 16 * BATCH_BYTES) for n in lengths(path, part)], pa.int64())

    out = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), count(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


#: Letters, in UTF-8, that Unicode composition leaves alone and that lower-case to one
#: letter each: A-Z, a-z, and U+00C0 to U+017F without the two signs and the dotted capital I.
_LETTER = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbf])"
_LETTERS = re.compile(_LETTER + rb"+")
_LAST_LETTER = re.compile(_LETTER + rb"\Z")
_MARKS = b".,;:!?*$%#&)]\"|"
#: Where a text has none of these, nothing in it composes with an ASCII letter.
_COMPOSING = re.compile("[^\0-\u02ff]")


class WordIds:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes, encoding each distinct word once.

    Holds for tokenizers that drop white space and never join text across it (see
    ``splits_at_white_space``): a text's ids are those of its words, the stretches
    between ASCII white space, one after another. Words go to the library as they
    stand, so added tokens, composed characters and case are its own affair. Three
    things are known to change nothing and save calls: a text without ``<|`` and
    without characters that compose may be lower-cased (A-Z) first; ASCII marks
    after a plain letter are looked up apart; and words of plain letters, which end
    with their only end-of-word token, are encoded many at a time and parted by it.

    About ``LIMIT`` words are kept from one batch to the next. Beyond it only those
    stay that the batch at hand has met again.
    """

    LIMIT = 300_000
    GROUP = 64

    def __init__(self, path: str):
        self.model = opened(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.model.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def batch(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text."""
        for part in _balanced(texts, 8 * BATCH_BYTES):
            split = [self._words(t) for t in part]
            own = set().union(*split)
            new = own.difference(self.known)
            if len(self.known) + len(new) > self.LIMIT:
                self.known = {w: self.known[w] for w in own.difference(new)}
            self._learn(new)
            for words in split:
                yield b"".join(map(self.known.__getitem__, words))

    @staticmethod
    def _words(text: str) -> list[bytes]:
        raw = text.encode("utf-8")
        return (raw if "<|" in text or not text.isascii() and _COMPOSING.search(text) else raw.lower()).split()

    def _learn(self, new: set[bytes]) -> None:
        known, parted, stems = self.known, [], set()
        several = [w for w in new if w.isalpha()]
        for word in new.difference(several):
            stem = word.rstrip(_MARKS)
            if len(stem) < len(word) and _LAST_LETTER.search(stem) and b"<|" not in word:
                marks = word[len(stem) :]
                parted.append((word, stem, marks))
                stems.add(stem)
                stems.add(marks)
            else:
                stems.add(word)
        single = []
        for word in stems.difference(known, several):
            (several if word.isalpha() or _LETTERS.fullmatch(word) else single).append(word)
        groups = [several[at : at + self.GROUP] for at in range(0, len(several), self.GROUP)]
        for words, raw in zip(groups, self._ids([b" ".join(words) for words in groups]), strict=True):
            cuts = [0, *(4 * np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 4).tolist()]
            if len(cuts) == len(words) + 1 and cuts[-1] == len(raw):
                known.update((w, raw[a:b]) for w, a, b in zip(words, cuts[:-1], cuts[1:], strict=True))
            else:
                single += words
        known.update(zip(single, self._ids(single), strict=True))
        for word, stem, marks in parted:
            known[word] = known[stem] + known[marks]

    def _ids(self, texts: list[bytes]) -> Iterator[bytes]:
        for at in range(0, len(texts), self.GROUP):
            for e in self.model.encode_batch_fast([x.decode("utf-8") for x in texts[at : at + self.GROUP]], add_special_tokens=False):
                yield array("I", e.ids).tobytes()


def splits_at_white_space(path: str) -> bool:
    """Whether ``WordIds`` holds for this tokenizer, from its own description."""
    import json

    told = json.loads(opened(path).to_str())
    steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or []
    first = steps[0] if steps else {}
    norms = [n["type"] for n in ((told.get("normalizer") or {}).get("normalizers") or [])]
    added = told.get("added_tokens", [])
    plain = [t for t in added if t["content"].startswith("<|") and t["content"].endswith("|>") and " " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"])]
    return bool(added) and plain == added and "Lowercase" in norms and set(norms) <= {"NFC", "Replace", "Lowercase"} and first.get("type") == "Split" and first.get("invert") is True and r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") and told["model"].get("end_of_word_suffix") == "</w>"


def encoder(path: str):
    """A function from texts to their ids as little-endian unsigned 32-bit bytes; what it keeps goes with it."""
    model = opened(path)
    if path.endswith(".json") and splits_at_white_space(path):
        return WordIds(path).batch
    if path.endswith(".json"):
        return lambda texts: (array("I", e.ids).tobytes() for part in _balanced(texts) for e in model.encode_batch(part, add_special_tokens=False))
    return lambda texts: (array("I", ids).tobytes() for part in _balanced(texts) for ids in model.encode(part, num_threads=1))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)
