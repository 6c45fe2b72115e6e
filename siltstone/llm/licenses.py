"""Licence scans: word-bigram Dice coefficients against templates.

A text's blocks are its lines, its paragraphs (parted by blank lines) and the whole,
and the windows of each template's size that begin, anywhere in the text, with the
template's first bigram: so a statement inside a longer line and a licence after a
file's first words are blocks too. Blocks and templates are normalised: A-Z
lower-cased, anything but letters, digits and characters outside ASCII made single
spaces. The Dice coefficient is over bigrams with their repeats, so the sizes it can
bridge follow from word counts alone: a block of ``a`` bigrams can reach ``t`` only
with templates of ``a t / (2 - t)`` to ``a (2 - t) / t`` bigrams, and others are
skipped before any bigram is made. Of the templates that match a block only the
best counts (ties: the first by name), so a notice of one version of a licence is
not taken for another.

The templates are whole licence texts (``templates/*.txt`` and below), the notices
that the licences tell to put into files, and one-line statements: what every task
holds is bounded. Parts of a licence are no templates, as licences share them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import each, table

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org/>"""

_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""

_BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""

_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def _gnu(kind: str, version: str, subject: str = "program") -> str:
    """The notice that the GNU licences tell to put into files."""
    return f"""This {subject} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.

This {subject} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} for more details."""


#: Public licence texts, file notices, and one-line statements of a licence.
TEMPLATES = [
    ("MIT", _MIT),
    ("ISC", _ISC),
    ("Zlib", _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSD-2-Clause", f"{_BSD_TERMS}\n\n{_BSD_DISCLAIMER}"),
    ("BSD-3-Clause", f"{_BSD_TERMS}\n\n{_BSD_NAMES}\n\n{_BSD_DISCLAIMER}"),
    *[(name, (files(__package__) / "templates" / f"{name}.txt").read_text("utf-8")) for name in ("Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")],
    ("Apache-2.0", _APACHE),
    ("MPL-2.0", _MPL),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3", "library")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
]

_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n")


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_BYTES).split()


def parts_of(templates) -> list[tuple[str, str]]:
    """Each template once, normalised."""
    return sorted({(name, " ".join(w.decode("utf-8") for w in normalised(text))) for name, text in templates})


class Templates:
    """Templates by size."""

    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD):
        self.threshold = threshold
        rows = []
        for name, part in parts_of(templates):
            words = part.encode("utf-8").split()
            if len(words) > 1:
                rows.append((len(words) - 1, name, Counter(zip(words, words[1:], strict=False)), tuple(words[:2])))
        rows.sort(key=lambda r: r[:2])
        self.sizes = [r[0] for r in rows]
        self.rows = rows
        self.known = {gram for _, _, grams, _ in rows for gram in grams}
        self.starts: dict[tuple, list] = {}
        for row in rows:
            self.starts.setdefault(row[3], []).append(row)

    def best(self, words: list[bytes], rows: list | None = None) -> tuple[str, float] | None:
        """The licence whose template has the highest Dice coefficient with a block, if that is at least the threshold."""
        size, t = len(words) - 1, self.threshold
        if rows is None:
            low, high = bisect_left(self.sizes, size * t / (2 - t) - 1e-9), bisect_right(self.sizes, size * (2 - t) / t + 1e-9)
            rows = self.rows[low:high]
        if size < 1 or not rows or self.known.isdisjoint(zip(words, words[1:], strict=False)):
            return None
        own = Counter(zip(words, words[1:], strict=False))
        found = [(2.0 * sum(min(c, own[g]) for g, c in grams.items() if g in own) / (n + size), name) for n, name, grams, _ in rows]
        dice = max(d for d, _ in found)
        return (min(name for d, name in found if d == dice), dice) if dice >= t else None

    def windows(self, words: list[bytes]) -> Iterator[tuple[str, float]]:
        """The best licence of the windows at each place where a template's first bigram stands."""
        shares: dict[int, np.ndarray] = {}

        def enough(row: tuple, at: int) -> bool:
            """Whether the window has so many of a long template's bigrams that it can reach the threshold."""
            n, _, grams, _ = row
            if n < 64:
                return True
            if id(row) not in shares:
                shares[id(row)] = np.concatenate(([0], np.cumsum(np.fromiter((g in grams for g in zip(words, words[1:], strict=False)), bool, len(words) - 1))))
            return shares[id(row)][at + n] - shares[id(row)][at] >= self.threshold * n

        for at, gram in enumerate(zip(words, words[1:], strict=False)):
            if gram in self.starts:
                rows = [r for r in self.starts[gram] if at + r[0] < len(words) and enough(r, at)]
                found = [hit for r in rows if (hit := self.best(words[at : at + r[0] + 1], [r]))]
                if found:
                    dice = max(d for _, d in found)
                    yield min(name for name, d in found if d == dice), dice


def scan(text: str | None, templates: Templates) -> list[tuple[str, float]]:
    """``(licence, best coefficient)`` over all blocks of a text, by name."""
    best: dict[str, float] = {}
    blocks = {text or "", *_PARAGRAPH.split(text or ""), *(text or "").split("\n")}
    hits = [hit for block in blocks if (hit := templates.best(normalised(block)))]
    for name, dice in [*hits, *templates.windows(normalised(text or ""))]:
        best[name] = max(best.get(name, 0.0), dice)
    return sorted(best.items())


def licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, licenses``, an array of ``(name, dice)`` by name.

    A null or empty text has none. Repeated rows and null ids are scanned each for
    itself; very long texts are scanned whole; other columns are ignored; an empty
    table gives an empty one. Ties between licences go to the first by name. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = pa.list_(pa.struct([("name", pa.string()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(templates, threshold)
        for batch in batches:
            rows = [[{"name": n, "dice": d} for n, d in scan(t, own)] for t in each(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, found)], ["doc_id", "licenses"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, licenses array<struct<name: string, dice: double>>")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_licenses"), F.array_join("licenses.name", ",").alias("licenses"), F.round(F.coalesce(F.array_max("licenses.dice"), F.lit(0.0)), 9).alias("best_dice"))


def _template_values() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quoted(n)}, {quoted(p)})" for i, (n, p) in enumerate(parts_of(TEMPLATES)))


_NORMAL = "trim(regexp_replace(lower({0}), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+', ' ', 'g'))"

#: ``lower`` also changes letters outside ASCII, but no template holds one, so no bigram with one ever matches.
ORACLE_SQL = f"""
WITH templates(t, name, body) AS (VALUES {_template_values()}),
tw AS (SELECT t, name, string_split(body, ' ') AS w FROM templates),
tn AS (SELECT *, len(w) - 1 AS n FROM tw WHERE len(w) > 1),
tg AS (SELECT t, name, n, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS gram FROM tn),
tc AS (SELECT t, name, n, gram, count(*) AS c FROM tg GROUP BY ALL),
blocks AS (
  SELECT DISTINCT doc_id, block FROM (
    SELECT doc_id, coalesce(text, '') AS block FROM documents
    UNION ALL SELECT doc_id, unnest(string_split(text, chr(10))) FROM documents
    UNION ALL SELECT doc_id, unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) FROM documents)),
bw AS (SELECT row_number() OVER () AS b, doc_id, string_split({_NORMAL.format("block")}, ' ') AS w FROM blocks),
sized AS (SELECT b, doc_id, w, len(w) - 1 AS n FROM bw WHERE len(w) > 1),
bg AS (SELECT b, doc_id, n, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS gram FROM sized),
bc AS (SELECT b, doc_id, n, gram, count(*) AS c FROM bg WHERE gram IN (SELECT gram FROM tc) GROUP BY ALL),
dice AS (
  SELECT bc.doc_id, bc.b AS place, tc.name, tc.t, 2.0::DOUBLE * sum(least(bc.c, tc.c)) / (any_value(bc.n) + any_value(tc.n)) AS d
  FROM bc JOIN tc USING (gram) GROUP BY bc.doc_id, bc.b, tc.name, tc.t),
dw AS (SELECT row_number() OVER () AS x, doc_id, string_split({_NORMAL.format("text")}, ' ') AS w FROM documents WHERE text IS NOT NULL),
places AS (SELECT x, doc_id, unnest(range(1, len(w))) AS p, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS gram FROM dw),
opened AS (SELECT p.x, p.doc_id, p.p, tn.t, tn.name, tn.n FROM places p JOIN tn ON p.gram = tn.w[1] || ' ' || tn.w[2] JOIN dw ON dw.x = p.x WHERE p.p + tn.n <= len(dw.w)),
inside AS (SELECT o.x, o.doc_id, o.p, o.t, o.name, o.n, q.gram, count(*) AS c FROM opened o JOIN places q ON q.x = o.x AND q.p >= o.p AND q.p < o.p + o.n GROUP BY ALL),
wdice AS (SELECT doc_id, x, p, i.name, i.t, 2.0::DOUBLE * sum(least(i.c, tc.c)) / (2 * any_value(i.n)) AS d FROM inside i JOIN tc ON tc.t = i.t AND tc.gram = i.gram GROUP BY ALL),
hits AS (
  SELECT doc_id, name, d FROM dice WHERE d >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY place ORDER BY d DESC, name) = 1
  UNION ALL SELECT doc_id, name, d FROM wdice WHERE d >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY x, p ORDER BY d DESC, name) = 1),
best AS (SELECT doc_id, name, max(d) AS d FROM hits GROUP BY doc_id, name)
SELECT d.doc_id, count(best.name)::BIGINT AS n_licenses, coalesce(string_agg(best.name, ',' ORDER BY best.name), '') AS licenses, round(coalesce(max(best.d), 0.0), 9) AS best_dice
FROM documents d LEFT JOIN best USING (doc_id) GROUP BY d.doc_id
"""
