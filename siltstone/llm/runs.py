"""Periodic runs of words, by a suffix automaton with link-cut access.

The suffix links of a text's automaton are a tree; the suffixes that end at a word
are the path from that word's state to the root. Words are appended in order, and
each append accesses its path, as in a link-cut tree: preferred paths are splay
trees, and all nodes of one were last met at the same end, its colour. The access
passes the old colours from the deepest node up; where a segment's colour ``e`` and
deepest length ``L`` have ``i - e <= L``, the ``L`` words up to ``i`` stand ``i - e``
words earlier too, which is a square of that period. Squares are extended to both
sides to runs, once for each run. Accesses take O(n log n) steps in all.

Every word of a run of four periods stands in it four times, every pair of neighbours
three times. So texts are first cut between the words for which that cannot hold,
again and again in what is left; stretches that are left over hold all runs. This
takes nothing away but the time for plain prose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import by_position, table

#: A run has this many periods at least, and this many words.
EXPONENT, LEAST = 4, 6
#: Times that stretches are cut: more only save time.
ROUNDS = 6
WHITE = r"[ \t-\r]+"
#: Bytes of text after which an output batch is full.
OUTPUT_BYTES = 4 << 20


class Automaton:
    """The suffix automaton of a list of words: ``length`` and ``link`` of each state from 1 on, ``ends`` of the prefixes."""

    def __init__(self, words: list[int]):
        following: list[dict[int, int]] = [{}, {}]
        self.length, self.link, self.ends = length, link, ends = [0, 0], [0, 0], []
        last = 1
        for word in words:
            new = len(length)
            length.append(length[last] + 1)
            following.append({})
            p = last
            while p and word not in following[p]:
                following[p][word] = new
                p = link[p]
            if not p:
                link.append(1)
            else:
                q = following[p][word]
                if length[q] == length[p] + 1:
                    link.append(q)
                else:
                    clone = new + 1
                    link.append(clone)
                    length.append(length[p] + 1)
                    link.append(link[q])
                    following.append(following[q].copy())
                    link[q] = clone
                    while p and following[p].get(word) == q:
                        following[p][word] = clone
                        p = link[p]
            ends.append(last := new)


def repeats(automaton: Automaton) -> Iterator[tuple[int, int, int]]:
    """``(i, d, length)``: the ``length >= d`` words up to word ``i`` also stand ``d`` words earlier, and no nearer."""
    length = automaton.length
    up = automaton.link[:]  # parent in the splay tree, or at its root the node that the path hangs from
    low, high = [0] * len(up), [0] * len(up)  # children: shallower and deeper nodes
    colour = [-1] * len(up)  # of a path, at its splay root
    for i, state in enumerate(automaton.ends):
        x, below = state, 0
        while x:
            # Splay x to the root of its path.
            while (p := up[x]) and (low[p] == x or high[p] == x):
                g = up[p]
                inner = g and (low[g] == p or high[g] == p)
                if inner and (low[g] == p) == (low[p] == x):
                    turns = ((p, g), (x, p))
                elif inner:
                    turns = ((x, p), (x, g))
                else:
                    turns = ((x, p),)
                    colour[x] = colour[p]
                for a, b in turns:
                    above = up[b]
                    if above:
                        if low[above] == b:
                            low[above] = a
                        elif high[above] == b:
                            high[above] = a
                        else:
                            colour[a] = colour[b]  # b was the root
                    else:
                        colour[a] = colour[b]
                    if low[b] == a:
                        low[b] = c = high[a]
                        high[a] = b
                    else:
                        high[b] = c = low[a]
                        low[a] = b
                    if c:
                        up[c] = b
                    up[b], up[a] = a, above
            e = colour[x]
            if e >= 0 and i - e <= length[x]:
                yield i, i - e, length[x]
            if high[x]:
                colour[high[x]] = e  # deeper nodes keep their colour, as a path of their own
            high[x] = below
            below, x = x, up[x]
        colour[below] = i


def primitive(words: list[int], start: int, period: int) -> bool:
    """Whether a run's period is its smallest: no proper divisor is one of a whole period."""
    for divisor in range(1, period // 2 + 1):
        if period % divisor == 0 and words[start : start + period - divisor] == words[start + divisor : start + period]:
            return False
    return True


def runs_in(words: list[int]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of the runs of a stretch."""
    n, known, out = len(words), {}, []
    for i, d, size in repeats(Automaton(words)):
        if i < known.get(d, 0):
            continue
        start, end = i - size - d + 1, i + 1
        while start and words[start - 1] == words[start - 1 + d]:
            start -= 1
        while end < n and words[end] == words[end - d]:
            end += 1
        known[d] = end
        if end - start >= max(LEAST, EXPONENT * d) and primitive(words, start, d):
            out.append((start, end - start, d))
    return out


def stretches(words: np.ndarray) -> list[tuple[int, int]]:
    """The ranges of words that can hold runs; no run reaches out of one."""
    at, part = np.arange(len(words)), np.zeros(len(words), np.int64)
    n_words = int(words.max()) + 1 if len(words) else 0
    for _ in range(ROUNDS):
        before = len(at), part[-1:].tolist()
        for least, pairs in ((EXPONENT, False), (EXPONENT - 1, True)):
            if len(at) < LEAST:
                return []
            own = words[at]
            if pairs:
                # A pair reaches from a word to the next one of its stretch; what follows a rare one is another stretch.
                follows = np.append((at[1:] == at[:-1] + 1) & (part[1:] == part[:-1]), False)
                code = own * n_words + np.append(own[1:], 0)
                _, inverse = np.unique(code, return_inverse=True)
                rare = ~follows
                ix = np.flatnonzero(follows)
                rare[ix] = _counts(inverse[ix], part[ix]) < least
                part = np.cumsum(np.append(True, rare[:-1]))
            else:
                keep = _counts(own, part) >= least
                # Where a word goes, its stretch is parted.
                part = part + np.cumsum(~keep) if not keep.all() else part
                at, part = at[keep], part[keep]
            if len(at):
                # Stretches that are too short go.
                edge = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)))
                sizes = np.diff(np.append(edge, len(at)))
                part = np.repeat(np.arange(len(edge)), sizes)
                keep = np.repeat(sizes >= LEAST, sizes)
                at, part = at[keep], part[keep]
        if (len(at), part[-1:].tolist()) == before:
            break
    if not len(at):
        return []
    edge = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return [(int(at[a]), int(at[b - 1]) + 1) for a, b in zip(edge, [*edge[1:], len(at)], strict=True)]


def _counts(words: np.ndarray, part: np.ndarray) -> np.ndarray:
    """How often each word stands in its part."""
    if not len(words):
        return np.zeros(0, int)
    _, inverse, counts = np.unique(part * (int(words.max()) + 1) + words, return_inverse=True, return_counts=True)
    return counts[inverse]


def runs_of(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of all runs of a text, by start, then period."""
    if len(words) < LEAST:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    found = [(a + start, size, period) for a, b in stretches(ids) for start, size, period in runs_in(ids[a:b].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that only repeat: of each run its first period stays, unless another run has it."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, size, period in runs:
        gone[start + period] += 1
        gone[start + size] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def with_runs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (``start, length, period`` in words, by start, then period) and ``collapsed``.

    ``collapsed`` is the text's words, joined by one space, without those that a run
    holds after its first period. Words are what ASCII white space parts. Every row and
    column stays; columns called ``runs`` or ``collapsed`` are replaced. A null text has
    no words: no runs and an empty collapsed text; so has an empty one. Repeated rows
    and null ids are rows like others, an empty table gives an empty one. Very long
    texts are read whole; memory follows the longest stretch of repeated words. No shuffle.
    """
    own, names = by_position(docs, "runs", "collapsed")
    text = own.columns[names.index(text_col)]
    out_schema = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    @F.arrow_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            pieces, rows, size = [], [], 0
            for k in range(len(texts)):
                words = (texts[k].as_py() or b"").split()
                runs = runs_of(words)
                short = b" ".join(collapsed(words, runs))
                rows.append({"runs": [{"start": s, "length": n, "period": p} for s, n, p in runs], "collapsed": short.decode()})
                size += len(short)
                if size > OUTPUT_BYTES:  # so that a batch is never a list of Python strings as a whole
                    pieces.append(pa.array(rows, out_schema))
                    rows, size = [], 0
            yield pa.concat_arrays([*pieces, pa.array(rows, out_schema)])

    out = own.withColumn("found", found(F.col(text).cast("binary")))
    return out.select(*[F.col(c).alias(name) for c, name in zip(own.columns, names, strict=True)], "found.runs", "found.collapsed")


def damaged(text: Column, key: Column) -> Column:
    """Texts whose ``crc32(key)`` ends in 0 repeat a part of themselves to their end; the rest, and those of null keys, stay."""
    words = F.filter(F.split(text, WHITE), lambda w: w != "")
    n, h = F.size(words).cast("long"), F.crc32(key.cast("string"))
    g = F.floor(h / 10).cast("long")
    a = g % n
    p = F.floor((n - a) / (g % 8 + 3)).cast("long") + 1
    part = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(part, (F.floor((n - a) / p) + 1).cast("int"))), F.lit(1), (n - a).cast("int"))
    whole = F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")
    return F.when((h % 10 == 0) & F.coalesce(n > 0, F.lit(False)), whole).otherwise(text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", damaged(F.col("text"), F.col("doc_id")).alias("text"))
    out = with_runs(docs).select("doc_id", "runs", F.sha2("collapsed", 256).alias("collapsed_sha256"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))), "")
    # Runs are in order, so the first of equal ones stays.
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), "collapsed_sha256")
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
