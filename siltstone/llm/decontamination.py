"""Benchmark decontamination: an FM-index per training shard, searched for test phrases.

Words are the maximal runs of characters other than ASCII marks and white space,
with A-Z lower-cased. A benchmark item's phrases are its windows of ``window``
words; an item of fewer words, but not none, is one phrase.

Each Spark task reads its rows as shards of about ``SHARD_WORDS`` words; a text that
is longer is indexed in parts that overlap by a phrase. A shard's index is over all
its words, numbered in the shard, with a mark after each text. Phrases whose words
all occur in the shard are found by backward search, placed by sampled suffix
positions, and their spans are merged per document. Nothing is shuffled: the
benchmark goes to the tasks in parts of at most ``PART_WORDS`` words, one pass over
the documents for each part, and a part is dropped before the next one is sent.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.llm.common import by_position, drop_stored, so_far, stored, table
from siltstone.llm.fmindex import FMIndex

WINDOW = 10
SHARD_WORDS = 1 << 18
#: Benchmark words that one pass sends to the tasks: the bound of what is broadcast.
PART_WORDS = 2_000_000

#: Every byte that ends a word is a space; A-Z are lower-cased. Bytes of 0x80 and
#: above belong to characters outside ASCII, which are all parts of words.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").translate(_BYTES).split()


class Phrases:
    """The phrases of some benchmark items as integer rows, by length."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(item)
        self.by_length: dict[int, tuple[np.ndarray, list[set]]] = {}
        for size in {len(p) for p in found}:
            own = [p for p in found if len(p) == size]
            self.by_length[size] = np.array(own, np.int64), [found[p] for p in own]
        self.longest = max(self.by_length, default=0)

    def found_in(self, code: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """By phrase length: phrases (row numbers) and where they begin in ``code``, for each occurrence.

        ``numbers`` has for each word of the benchmark its number in ``code``, 0 for those that do not occur.
        """
        if not numbers.any():
            return
        index = FMIndex(code)
        for size, (rows, _) in self.by_length.items():
            there = np.flatnonzero(numbers[rows].all(axis=1))
            low, high = index.ranges(numbers[rows[there]])
            hits = np.flatnonzero(high > low)
            if len(hits):
                n = high[hits] - low[hits]
                suffixes = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[hits], n)
                yield size, np.repeat(there[hits], n), index.locate(suffixes)


def search(texts: list[str | None], phrases: Phrases, part: int = 2 * SHARD_WORDS) -> list[tuple[int, list[tuple[int, int]], list]]:
    """For each text of a shard: number of words, merged hit spans (in words), items found."""
    known: dict[bytes, int] = {}
    ids, firsts = [], [0]
    for text in texts:
        for w in words_of(text):
            ids.append(known.setdefault(w, len(known) + 2))
        ids.append(1)  # the mark after a text
        firsts.append(len(ids))
    code = np.array(ids, np.int64)
    numbers = np.zeros(max(1, len(phrases.vocabulary)), np.int64)
    for w, k in known.items():
        own = phrases.vocabulary.get(w)
        if own is not None:
            numbers[own] = k
    marks = np.zeros(len(code) + 1, np.int64)
    items: list[set] = [set() for _ in texts]
    for at in range(0, len(code), part):
        for size, rows, begins in phrases.found_in(code[at : at + part + phrases.longest - 1], numbers):
            begins += at
            np.add.at(marks, begins, 1)
            np.add.at(marks, begins + size, -1)
            docs = np.searchsorted(firsts, begins, side="right") - 1
            names = phrases.by_length[size][1]
            for doc, phrase in {*zip(docs.tolist(), rows.tolist(), strict=True)}:
                items[doc] |= names[phrase]
    covered = np.cumsum(marks[:-1]) > 0
    out = []
    for k in range(len(texts)):
        own = covered[firsts[k] : firsts[k + 1] - 1]
        spans = np.flatnonzero(np.diff(np.concatenate(([False], own, [False])).astype(np.int8))) if items[k] else []
        out.append((len(own), [(int(a), int(b)) for a, b in zip(spans[::2], spans[1::2], strict=True)], sorted(items[k], key=str)))
    return out


def _shards(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, list]]:
    """Rows of a task in shards of about SHARD_WORDS words (by characters, six a word); texts stay whole."""
    rows, texts, size = [], [], 0
    for batch in batches:
        first = 0
        for k in range(batch.num_rows):
            text = batch.column(column)[k].as_py()
            texts.append(text)
            size += len(text or "")
            if size >= 6 * SHARD_WORDS:
                yield pa.Table.from_batches([*rows, batch.slice(first, k + 1 - first)]), texts
                rows, texts, size, first = [], [], 0, k + 1
        if first < batch.num_rows:
            rows.append(batch.slice(first))
    if texts:
        yield pa.Table.from_batches(rows), texts


_SPANS = "array<struct<begin: bigint, end: bigint>>"


def _one_pass(docs: DataFrame, items: list[tuple], item_kind: T.DataType, window: int, text_at: int, cut_texts: bool) -> DataFrame:
    """``docs`` with ``n`` (words), ``spans`` and ``items`` of one part of the benchmark; the hit spans cut, if asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(items)
    pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    names = pa.list_(to_arrow_type(item_kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(sent.value, window)
        for shard, texts in _shards(batches, text_at):
            found = search(texts, phrases)
            if cut_texts:
                texts = [cut(t, s) if s else t for t, (_, s, _) in zip(texts, found, strict=True)]
                shard = shard.set_column(text_at, shard.schema.names[text_at], pa.array(texts, shard.schema.types[text_at]))
            shard = shard.append_column("n", pa.array([n for n, _, _ in found], pa.int64()))
            shard = shard.append_column("spans", pa.array([[{"begin": a, "end": b} for a, b in s] for _, s, _ in found], pairs))
            shard = shard.append_column("items", pa.array([i for _, _, i in found], names))
            yield from shard.to_batches()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n", T.LongType()), T.StructField("spans", T._parse_datatype_string(_SPANS)), T.StructField("items", T.ArrayType(item_kind))]))


def _spans(docs: DataFrame, benchmark: DataFrame, window: int, part_words: int, text: str, cut_texts: bool = False) -> DataFrame:
    """``docs`` (columns called ``c0``, ``c1`` ...) with ``n`` (words), ``spans`` and ``items``."""
    spark = docs.sparkSession
    item_kind = benchmark.schema["item_id"].dataType
    bench = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    size = bench.agg(F.sum(F.size(F.split("text", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")))).first()[0] or 0
    parts = max(1, -(-size // part_words))
    if parts == 1:
        return _one_pass(docs, [tuple(r) for r in bench.collect()], item_kind, window, docs.columns.index(text), cut_texts)
    # Rows are numbered once and stored, so what the passes find can be put together again. Each pass
    # is stored before the next part of the benchmark is read, so driver and tasks hold one part at a time.
    begin = so_far()
    numbered = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    passes = []
    for part in range(parts):
        own = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
        passes.append(stored(_one_pass(numbered.select("row", text), [tuple(r) for r in own.collect()], item_kind, window, 1, False).drop(text), "pass"))
    by_name = lambda a, b: F.when(a.cast("string") < b.cast("string"), -1).otherwise(1)
    whole = reduce(DataFrame.union, passes).groupBy("row").agg(F.max("n").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items"))), by_name).alias("items"))
    last = lambda acc: F.element_at(acc, -1)
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast(_SPANS),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (last(acc)["end"] >= s["begin"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["begin"].alias("begin"), F.greatest(last(acc)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(acc, F.array(s))),
    )
    # Stored: what this read is deleted, and the cut is a step of its own.
    out = stored(numbered.join(whole.withColumn("spans", merged), "row").drop("row"), "spans")
    drop_stored(spark, begin, 1)
    if not cut_texts:
        return out

    @F.pandas_udf("string")
    def cuts(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(s) else cut(t, [(x["begin"], x["end"]) for x in s]) for t, s in zip(texts, spans, strict=True)], dtype=object)

    return out.withColumn(text, F.when(F.size("spans") > 0, cuts(F.col(text), F.col("spans"))).otherwise(F.col(text)))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_hit, spans, items, contaminated``.

    ``spans`` are the merged hit spans as ``(begin, end)`` in words, ``items`` the
    ids of items with an occurring phrase, of any type, sorted as strings. A null
    text has no words; null item ids are left out, an item with a null text has no
    phrase. Repeated rows are each reported, a null id stays null, other columns are
    ignored. Very long texts are searched whole. An empty table gives an empty one,
    an empty benchmark contaminates nothing.
    """
    found = _spans(docs.select(F.col(id_col).alias("c0"), F.col(text_col).alias("c1")), benchmark, window, part_words, "c1")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    return found.select(F.col("c0").alias("doc_id"), F.col("n").alias("n_words"), hit.alias("n_hit"), "spans", "items").withColumn("contaminated", F.col("n_hit") > 0)


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what stands between them; a space marks each cut."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for begin, end in spans:
        out.append(text[at : places[begin][0]])
        at = places[end - 1][1]
    return " ".join([*out, text[at:]]).strip()


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS, text_col: str = "text", count_col: str = "words_cut") -> DataFrame:
    """``docs`` with hit spans cut from ``text_col``, and how many words that were (``count_col``).

    Every row and every other column stays, whatever its name (``count_col``
    replaces a column of that name), rows with a null id and repeated ones too; texts
    without a hit, null and empty texts are returned as they are. Very long texts are
    searched and cut whole. An empty table gives an empty one; an empty benchmark
    cuts nothing.
    """
    own, names = by_position(docs, count_col.lower())
    found = _spans(own, benchmark, window, part_words, own.columns[names.index(text_col)], cut_texts=True)
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["begin"])
    return found.select(*[F.col(c).alias(name) for c, name in zip(own.columns, names, strict=True)], lost.alias(count_col))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_join(F.transform("items", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated")


def digest(items: list) -> str:
    """What ``items_sha256`` holds for these items; for tests."""
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
