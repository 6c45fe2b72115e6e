"""Filters of each query: which of a table's distinct filters each chunk meets, as a bit set.

Queries come in tables, and many share a filter. The distinct filters of a table are
numbered; each chunk gets a bit for every filter that it meets, before either arm of a
search cuts anything, and a query sees the chunks that have its filter's bit.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fields that list the values of a document's column; ``status`` may be empty, and is then met by nothing.
LISTS = ("status", "doc_type", "repo", "owner", "system", "authority", "sensitivity")
#: Fields that share a value with an array column: controls of a document, tags of a chunk or its document.
OVERLAPS = {"control_id": "controls", "tags": "tags"}
FIELDS = (*LISTS, *OVERLAPS, "path_prefix", "last_reviewed_after")
#: Distinct filters that a chunk's bit set holds at most; a table with more is searched in parts.
MOST = 4096


def numbered(queries: DataFrame, most: int = MOST) -> list[tuple[DataFrame, list[dict]]]:
    """``(queries with their filter's number, filters)`` in parts of ``most`` distinct filters.

    Filter fields are the columns of ``FIELDS`` that there are; the rest of a query's
    columns stay. A null field is no constraint, an empty list neither, but for
    ``status``, where it is met by nothing.
    """
    fields = [c for c in FIELDS if c in queries.columns]
    spark = queries.sparkSession
    key = F.to_json(F.struct(*[F.col(c) for c in fields]), {"ignoreNullFields": "false"})
    keyed = queries.withColumn("_key", key)
    distinct = keyed.select("_key", *fields).dropDuplicates(["_key"]).orderBy("_key")
    parts, own = [], []

    def part(rows: list) -> tuple[DataFrame, list[dict]]:
        names = spark.createDataFrame([(r["_key"], k) for k, r in enumerate(rows)], "_key string, filter int")
        return keyed.join(names, "_key").drop("_key", *fields), [{c: r[c] for c in fields} for r in rows]

    for row in distinct.toLocalIterator():  # a part at a time
        own.append(row)
        if len(own) == most:
            parts.append(part(own))
            own = []
    return parts + ([part(own)] if own or not parts else [])


@dataclass
class FilterSet:
    filters: list[dict]

    def __post_init__(self):
        n = len(self.filters)
        self.fields = [c for c in FIELDS if any(f.get(c) is not None for f in self.filters)]
        self.accepts: dict[str, dict[str, np.ndarray]] = {}
        self.free: dict[str, np.ndarray] = {}
        for c in self.fields:
            found, free = {}, np.zeros(n, bool)
            for k, f in enumerate(self.filters):
                values = f.get(c)
                if values is None or (c != "status" and c != "last_reviewed_after" and not values):
                    free[k] = True
                elif c != "last_reviewed_after":
                    for v in values:
                        found.setdefault(v, np.zeros(n, bool))[k] = True
            self.accepts[c], self.free[c] = found, free
        days = [f.get("last_reviewed_after") for f in self.filters]
        self.since = np.array([np.iinfo(np.int64).max if d is None else (d - _EPOCH).days for d in days])

    def columns(self) -> list[str]:
        """Columns of chunks and documents that the filters read."""
        names = {"path_prefix": "path", "last_reviewed_after": "last_reviewed", **OVERLAPS}
        return [names.get(c, c) for c in self.fields]

    def _rows(self, values: pa.Array, field: str) -> np.ndarray:
        """A row of bits for each value: the filters whose ``field`` lists it; null is listed by none."""
        coded = pc.dictionary_encode(values)
        none = np.zeros(len(self.filters), bool)
        table = np.stack([*[self.accepts[field].get(v, none) for v in coded.dictionary.to_pylist()], none])
        return table[pc.fill_null(coded.indices, len(table) - 1).to_numpy(zero_copy_only=False)]

    def _shares(self, lists: pa.Array, field: str) -> np.ndarray:
        out = np.zeros((len(lists), len(self.filters)), bool)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        full = np.flatnonzero(sizes > 0)
        if len(full):
            out[full] = np.logical_or.reduceat(self._rows(lists.flatten(), field), np.append(0, np.cumsum(sizes[full])[:-1]), axis=0)
        return out

    def met(self, batch: dict[str, pa.Array], n: int) -> np.ndarray:
        """``n`` rows of a bit for each filter."""
        out = np.ones((n, len(self.filters)), bool)
        for c in self.fields:
            if c in LISTS:
                ok = self._rows(batch[c], c)
            elif c == "path_prefix":
                ok = np.zeros_like(out)
                for prefix, who in self.accepts[c].items():
                    ok[pc.fill_null(pc.starts_with(batch["path"], prefix), False).to_numpy(zero_copy_only=False)] |= who
            elif c == "last_reviewed_after":
                days = pc.fill_null(batch["last_reviewed"].cast(pa.int32()), np.iinfo(np.int32).min).to_numpy(zero_copy_only=False).astype(np.int64)
                ok = days[:, None] >= self.since
            else:
                ok = self._shares(batch[OVERLAPS[c]], c)
                if c == "tags" and "own_tags" in batch:
                    ok |= self._shares(batch["own_tags"], c)
            out &= ok | self.free[c]
        return out


_EPOCH = datetime.date(1970, 1, 1)


def fitting(chunks: DataFrame, docs: DataFrame, filters: list[dict]) -> DataFrame:
    """``chunk_id, fits``: for each chunk of ``docs`` a bit for each filter that it meets, if it meets one.

    ``chunks(chunk_id, document_id)`` may have ``tags`` of its own. The filters are sent
    to the tasks: at most ``MOST``, of 100 items a field as requests are bounded.
    """
    own = FilterSet(filters)
    names = list(dict.fromkeys(own.columns()))
    tags = [F.col("tags").alias("own_tags")] if "tags" in own.fields and "tags" in chunks.columns else []
    both = chunks.select("chunk_id", "document_id", *tags).join(docs.select("document_id", *names), "document_id")
    return _fitting(both, ["chunk_id"], [*names, *["own_tags"] * bool(tags)], own)


def fitting_documents(docs: DataFrame, filters: list[dict]) -> DataFrame:
    """``document_id, text, fits`` of the documents that meet a filter, where they are read: for chunks that have no tags of their own."""
    own = FilterSet(filters)
    return _fitting(docs, ["document_id", "text"], list(dict.fromkeys(own.columns())), own)


def _fitting(rows: DataFrame, kept: list[str], names: list[str], own: FilterSet) -> DataFrame:
    """``kept`` columns of the rows that meet a filter, with ``fits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            met = own.met(dict(zip(names, b.columns[len(kept) :], strict=True)), b.num_rows)
            some = np.flatnonzero(met.any(axis=1))
            packed = np.packbits(met[some], axis=1)
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(some)) for c in b.columns[: len(kept)]], pa.array([r.tobytes() for r in packed], pa.binary())], [*kept, "fits"])

    shape = ", ".join([*[f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept], "fits binary"])
    return rows.select(*kept, *names).mapInArrow(run, shape)
