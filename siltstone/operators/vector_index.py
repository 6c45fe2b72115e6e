"""A written vector index: an inverted file by cells, product-quantised codes, exact re-ranking.

The index is two tables of a ``Store``: the vectors and their codes, in one bucket per
cell, and a model (centres, code books, sizes and radii of cells). Every vector is
indexed; centres and code books are fitted on a bounded sample (``SAMPLE`` rows, those
of the smallest id hashes). A search names the cells that it needs before it reads:
files of other cells are not opened.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import search
from siltstone.operators.text_index import has_bit
from siltstone.sources.snapshots import BUCKET, Change, Store
from siltstone.sources.storage import stored

#: Rows that centres and code books are fitted on, at most.
SAMPLE = 20_000
#: Dimensions that one byte of a code stands for, and how many different ones there are.
CODE_DIMS, CODES = 4, 256
#: Rows that the codes hand on for each one that is returned.
RERANK = 8
#: Rows whose nearest centres are looked for at once.
BLOCK = 1024
#: Of a search in a part of the vectors, so many times its limit is looked for in all of them first.
WIDER = 3
#: Added to a radius, as cosines are rounded to nine digits.
SLACK = 1e-4


def _fit(rows: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of a k-means by squared distance."""
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(axis=1)
        sums, counts = np.zeros_like(centres), np.bincount(own, minlength=len(centres))
        np.add.at(sums, own, rows)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts[:, None], 1), centres)
    return centres


@dataclass(frozen=True)
class Model:
    """What a search must know before it reads: small, whatever the number of vectors."""

    centres: np.ndarray  # a unit vector per cell
    books: list[np.ndarray]  # code words of each group of dimensions
    sizes: np.ndarray  # vectors of each cell
    radii: np.ndarray  # largest angle of a cell's vector to its centre
    probes: int  # cells that find ``recall`` of the nearest in the sample

    @property
    def others(self) -> int:
        """The cell of vectors that have another number of dimensions."""
        return len(self.centres)


@dataclass(frozen=True)
class VectorIndex:
    store: Store
    name: str = "vectors"

    @classmethod
    def build(cls, store: Store, vectors: DataFrame, id_col: str = "chunk_id", name: str = "vectors", recall: float = 0.95, change: Change | None = None) -> VectorIndex:
        """Index ``vectors(id_col, embedding)``; unusable ones (see ``search.usable``) are in no search and not indexed.

        With ``change`` the tables are part of it, and visible when it is committed.
        """
        own = search.usable(vectors.where(F.col(id_col).isNotNull()), "embedding").select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        # Read for the sample, of which a filter by id picks the rows, and once more for the cells: not stored in between.
        n = search.about(own)
        rows = [r["embedding"] for r in search.smallest_hashes(own, n, SAMPLE)]
        # The sample's commonest number of dimensions has cells; others are one more cell.
        width = min(((-k, w) for w, k in Counter(map(len, rows)).items()), default=(0, 1))[1]
        data = search._unit(np.array([r for r in rows if len(r) == width], np.float64)) if rows else np.zeros((1, width))
        centres, probes = search._cells(data, n, recall=recall) if rows else (data, 1)
        books = [_fit(data[:, a : a + CODE_DIMS], CODES) for a in range(0, width, CODE_DIMS)]
        fresh = change or store.begin()
        index = cls(store, name)
        index._write(fresh, own, centres, books, probes, new=True)
        if change is None:
            fresh.commit()
        return index

    def add(self, vectors: DataFrame, id_col: str = "chunk_id", change: Change | None = None) -> None:
        """More vectors, with the centres and code books that there are; ids must be new (see ``remove``)."""
        own = search.usable(vectors.where(F.col(id_col).isNotNull()), "embedding").select(F.col(id_col).alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        fresh, model = change or self.store.begin(), self.model()
        self._write(fresh, own, model.centres, model.books, model.probes, new=False)
        if change is None:
            fresh.commit()

    def _write(self, change: Change, own: DataFrame, centres: np.ndarray, books: list[np.ndarray], probes: int, new: bool) -> None:
        width, others = centres.shape[1], len(centres)

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors = b.column(1)
                flat = vectors.flatten().to_numpy(zero_copy_only=False)
                ends = vectors.offsets.to_numpy() - vectors.offsets[0].as_py()
                mine = np.flatnonzero(np.diff(ends) == width)
                cell, angle = np.full(b.num_rows, others, np.int32), np.zeros(b.num_rows)
                code = [None] * b.num_rows
                if len(mine):
                    rows = search._unit(flat[ends[mine, None] + np.arange(width)].astype(np.float64))
                    for a in range(0, len(mine), BLOCK):
                        near = rows[a : a + BLOCK] @ centres.T
                        cell[mine[a : a + BLOCK]] = near.argmax(axis=1)
                        angle[mine[a : a + BLOCK]] = np.arccos(np.clip(near.max(axis=1), -1, 1))
                    packed = np.stack([((w * w).sum(1) - 2 * rows[:, k * CODE_DIMS : (k + 1) * CODE_DIMS] @ w.T).argmin(axis=1) for k, w in enumerate(books)], axis=1).astype(np.uint8)
                    for k, row in zip(mine.tolist(), packed, strict=True):
                        code[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(angle), pa.array(code, pa.binary())], ["id", "embedding", BUCKET, "angle", "code"])

        kind = own.schema["id"].dataType.simpleString()
        dealt = own.mapInArrow(deal, f"id {kind}, embedding array<double>, {BUCKET} int, angle double, code binary")
        made = change.create(self.name, dealt, ["id"], n_buckets=others + 1) if new else change.append(self.name, dealt)
        # Sizes and radii of the cells, from what was written alone.
        written = self.store._read(change.tables[self.name] | {"buckets": made}, None, True)
        stats = {r[0]: (r[1], r[2]) for r in written.groupBy(BUCKET).agg(F.count("*"), F.max("angle")).collect()}  # a row per cell
        if not new:
            old = self.model()
            stats = {k: (int(old.sizes[k]) + stats.get(k, (0, 0))[0], max(float(old.radii[k]), stats.get(k, (0, 0.0))[1])) for k in range(others + 1)}
        model = [("centre", k, [float(x) for x in c], *stats.get(k, (0, 0.0))) for k, c in enumerate(centres)]
        model += [("word", 1000 * k + j, [float(x) for x in w], 0, 0.0) for k, book in enumerate(books) for j, w in enumerate(book)]
        model += [("others", others, [], *stats.get(others, (0, 0.0))), ("probes", probes, [], 0, 0.0)]
        change.create(f"{self.name}_model", own.sparkSession.createDataFrame(model, "kind string, number int, vector array<double>, n long, radius double"), ["kind", "number"], n_buckets=1)

    def remove(self, ids: DataFrame, change: Change | None = None) -> None:
        """Takes ``ids(id)`` out; only the cells that hold one are rewritten."""
        fresh = change or self.store.begin()
        table = fresh.tables[self.name]
        rows = self.store._read(table, None, True)
        cells = [r[0] for r in rows.join(ids.select("id"), "id", "left_semi").select(BUCKET).distinct().collect()]  # at most a number per cell
        if cells:
            made = fresh._write(self.name, fresh._dealt(table, self.store._read(table, cells, True).join(ids.select("id"), "id", "left_anti")))
            table["buckets"] = {b: d for b, d in table["buckets"].items() if int(b) not in cells} | made
        if change is None:
            fresh.commit()

    def model(self) -> Model:
        rows = self.store.read(f"{self.name}_model").collect()  # 4,097 centres and 256 words a byte of code, at most
        of = lambda kind: sorted((r for r in rows if r.kind == kind), key=lambda r: r.number)
        centres, others = of("centre"), of("others")
        books: dict[int, list] = {}
        for r in of("word"):
            books.setdefault(r.number // 1000, []).append(r.vector)
        return Model(
            np.array([r.vector for r in centres]), [np.array(books[k]) for k in sorted(books)], np.array([r.n for r in centres + others]), np.array([r.radius for r in centres + others]), of("probes")[0].number
        )

    @staticmethod
    def _looks(rows: list, model: Model, probes: int) -> list[tuple]:
        """``(unit vector or None, cells by nearness)`` of each query."""
        out = []
        for r in rows:
            if len(r["query_vector"]) != model.centres.shape[1]:
                out.append((None, [model.others]))
                continue
            v = search._unit(np.array([r["query_vector"]], np.float64))[0]
            out.append((v, np.argsort(-(model.centres @ v), kind="stable")[:probes].tolist()))
        return out

    def vectors(self, cells: list[int] | None = None) -> DataFrame:
        """``id, embedding, cell``; only the files of the given cells are listed."""
        return self.store.read(self.name, cells, with_bucket=True).select("id", "embedding", F.col(BUCKET).alias("cell"))

    def nearest(self, queries: DataFrame, limit: int = search.ARM_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
        """``query_id, id, distance, rnk``: the exact nearest vectors, from the cells that can hold one.

        The cells nearest to a query, up to ``2 * limit`` vectors, bound its distance; a
        cell is read as well unless its radius says that all of it is farther. Vectors
        without clusters leave few cells out. ``allowed(id, fits)`` restricts what is
        seen, ``fits`` by the query's ``filter``: of the nearest of all, a few times as
        many as are wanted, those that a query may see are enough for most queries; for
        the others the vectors are joined with what is allowed and searched again.
        """
        model = self.model()
        keys = queries.select("query_id", "query_vector", *[c for c in ("filter",) if c in queries.columns])
        kind = queries.schema["query_id"].dataType.simpleString()
        if allowed is None:
            return search._each_part(keys, "nearest", lambda rows: self._nearest([r.asDict() for r in rows], kind, model, limit, None))
        return search._each_part(keys, "nearest", lambda rows: self._allowed(rows, keys, kind, model, limit, allowed))

    def _allowed(self, rows: list, keys: DataFrame, kind: str, model: Model, limit: int, allowed: DataFrame) -> DataFrame:
        """``_nearest`` among ``allowed``: no vector is shuffled for a query that finds enough among the nearest of all."""
        wide = WIDER * limit
        free = [{k: v for k, v in r.asDict().items() if k != "filter"} for r in rows]
        found = stored(self._nearest(free, kind, model, wide, None).select("query_id", "id", "distance"), "nearest")
        seen = found.join(allowed, "id")
        if "filter" in keys.columns:
            seen = seen.join(keys.select("query_id", "filter"), "query_id").where(has_bit(F.col("fits"), F.col("filter")))
        seen = stored(seen.select("query_id", "id", "distance"), "allowed-nearest")
        n_seen = dict(map(tuple, seen.groupBy("query_id").count().collect()))  # a number per query
        n_found = dict(map(tuple, found.groupBy("query_id").count().collect()))
        rest = [r for r in rows if n_seen.get(r["query_id"], 0) < limit and n_found.get(r["query_id"], 0) == wide]
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        if not rest:
            return seen.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit)
        again = self._nearest([r.asDict() for r in rest], kind, model, limit, allowed).drop("rnk")
        done = seen.where(~F.col("query_id").isin([r["query_id"] for r in rest]))
        return done.unionByName(again).withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit)

    def _nearest(self, rows: list, kind: str, model: Model, limit: int, allowed: DataFrame | None) -> DataFrame:
        looks = self._looks(rows, model, len(model.centres))
        first = [cells[: int(np.searchsorted(np.cumsum(model.sizes[cells]), 2 * limit)) + 1] for _, cells in looks]
        found = stored(self._among(rows, kind, first, limit, allowed), "nearest")
        worst = {r[0]: r[1] for r in found.groupBy("query_id").agg(F.max("distance"), F.count("*").alias("n")).where(f"n = {limit}").collect()}  # a number per query
        later = []
        for r, (v, cells), begun in zip(rows, looks, first, strict=True):
            rest = np.array(cells[len(begun) :], int)
            angle = np.arccos(np.clip(model.centres[rest] @ v, -1, 1)) if len(rest) else np.zeros(0)
            least = 1 - np.cos(np.maximum(0, angle - model.radii[rest] - SLACK))
            later.append([int(c) for c, d in zip(rest, least, strict=True) if d <= worst.get(r["query_id"], np.inf) and model.sizes[c]])
        if any(later):
            found = found.union(self._among(rows, kind, later, limit, allowed))
        order = Window.partitionBy("query_id").orderBy("distance", "id")
        return found.select("query_id", "id", "distance").withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit)

    def _among(self, rows: list, kind: str, cells: list[list[int]], limit: int, allowed: DataFrame | None) -> DataFrame:
        """The nearest of each query in its own cells."""
        vectors = self.vectors(sorted({c for own in cells for c in own}))
        if allowed is not None:
            vectors = vectors.join(allowed, "id")
        return search.nearest_of([r | {"cells": own} for r, own in zip(rows, cells, strict=True)], kind, vectors, limit, "id")

    def approximate(self, queries: DataFrame, limit: int = search.ARM_LIMIT, probes: int | None = None, rerank: int = RERANK) -> DataFrame:
        """``query_id, id, distance, rnk``: near vectors by codes in the query's cells, the best ``rerank * limit`` compared exactly.

        ``probes`` cells are looked into; by default as many as the fit asked for.
        """
        model = self.model()
        keys = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector"))
        kind = queries.schema["query_id"].dataType.simpleString()
        return search._each_part(keys, "near", lambda part: self._approximate(part, keys, kind, model, limit, probes or model.probes, rerank))

    def _approximate(self, part: list, queries: DataFrame, query_kind: str, model: Model, limit: int, probes: int, rerank: int) -> DataFrame:
        looks = [(r["query_id"], *look) for r, look in zip(part, self._looks(part, model, probes), strict=True)]
        cells = sorted({c for _, _, own in looks for c in own})
        others = model.others
        sent = queries.sparkSession.sparkContext.broadcast((looks, model.books))
        rows = self.store.read(self.name, cells, with_bucket=True).select("id", "code", BUCKET)
        kind = rows.schema["id"].dataType.simpleString()

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            looks, books = sent.value
            asking = search._by_cell([c for _, _, c in looks])
            tables: dict[int, np.ndarray] = {}
            found, exact = search._Nearest(len(looks), rerank * limit), []
            for b in batches:
                ids = np.array(b.column(0).to_pylist(), dtype=object if kind == "string" else None)
                cell = b.column(2).to_numpy()
                for c in np.unique(cell).tolist():
                    at, who = np.flatnonzero(cell == c), asking.get(c, np.zeros(0, int))
                    if c == others:
                        exact += [(k, i) for k in who.tolist() for i in ids[at].tolist()]
                        continue
                    codes = np.frombuffer(b"".join(b.column(1).take(pa.array(at)).to_pylist()), np.uint8).reshape(len(at), -1)
                    far = np.ones((len(who), len(at)))
                    for row, k in enumerate(who.tolist()):
                        if k not in tables:
                            v = looks[k][1]
                            tables[k] = np.stack([np.pad(w @ v[j * CODE_DIMS : (j + 1) * CODE_DIMS], (0, CODES - len(w))) for j, w in enumerate(books)])
                        far[row] -= tables[k][np.arange(codes.shape[1])[:, None], codes.T].sum(axis=0)
                    if len(who):
                        found.add(ids[at], far, who)
            q, d, i = found.best()
            names = [looks[k][0] for k in q.tolist()] + [looks[k][0] for k, _ in exact]
            yield pa.RecordBatch.from_arrays([pa.array(names, search._ids.get(query_kind)), pa.array(i.tolist() + [x for _, x in exact], search._ids.get(kind)), pa.array(d.tolist() + [None] * len(exact), pa.float64())], ["query_id", "id", "guess"])

        guessed = rows.mapInArrow(near, f"query_id {query_kind}, id {kind}, guess double")
        best = guessed.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("guess", "id"))).where((F.col("n") <= rerank * limit) | F.col("guess").isNull()).select("query_id", "id")
        told = best.join(self.vectors(cells).select("id", "embedding"), "id").join(queries, "query_id").where(F.size("embedding") == F.size("query_vector"))
        out = told.select("query_id", "id", F.round(search.cosine_distance(F.col("query_vector"), F.col("embedding")), 9).alias("distance"))
        return out.withColumn("rnk", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).where(F.col("rnk") <= limit)

