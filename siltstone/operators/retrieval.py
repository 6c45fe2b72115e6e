"""Hybrid retrieval over written indexes or in one pass over the tables, with filters by query."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.scoring import RankingConfig
from siltstone.operators import query_filters, search
from siltstone.operators.text_index import TextIndex, has_bit
from siltstone.operators.vector_index import VectorIndex
from siltstone.sources.snapshots import Store
from siltstone.sources.storage import stored


@dataclass(frozen=True)
class SearchIndex:
    """Chunks, postings and vectors of one store, that change together."""

    text: TextIndex
    vectors: VectorIndex

    @classmethod
    def at(cls, spark: SparkSession, path: str, stop_words: list[str] = search.STOP_WORDS, stems: bool = True) -> SearchIndex:
        store = Store(spark, path)
        return cls(TextIndex(store, tuple(stop_words), stems), VectorIndex(store))

    @property
    def store(self) -> Store:
        return self.text.store

    def chunks(self) -> DataFrame:
        return self.text.chunks()

    def built(self, vectors: bool = True) -> bool:
        tables = self.store.manifest()["tables"]
        return self.text.name in tables and (not vectors or self.vectors.name in tables)

    def build(self, chunks: DataFrame, vectors: DataFrame) -> SearchIndex:
        """Index ``chunks(chunk_id, document_id, chunk_index, content, ...)`` and ``vectors(chunk_id, embedding)``."""
        change = self.store.begin()
        self.text.build(chunks, change=change)
        VectorIndex.build(self.store, vectors, change=change)
        change.commit()
        return self

    def build_text(self, chunks: DataFrame, texts: bool = True) -> SearchIndex:
        """Index the chunks alone, with their texts or without: text searches need no vectors."""
        self.text.build(chunks, texts=texts)
        return self

    def build_vectors(self, vectors: DataFrame) -> SearchIndex:
        """Index the vectors of chunks that are there, by a change of their own."""
        VectorIndex.build(self.store, vectors)
        return self

    def update(self, chunks: DataFrame, vectors: DataFrame, deletes: DataFrame | None = None) -> None:
        """New and changed chunks with their vectors, and ``deletes(chunk_id)``: one change of all tables."""
        change = self.store.begin()
        gone = chunks.select("chunk_id") if deletes is None else chunks.select("chunk_id").union(deletes.select("chunk_id"))
        self.text.update(chunks, deletes, change)
        self.vectors.remove(gone.withColumnRenamed("chunk_id", "id"), change)
        self.vectors.add(vectors, change=change)
        change.commit()

    def arms(self, queries: DataFrame, allowed: DataFrame | None = None, limit: int = search.ARM_LIMIT) -> list[DataFrame]:
        """The vector arm and the text arm, of chunks in ``allowed(chunk_id, fits)``."""
        near = self.vectors.nearest(queries, limit, None if allowed is None else allowed.withColumnRenamed("chunk_id", "id"))
        return [near.withColumnRenamed("id", "chunk_id"), self.text.ranked(queries, limit, allowed)]


@dataclass(frozen=True)
class Scan:
    """Chunks and vectors without an index, for a table of queries that is searched once.

    Both arms are exact and give what a ``SearchIndex`` gives. The text arm reads every
    text once and shuffles the chunks that match (see ``search.matched``), the vector arm
    reads every vector once; an index costs more to write than that, and pays when it is
    searched again. ``keys(chunk_id, document_id, ...)`` are the chunks, ``contents(chunk_id,
    content)`` their texts; ``vectors(keys)`` gives ``chunk_id, embedding`` for those keys,
    and their ``fits`` if they have it. Where ``split(docs)`` cuts documents with their
    text into chunks of that form and keeps their ``fits``, filters of documents are met
    where a text is read, each task gives out only a query's best, and nothing is joined.
    """

    keys: DataFrame
    contents: DataFrame
    vectors: Callable[[DataFrame], DataFrame]
    stop_words: tuple = tuple(search.STOP_WORDS)
    stems: bool = True
    split: Callable[[DataFrame], DataFrame] | None = None

    def chunks(self) -> DataFrame:
        return self.keys

    def arms_of(self, queries: DataFrame, docs: DataFrame, limit: int = search.ARM_LIMIT) -> list[DataFrame]:
        """The vector arm and the text arm, of the chunks of ``docs(document_id, text, fits)``."""
        own = self.split(docs)
        found = search.matched(queries, own, list(self.stop_words), self.stems, limit)
        return [search.vector_arm(queries, self.vectors(own.drop("content")), limit), _cut(found, limit)]

    def arms(self, queries: DataFrame, allowed: DataFrame | None = None, limit: int = search.ARM_LIMIT) -> list[DataFrame]:
        """The vector arm and the text arm, of chunks in ``allowed(chunk_id, fits)``."""
        own = self.keys if allowed is None else self.keys.join(allowed, "chunk_id")
        found = search.matched(queries, self.contents, list(self.stop_words), self.stems)
        if allowed is not None:
            found = found.join(allowed, "chunk_id")
            if "filter" in queries.columns:
                found = found.join(queries.select("query_id", "filter"), "query_id").where(has_bit(F.col("fits"), F.col("filter")))
        return [search.vector_arm(queries, self.vectors(own), limit), _cut(found, limit)]


def _cut(found: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "chunk_id")
    return found.select("query_id", "chunk_id", "rank_score").withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit)


def allowed_chunks(index: SearchIndex | Scan | TextIndex, docs: DataFrame) -> DataFrame:
    """``chunk_id`` of the chunks of ``docs``, stored: both arms read it."""
    return stored(index.chunks().select("chunk_id", "document_id").join(docs.select("document_id"), "document_id", "left_semi").select("chunk_id"), "allowed")


def fused(queries: DataFrame, docs: DataFrame, index: SearchIndex | Scan) -> DataFrame:
    """``query_id, chunk_id, score, rn``: both arms over ``docs``, each query's own filter met before they are cut, fused.

    Filters are columns of ``queries`` (see ``query_filters.FIELDS``).
    """
    in_place = isinstance(index, Scan) and index.split is not None
    if not set(query_filters.FIELDS) & set(queries.columns):
        if in_place:
            return search.fused(index.arms_of(queries, docs.select("document_id", "text")))
        return search.fused(index.arms(queries, allowed_chunks(index, docs)))
    out = None
    for own, filters in query_filters.numbered(queries):
        own = stored(own, "filtered-queries")
        if in_place:
            arms = index.arms_of(own, query_filters.fitting_documents(docs, filters))
        else:
            arms = index.arms(own, stored(query_filters.fitting(index.chunks(), docs, filters), "fitting"))
        found = search.fused(arms)
        out = found if out is None else out.union(stored(found, "fused"))
    return out


def hybrid(queries: DataFrame, docs: DataFrame, index: SearchIndex | Scan, as_of: str, config: RankingConfig | None = None, max_results: int = 10, texts: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Ranked candidates of every query over a written index or a scan; what ``search.hybrid`` gives.

    ``docs`` are the documents that any query may see. Texts are read of the few
    chunks that are left after fusion: the index's, or ``texts(wanted)`` where it keeps
    none (see ``search.candidates``).
    """
    # A few rows per query: stored, their size is known, and they are sent to the chunks and not these to them.
    found = search.candidates(stored(fused(queries, docs, index), "fused"), index.chunks().drop("gen"), docs.drop("text"), texts)
    return search.ranked(found, as_of, config or RankingConfig(), max_results)
