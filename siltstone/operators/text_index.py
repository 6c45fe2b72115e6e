"""A written text index: postings in buckets by term, kept up to date by deltas.

Two tables of a ``Store``: ``chunks`` (``chunk_id, document_id, chunk_index, gen`` and
whatever the caller adds, by chunk) and ``postings`` (``term, chunk_id, gen, tf,
positions``, by term, sorted by term). A chunk that changes gets new postings under the
change's number, ``gen``, in folders of their own; older ones are dead, as the chunk's
row names the ``gen`` that counts, until ``compact`` drops them. A search reads the
buckets of its terms, and no text. Texts are in ``chunks`` unless they are kept elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import search
from siltstone.sources.snapshots import Change, Store, bucket_of
from siltstone.sources.storage import stored

N_BUCKETS = 64


@dataclass(frozen=True)
class TextIndex:
    store: Store
    stop_words: tuple = tuple(search.STOP_WORDS)
    stems: bool = True
    chunks_name: str = "chunks"
    name: str = "postings"

    @staticmethod
    def _spread(lists: DataFrame, gen: int) -> DataFrame:
        """Posting lists as rows of the table; other columns stay."""
        return search.unpacked(lists).withColumns({"gen": F.lit(gen).cast("long"), "tf": F.size("positions")})

    def build(self, chunks: DataFrame, n_buckets: int = N_BUCKETS, change: Change | None = None, texts: bool = True) -> TextIndex:
        """Index ``chunks(chunk_id, document_id, content, ...)``; with ``change``, as a part of it.

        Without ``texts`` the index doesn't keep the content: whoever has it elsewhere
        reads it there. The postings of a term in a block of chunks are dealt to their
        bucket as one row.
        """
        fresh = change or self.store.begin()
        gen = fresh.base["version"] + 1
        kept = chunks if texts else chunks.drop("content")
        made = fresh.create(self.chunks_name, kept.withColumn("gen", F.lit(gen).cast("long")), ["chunk_id"], n_buckets=n_buckets)
        written = self.store._read(fresh.tables[self.chunks_name] | {"buckets": made}, None, False) if texts else chunks
        lists = search.posting_lists(written, list(self.stop_words), self.stems)
        fresh.create(self.name, lists, ["term", "chunk_id", "gen"], ["term"], n_buckets, after=lambda dealt: self._spread(dealt, gen))
        if change is None:
            fresh.commit()
        return self

    def update(self, chunks: DataFrame, deletes: DataFrame | None = None, change: Change | None = None) -> None:
        """New and changed ``chunks``, and ``deletes(chunk_id)``: their buckets of ``chunks`` are merged, postings are added."""
        fresh = change or self.store.begin()
        gen = fresh.base["version"] + 1
        fresh.merge(self.chunks_name, chunks.withColumn("gen", F.lit(gen).cast("long")), deletes)
        lists = search.posting_lists(chunks, list(self.stop_words), self.stems)
        fresh.append(self.name, self._spread(lists, gen).select("term", "chunk_id", "positions", "gen", "tf"))
        if change is None:
            fresh.commit()

    def compact(self, most: int = 1) -> None:
        """Puts the postings of buckets in more than ``most`` folders together, without the dead ones."""
        fresh = self.store.begin()
        fresh.compact(self.name, most, self.chunks().select("chunk_id", "gen"))
        fresh.commit()

    def chunks(self) -> DataFrame:
        return self.store.read(self.chunks_name)

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """``term, chunk_id, tf, positions`` that count: all, or those of ``terms(term)``, of which only the buckets are read."""
        table = self.store.manifest()["tables"][self.name]
        buckets = None
        if terms is not None:
            buckets = [r[0] for r in terms.select(bucket_of(["term"], table["n_buckets"])).distinct().collect()]  # at most n_buckets numbers
        out = self.store._read(table, buckets, False)
        if terms is not None:
            out = out.join(terms.select("term").distinct(), "term", "left_semi")
        # Where nothing was ever changed, all postings are of the chunks that there are.
        if len({d for dirs in table["buckets"].values() for d in dirs}) > 1:
            out = out.join(self.chunks().select("chunk_id", "gen"), ["chunk_id", "gen"], "left_semi")
        return out.select("term", "chunk_id", "tf", "positions")

    def ranked(self, queries: DataFrame, limit: int = search.ARM_LIMIT, allowed: DataFrame | None = None) -> DataFrame:
        """``query_id, chunk_id, rank_score, rnk``, as ``search.text_arm`` gives them.

        A query's rarest term names the chunks that can have all; those of a query of one
        term are ranked by how often it occurs, as each occurrence is a cover. For the
        others, the postings of their terms are put together by chunk, once for all
        queries, and a chunk meets the queries that it was named for. ``allowed(chunk_id,
        fits)`` restricts what is seen, ``fits`` by the query's ``filter``.
        """
        terms = stored(search.query_terms(queries, list(self.stop_words), self.stems), "terms")
        index = self.postings(terms)
        counts = stored(index.groupBy("term").agg(F.count("*").alias("df")), "term-counts")
        asked = terms.join(counts, "term").groupBy("query_id").agg(F.first("n_terms").alias("n"), F.sort_array(F.collect_list("term")).alias("terms"), F.min_by("term", F.struct("df", "term")).alias("term")).where(F.size("terms") == F.col("n"))
        if allowed is not None and "filter" in queries.columns:
            asked = asked.join(queries.select("query_id", "filter"), "query_id")
        asked = stored(asked, "asked")
        one, more = asked.where("n = 1"), asked.where("n > 1")
        named = self._named(one, index, allowed, "tf")
        alone = named.select("query_id", "chunk_id", F.round(F.col("tf") * 0.1, 9).alias("rank_score"))
        wanted = more.select(F.explode("terms").alias("term")).distinct()
        held = index.join(wanted, "term", "left_semi").select("chunk_id", "term", "positions").repartition("chunk_id")
        held = held.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("held"))
        both = self._named(more, index, allowed, "terms").join(held, "chunk_id").where(F.forall("terms", lambda t: F.map_contains_key("held", t)))
        hits = F.transform("terms", lambda t: F.struct(t.alias("term"), F.element_at("held", t).alias("positions")))
        together = both.select("query_id", "chunk_id", search.rank_of(hits, F.size("terms")).alias("rank_score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), "chunk_id")
        return alone.unionByName(together).withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit)

    def _named(self, asked: DataFrame, index: DataFrame, allowed: DataFrame | None, *keep: str) -> DataFrame:
        """``query_id, chunk_id`` and columns to keep: the chunks with the ``term`` of each row of ``asked`` that its query may see."""
        named = asked.join(index.select("term", "chunk_id", "tf"), "term")
        if allowed is not None:
            named = named.join(allowed, "chunk_id")
            if "filter" in asked.columns:
                named = named.where(has_bit(F.col("fits"), F.col("filter")))
        return named.select("query_id", "chunk_id", *keep)


def has_bit(fits: Column, bit: Column) -> Column:
    """Whether a bit set, the first bit of a byte its highest, has a bit."""
    byte = F.conv(F.hex(F.substring(fits, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.bit_get(byte, (7 - bit % 8).cast("int")) == 1

