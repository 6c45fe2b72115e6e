"""What the operators of this package share: tables, shared storage, components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.sources.storage import drop_stored, new_folder, shared_folder, so_far, stored

__all__ = ["by_position", "components", "drop_stored", "each", "new_folder", "shared_folder", "so_far", "stored", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def each(texts: pa.Array) -> Iterator[str | None]:
    """The texts of an Arrow array one at a time, so that a batch is never a list of Python strings as a whole."""
    return (texts[k].as_py() for k in range(len(texts)))


def by_position(df: DataFrame, *made: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns called ``c0``, ``c1`` ..., and their names.

    So no name that an operator uses inside can clash with one of the caller's. Columns
    named like one in ``made``, in any case, are left out: the operator makes them anew.
    """
    names = [c for c in df.columns if c.lower() not in made]
    return df.select(*[F.col(f"`{c.replace('`', '``')}`").alias(f"c{k}") for k, c in enumerate(names)]), names


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``.

    ``component`` is the smallest node that can be reached. Nodes without an
    edge are not listed. Alternates the large-star and small-star steps of
    Kiveris et al. (2014) until nothing changes: each step only points nodes at the
    smallest neighbour they know, so the number of edges never grows and each round
    but the last gets nearer to the end. Each group is reduced with an associative
    minimum and joined back instead of collected. Every round is stored, so the
    lineage stays short, and the round before is deleted.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    begin = so_far()
    now = stored(pairs, "links")
    mark, done = _mark(now), False
    while mark[0] and not done:
        # Large star: every neighbour above the node moves to the node's minimum.
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: every neighbour below the node, and the node, move to the minimum.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop_stored(spark, begin, 1)
        mark, done = (after := _mark(now)), after == mark
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
