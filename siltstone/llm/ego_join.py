"""Embedding near-duplicates by an epsilon grid order join.

For unit vectors, cosine >= t is a distance of at most ``eps = sqrt(2 - 2 t)``.
Vectors are projected on their leading principal directions, which never makes a
distance larger, and put in epsilon grid order: by label, then lexicographically
by grid cell of width ``eps`` (Boehm et al., "Epsilon grid order", 2001). The
sequence is cut into intervals of at most ``BLOCK`` vectors, each with its bounding
box, and joined with itself recursively: a pair of intervals of the sequence is
divided into the pairs of their ``FAN`` parts, and pairs whose labels or boxes are
provably apart go, down to single blocks. That needs boxes only, one small
equi-join a level. In a task each pair of blocks that is left is halved on in the
same way, down to small matrix products in double precision. Pairs are sent to tasks in
tiles of eight by eight neighbouring blocks, so vectors move once a tile.

Equal vectors of a label are one class with a count. A task returns, for a pair
of blocks, how many vectors each class links with and links that span what is
connected, not the pairs: the output grows with the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from siltstone.llm.common import components, drop_stored, so_far, stored, table

COSINE = 0.98
#: Leading principal directions that make the grid and the boxes.
DIRECTIONS = 6
BLOCK = 2048
LEAF = 128
#: Parts that an interval of the sequence is divided into, a level: 2 ** FAN_BITS.
FAN_BITS = 3
FAN = 1 << FAN_BITS
#: Pairs of blocks are joined in tiles of 2 ** TILE_BITS by as many blocks; a task holds one side, of at most TILE_BYTES of doubles (or one block).
TILE_BITS = 3
TILE_BYTES = 1 << 26


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows of ``width`` doubles of length 1, shorter ones filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return _unit(out)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length 1 in double precision; scaled by their largest component first, so that no square over- or underflows."""
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, width: int, directions: int = DIRECTIONS) -> np.ndarray:
    """Leading eigenvectors of the second moments about the mean, over all ``vectors(v)``.

    Each task sums its own rows; the sums of a partition are one row, added up in
    groups of partitions before the driver gets the last few.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            rows = np.hstack([_matrix(batch.column(0), width), np.ones((batch.num_rows, 1))])
            total += rows.T @ rows
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"sums": [sum(np.frombuffer(x) for x in frame["sums"]).tobytes()]})

    parts = vectors.mapInArrow(add, "sums binary").groupBy(F.pmod(F.monotonically_increasing_id() / (1 << 33), F.lit(32)).cast("int")).applyInPandas(merge, "sums binary")
    rows = parts.collect()
    total = sum((np.frombuffer(r["sums"]) for r in rows), np.zeros((width + 1) ** 2)).reshape(width + 1, width + 1)
    n = max(1.0, total[-1, -1])
    mean = total[-1, :-1] / n
    _, axes = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    return axes[:, ::-1][:, :directions].copy()


def join_blocks(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, eps: float, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows ``(i, j)`` of two intervals with cosine of at least ``cosine``; ``pa_``, ``pb`` are their projections."""
    found_i, found_j, todo = [], [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        x, y = pa_[a0:a1], pb[b0:b1]
        gap = np.maximum(0, np.maximum(x.min(axis=0) - y.max(axis=0), y.min(axis=0) - x.max(axis=0)))
        if (gap * gap).sum() > eps * eps:
            continue
        if a1 - a0 <= LEAF and b1 - b0 <= LEAF:
            i, j = np.nonzero(a[a0:a1] @ b[b0:b1].T >= cosine)
            found_i.append(i + a0)
            found_j.append(j + b0)
        elif a1 - a0 >= b1 - b0:
            mid = (a0 + a1) // 2
            todo += [(a0, mid, b0, b1), (mid, a1, b0, b1)]
        else:
            mid = (b0 + b1) // 2
            todo += [(a0, a1, b0, mid), (a0, a1, mid, b1)]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_i]), np.concatenate([empty, *found_j])


def _spanning(i: np.ndarray, j: np.ndarray, size: int) -> np.ndarray:
    """The smallest row that each of ``size`` rows reaches over the links ``i - j``."""
    low = np.arange(size)
    while True:
        least = np.minimum(low[i], low[j])
        then = low.copy()
        np.minimum.at(then, i, least)
        np.minimum.at(then, j, least)
        then = np.minimum(then, then[then])
        if (then == low).all():
            return low
        low = then


def tile_bits(block: int, width: int) -> int:
    """How many bits of a block's number tell it from the others of its tile, for blocks of ``block`` vectors of ``width``."""
    return max([k for k in range(TILE_BITS + 1) if (block * width * 8) << k <= TILE_BYTES], default=0)


def near_blocks(blocks: DataFrame, eps: float, directions: int) -> DataFrame:
    """``a, b``: pairs of ``blocks(block, label, size, lo, hi)`` that may hold vectors within ``eps``, ``a <= b``.

    ``block`` numbers the sequence in order, with the partition above its 33rd bit.
    """
    spark = blocks.sparkSession
    inner = F.max(F.col("block").bitwiseAND((1 << 33) - 1)).alias("inner")
    most = blocks.agg(inner, F.max(F.shiftright("block", 33)).alias("part")).first()
    bits = int(most["inner"] or 0).bit_length()
    place = F.shiftleft(F.shiftright("block", 33), bits) + F.col("block").bitwiseAND((1 << 33) - 1)
    placed = blocks.select("block", place.alias("at"), F.struct("label", "size").alias("kind"), "lo", "hi")
    depth = bits + int(most["part"] or 0).bit_length()
    corner = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(directions)]).alias(c)
    gap = F.aggregate(
        F.zip_with(F.zip_with("lo_a", "hi_b", lambda x, y: x - y), F.zip_with("lo_b", "hi_a", lambda x, y: x - y), lambda x, y: F.greatest(F.lit(0.0), x, y)),
        F.lit(0.0),
        lambda s, x: s + x * x,
    )
    pairs = spark.range(1).select(F.col("id").alias("a"), F.col("id").alias("b"))
    for shift in range(-(-depth // FAN_BITS) * FAN_BITS - FAN_BITS, -FAN_BITS, -FAN_BITS):
        nodes = placed.groupBy(F.shiftright("at", shift).alias("node")).agg(F.min("kind").alias("low"), F.max("kind").alias("high"), corner(F.min, "lo"), corner(F.max, "hi"))
        side = lambda tag, nodes=nodes: nodes.select(F.col("node").alias(tag), *[F.col(c).alias(f"{c}_{tag}") for c in ("low", "high", "lo", "hi")])
        parts = pairs.select(F.explode(F.sequence(F.col("a") * FAN, F.col("a") * FAN + FAN - 1)).alias("a"), "b").join(side("a"), "a")
        parts = parts.withColumn("b", F.explode(F.sequence(F.greatest("a", F.col("b") * FAN), F.col("b") * FAN + FAN - 1))).join(side("b"), "b")
        near = parts.where((F.col("low_a") <= F.col("high_b")) & (F.col("low_b") <= F.col("high_a"))).where(gap <= eps * eps)
        pairs = stored(near.select("a", "b"), "intervals")
    names = placed.select("at", "block")
    out = pairs.join(names.select(F.col("at").alias("a"), F.col("block").alias("block_a")), "a").join(names.select(F.col("at").alias("b"), F.col("block").alias("block_b")), "b")
    return out.select("block_a", "block_b")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: ``vec_id, n_links, component_id, kept``.

    Rows link when their labels are equal and their cosine is at least ``cosine``.
    Rows with a null id, label or vector, and vectors that are empty, zero or hold
    null or non-finite components link with nothing; nor do vectors of unequal
    size. Very large and very small components are no matter. ``component_id`` is the
    smallest id that links reach, the own one included; ``kept`` is whether it is the
    own one (null for a null id). Repeated rows count as vectors of their own. Ids are of
    any type that has an order, such as strings: those that are no whole numbers are
    numbered in their order first. Other columns are ignored. An empty table gives an
    empty one.
    """
    spark = vectors.sparkSession
    begin = so_far()
    source = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = source.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    classes = stored(valid.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")), "vectors")
    names = None
    if not isinstance(source.schema["vec_id"].dataType, IntegralType):
        # The order of the numbers is that of the sorted partitions and of the rows in them.
        names = stored(classes.select(F.col("id").alias("name")).distinct().orderBy("name").withColumn("number", F.monotonically_increasing_id()), "names")
        classes = stored(classes.join(names, F.col("id") == F.col("name")).select("label", "v", F.col("number").alias("id"), "n"), "numbered")
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    axes = principal_axes(classes.select("v"), width)
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    k = axes.shape[1]
    element = dict(classes.dtypes)["v"].removeprefix("array<").removesuffix(">")
    number = {"float": np.float32}.get(element, np.float64)
    raw = "v" if element in ("float", "double") else F.transform("v", lambda x: x.cast("double")).alias("v")

    # Grid cells, order, blocks.
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.names.index("v")
            cells = np.floor(_matrix(b.column(at), width) @ axes / eps).astype(np.int32)
            sizes = np.diff(b.column(at).offsets.to_numpy()).astype(np.int32)
            lists = pa.ListArray.from_arrays(np.arange(0, cells.size + 1, k, dtype=np.int32), pa.array(cells.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), lists], [*b.schema.names, "size", "c"])

    plain = classes.select(F.col("label").cast("string"), raw, F.col("id").cast("long"), "n")
    placed = plain.mapInArrow(place, ", ".join(f"{c} {t}" for c, t in plain.dtypes) + ", size int, c array<int>")
    keys = ["label", "size", *[F.col("c")[i] for i in range(k)], "id"]
    ordered = placed.select("label", "size", "id", "n", "v", "c").repartitionByRange(*keys).sortWithinPartitions(*keys)

    block_shape = "label string, size int, ids binary, ns binary, vs binary, lo array<double>, hi array<double>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            label, size = held[0][:2]
            vs = np.stack([r[4] for r in held])
            at = _unit(vs) @ axes[:size]
            ids, ns = (np.array([r[c] for r in held], np.int64).tobytes() for c in (2, 3))
            columns = [[label], [size], [ids], [ns], [vs.tobytes()], [at.min(axis=0).tolist()], [at.max(axis=0).tolist()]]
            kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["label", "size", "ids", "ns", "vs", "lo", "hi"])

        for b in batches:
            flat, ends = b.column(4).flatten().to_numpy(zero_copy_only=False).astype(number), b.column(4).offsets.to_numpy() - b.column(4).offsets[0].as_py()
            for j, (label, size, i, n) in enumerate(zip(*(b.column(c).to_pylist() for c in range(4)), strict=True)):
                if held and (held[0][:2] != (label, size) or len(held) >= block):
                    yield flush()
                held.append((label, size, i, n, flat[ends[j] : ends[j + 1]]))
        if held:
            yield flush()

    blocks = stored(ordered.mapInArrow(cut, block_shape).withColumn("block", F.monotonically_increasing_id()), "blocks")
    pairs = near_blocks(blocks.select("block", "label", "size", "lo", "hi"), eps, k)
    # A block with itself is joined where it lies. Other pairs are dealt in tiles of the square of block numbers: a block
    # goes once to each tile that has a pair of it, with the earlier blocks there that it meets, instead of once a pair.
    bits = tile_bits(block, width)
    links = pairs.where("block_a < block_b").select(F.shiftright("block_a", bits).alias("row"), F.shiftright("block_b", bits).alias("column"), "block_a", "block_b")
    ends = F.array(F.struct(F.col("block_a").alias("block"), F.lit(None).cast("long").alias("to")), F.struct(F.col("block_b").alias("block"), F.col("block_a").alias("to")))
    needed = links.select("row", "column", F.inline(ends)).groupBy("row", "column", "block").agg(F.collect_list("to").alias("to"))
    tiles = needed.join(blocks.select("block", "size", "ids", "ns", "vs"), "block").repartition("row", "column").sortWithinPartitions("row", "column", "block")

    def read(size: int, ids: bytes, ns: bytes, vs: bytes) -> tuple[np.ndarray, ...]:
        rows = _unit(np.frombuffer(vs, number).reshape(-1, size))
        return np.frombuffer(ids, np.int64), np.frombuffer(ns, np.int64), rows, rows @ axes[:size]

    def found(ids: np.ndarray, links: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some].astype(np.int64)), pa.array(ids[low[some]])], ["id", "links", "to"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                ids, ns, rows, near = read(*(c[at].as_py() for c in batch.columns))
                i, j = join_blocks(rows, rows, near, near, eps, cosine)
                i, j = i[i != j], j[i != j]
                yield found(ids, np.bincount(i, ns[j], len(ids)), _spanning(i, j, len(ids)))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = None, {}
        for batch in batches:
            for at in range(batch.num_rows):
                row, column, name, to, *own = (batch.column(c)[at].as_py() for c in ("row", "column", "block", "to", "size", "ids", "ns", "vs"))
                if tile != (row, column):
                    tile, held = (row, column), {}
                b = read(*own)
                for other in to:
                    a = held[other]
                    i, j = join_blocks(a[2], b[2], a[3], b[3], eps, cosine)
                    ids = np.concatenate([a[0], b[0]])
                    yield found(ids, np.concatenate([np.bincount(i, b[1][j], len(a[0])), np.bincount(j, a[1][i], len(b[0]))]), _spanning(i, j + len(a[0]), len(ids)))
                if name >> bits == row:
                    held[name] = b

    shape = "id long, links long, to long"
    linked = stored(blocks.select("size", "ids", "ns", "vs").mapInArrow(alone, shape).union(tiles.mapInArrow(match, shape)), "matches")
    parts = components(linked.select(F.col("id").alias("a"), F.col("to").alias("b")))
    degrees = linked.groupBy("id").agg(F.sum("links").alias("links"))
    named = classes.join(degrees, "id", "left").join(parts.withColumnRenamed("node", "id"), "id", "left")
    lowest = named.select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    if names is not None:
        lowest = lowest.join(names, F.col("component_id") == F.col("number")).select("label", "v", "n_links", F.col("name").alias("component_id"))
    lowest = stored(lowest, "found")
    drop_stored(spark, begin, 1)
    # Classes are named by their smallest id, so a component's smallest class is its smallest id.
    ok = source.join(lowest, ["label", "v"], "left")
    return ok.select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"),
        (F.col("vec_id") == F.coalesce("component_id", "vec_id")).alias("kept"),
    )


def op6_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))
