"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has 64 bits. Two fingerprints that differ in at most
``radius`` bits link. With ``radius`` 2, ``2 ** 3 - 1`` masks are built from a
linear code: bit ``i`` gets a vector ``m(i)`` of three bits, and mask ``v``
(1..7) keeps the bits with odd ``<m(i), v>``. The vectors of at most two
differing bits span at most two of three dimensions, so some ``v`` is
orthogonal to both: every pair within the radius agrees under some mask
(Pagh, "CoveringLSH", 2018). The masks are fixed, not drawn.

Buckets of up to ``small_bucket`` fingerprints are compared member by member.
In larger ones each fingerprint is written with up to half of ``radius`` of the bits
that the mask leaves out flipped: two members meet in such a variant exactly when
they differ in at most ``radius`` bits. A variant holds no more members than there
are such flips (33 or so for a radius of 2), so no bucket is ever compared pairwise
as a whole, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.common import components, drop_stored, each, so_far, stored, table

SEED = 42
SHINGLE_WORDS = 3
RADIUS = 2
SMALL_BUCKET = 24

#: Bits of each byte value, least significant first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of one text; 0 where it has no word."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        hashes = np.array([digest(b" ".join(parts), seed)], dtype=np.uint64)
    else:
        line = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(parts) - words + 1
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for every row; ``fp`` is the fingerprint as a signed long."""

    @F.arrow_udf("long")
    def fp(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            yield pa.array(np.fromiter((fingerprint(t, words) for t in each(batch)), np.uint64, len(batch)).view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), fp(F.col(text_col)).alias("fp"))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The ``2 ** (radius + 1) - 1`` masks, as unsigned 64-bit numbers."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(64)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(distinct: DataFrame, radius: int = RADIUS, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Links ``(a, b)`` between different fingerprints of ``distinct(fp)``.

    Each link joins fingerprints at most ``radius`` bits apart, and fingerprints at
    most ``radius`` bits apart are always connected by such links, but not each pair
    is listed. ``radius`` is even: two members of a large bucket meet where each
    flips half of the bits that part them.
    """
    if radius < 2 or radius % 2:
        raise ValueError("the radius is an even number of bits")
    masks = covering_masks(radius)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "key"))
    sizes = keys.groupBy("mask", "key").agg(F.count("*").alias("n"))
    met = stored(keys.join(sizes.where("n > 1"), ["mask", "key"]), "buckets")

    few = met.where(F.col("n") <= small_bucket).groupBy("mask", "key").agg(F.collect_list("fp").alias("all"))
    few = few.select(F.explode("all").alias("a"), "all")
    few = few.select("a", F.explode(F.filter("all", lambda x: (x < F.col("a")) & (F.bit_count(x.bitwiseXOR(F.col("a"))) <= radius))).alias("b"))

    left_out = [[1 << i for i in range(64) if not m >> i & 1] for m in masks]
    flips = F.array(*[F.array(*[F.lit(_signed(sum(c))) for k in range(radius // 2 + 1) for c in combinations(bits, k)]) for bits in left_out])
    many = met.where(F.col("n") > small_bucket).select("mask", "key", "fp", F.explode(F.element_at(flips, F.col("mask") + 1)).alias("flip"))
    many = many.select("mask", "key", "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("variant"))
    many = many.groupBy("mask", "variant").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("all"))
    many = many.select(F.explode("all").alias("a"), "b").where("a <> b")
    return few.union(many).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint, component_id, group, text_hash``.

    A null text is an empty one; texts without a word share fingerprint zero and
    link like any other. ``component_id`` is the smallest id that links reach, the
    own one included. Repeated rows stay repeated, and rows of one id with unlike
    texts are told apart by ``group``, a fingerprint that names the component, and
    ``text_hash``, the XXH64 of the text. A row whose id is null keeps its
    fingerprint and takes the smallest non-null id of its component (null if there
    is none). Very long texts are read whole. Other columns are ignored. An empty
    table gives an empty one.
    """
    spark = docs.sparkSession
    begin = so_far()
    marked = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    parts = components(links(classes.select("fp"), radius))
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left")
    linked = named.where(F.col("component").isNotNull())
    lowest = linked.groupBy("component").agg(F.min("first").alias("low"))
    alone = named.where(F.col("component").isNull())
    ids = linked.join(lowest, "component").select("fp", "low", "component").union(alone.select("fp", F.col("first").alias("low"), F.col("fp").alias("component")))
    done = stored(marked.join(ids, "fp"), "named")
    drop_stored(spark, begin, 1)
    code = lambda c: F.lpad(F.lower(F.hex(c)), 16, "0")
    return done.select("doc_id", code("fp").alias("fingerprint"), F.col("low").alias("component_id"), code("component").alias("group"), "text_hash")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
