"""A training corpus from raw documents, in five stages that each read what the one before wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import decontamination, line_dedup, packing, quality, simhash
from siltstone.llm.common import by_position, drop_stored, so_far, stored, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of 0.3 or more).

    Each row is judged by itself, by its whole text however long: rows with a null id,
    repeated rows and empty texts stay or go by their score. All columns stay as they
    are, whatever their names. An empty table gives an empty one.
    """
    name = _new(docs, "score")
    out = quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")), score_col=name)
    return out.where(F.col(name) >= quality.THRESHOLD).select(*[_column(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document holds.

    Null ids and texts, and empty texts, are left alone; very long texts are read whole.
    All columns stay, whatever their names; ``n_chars`` follows the text where that
    has changed. An empty table gives an empty one.
    """
    name = _new(docs, "lines_removed")
    return _with_length(line_dedup.deduplicated(docs, count_col=name), docs, name)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one that names it.

    Rows that share an id but not a group are no copies and all stay; of rows that
    share id and text one stays. Rows with a null id stay. Empty and null texts are
    copies of each other; very long texts are read whole. An empty table gives an
    empty one.
    """
    found = simhash.near_duplicates(docs).where("doc_id is not null")
    named = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_hash")).alias("one")).select(F.col("one.doc_id").alias("kept_id"), F.col("one.text_hash").alias("kept_hash"))
    own, names = by_position(docs)
    i, x = (F.col(own.columns[names.index(c)]) for c in ("doc_id", "text"))
    own = own.withColumn("hash", F.xxhash64(x))
    # Neither side has a bound, so none is broadcast.
    one = own.join(named.hint("merge"), (i == F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    one = one.dropDuplicates([own.columns[names.index("doc_id")], "hash"]).union(own.where(i.isNull()))
    return one.drop("hash").toDF(*names)


def cut_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words that test phrases hit.

    Null and empty texts are left alone, rows with null ids and repeated ones are cut as
    others are, very long texts are searched whole. All columns stay, whatever their
    names; ``n_chars`` follows the text where that has changed. An empty table gives an
    empty one.
    """
    name = _new(docs, "words_cut")
    return _with_length(decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"), count_col=name), docs, name)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, and where they lie in the sequences. A null text is an empty one."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


def _new(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def _with_length(out: DataFrame, docs: DataFrame, changed: str) -> DataFrame:
    """The columns of ``docs``; ``n_chars`` is the text's where ``changed`` is more than 0."""
    n = F.when(F.col(changed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars") if "n_chars" in docs.columns else None
    return out.select(*[n if c == "n_chars" else _column(c) for c in docs.columns])


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", cut_benchmark_passages),
    ("packing", pack),
]

#: SQL can express neither the scores, the fingerprints nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, from ``documents``. Each result is stored, and what only led to it is deleted."""
    begin = so_far()
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
            drop_stored(spark, begin, 1)
    return docs
