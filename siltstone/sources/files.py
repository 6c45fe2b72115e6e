"""Files and tables as sources, reports as sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, root: str, source_name: str, commit_sha: str | None = None) -> DataFrame:
    """``source_name, path, size_bytes, content, commit_sha`` of all files below a folder, sorted by path where it matters.

    A checked-out tree is a folder with a commit. The content column is only read
    by plans that use it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = F.regexp_replace(F.lit(root), r"^[a-z]+:/*|/+$", "")
    tail = F.regexp_replace("path", r"^[a-z]+:/*", "")
    relative = F.expr("substring(_tail, length(_base) + 2)")
    out = files.withColumn("_base", F.regexp_replace(base, "^/*", "")).withColumn("_tail", F.regexp_replace(tail, "^/*", ""))
    return out.select(F.lit(source_name).alias("source_name"), relative.alias("path"), F.col("length").alias("size_bytes"), "content", F.lit(commit_sha).cast("string").alias("commit_sha"))


def decoded(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files as text, and those that are no UTF-8 with reason ``binary_content``."""
    ok = F.is_valid_utf8(F.col("content"))
    return files.where(ok).withColumn("text", F.decode("content", "UTF-8")).drop("content"), files.where(~ok).select("source_name", "path", F.lit("binary_content").alias("reason"))


GOLDEN_VERSION = 1


def golden_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Cases and expected hits from JSON lines, one case a line."""
    shape = "version int, case_id string, query string, notes string, expected array<struct<repo: string, path: string, heading_path: array<string>, must_appear_within_k: int>>"
    rows = spark.read.schema(shape).json(path)
    hits = rows.select("case_id", F.posexplode("expected").alias("hit_idx", "h")).select("case_id", "hit_idx", "h.repo", "h.path", F.coalesce("h.heading_path", F.array().cast("array<string>")).alias("heading_path"), F.coalesce("h.must_appear_within_k", F.lit(10)).alias("must_appear_within_k"))
    return rows.select("case_id", "query", "notes"), hits


def golden_file_errors(spark: SparkSession, path: str) -> DataFrame:
    """``line, error`` for lines of a golden set that are no case: broken JSON, another version, keys that are missing or of another kind."""
    hit = "struct<repo: string, path: string, heading_path: string, must_appear_within_k: string>"
    lines = spark.read.text(path).where(F.trim("value") != "")
    v = F.parse_json(F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(F.lit("null")))
    key = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    whole = F.schema_of_variant(v)
    raw = lambda c: F.from_json(F.get_json_object("value", "$.expected"), f"array<{hit}>")  # noqa: E731, ARG005
    bad_hit = F.exists(raw("value"), lambda h: h["repo"].isNull() | h["path"].isNull() | (h["repo"] == "") | (h["path"] == ""))
    bad_heading = F.exists(raw("value"), lambda h: h["heading_path"].isNotNull() & ~h["heading_path"].rlike(r'^\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]$'))
    bad_k = F.exists(raw("value"), lambda h: h["must_appear_within_k"].isNotNull() & ~F.coalesce(h["must_appear_within_k"].try_cast("int") > 0, F.lit(False)))
    errors = F.array_compact(
        F.array(
            F.when(~F.startswith(whole, F.lit("OBJECT")), "no_object"),
            F.when(F.coalesce(key("version", "int"), F.lit(GOLDEN_VERSION)) != GOLDEN_VERSION, "unknown_version"),
            *[F.when(F.startswith(whole, F.lit("OBJECT")) & (F.coalesce(F.trim(key(c, "string")), F.lit("")) == ""), f"missing_{c}") for c in ("case_id", "query")],
            F.when(F.coalesce(bad_hit, F.lit(False)), "missing_path"),
            F.when(F.coalesce(bad_heading, F.lit(False)), "heading_path_no_list_of_strings"),
            F.when(F.coalesce(bad_k, F.lit(False)), "k_not_positive"),
        )
    )
    return lines.select(F.col("value").alias("line"), F.explode(errors).alias("error"))


def write_json_report(df: DataFrame, path: str, digits: int = 4) -> None:
    rounded = [F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    df.select(*rounded).coalesce(1).write.mode("overwrite").json(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_log(df: DataFrame, path: str, time: str = "created_at") -> None:
    """Appends telemetry rows, partitioned by day."""
    df.withColumn("day", F.to_date(time)).write.mode("append").partitionBy("day").parquet(path)
