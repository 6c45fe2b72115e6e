"""Ingestion as joins over tables: what is accepted, what changed, what a run did."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.functions.text import DOC_TYPE_NAMES, INJECTION_PHRASES, LAST_REVIEWED_NAMES, SENSITIVE_PATTERNS, first_pattern, first_phrase, first_present, iso_date, safe_url

SUFFIXES = ["md", "markdown"]
#: Fixed value: first path segments that are never read.
DENIED = [".git", ".github", ".env", ".envrc", ".venv", "node_modules", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".idea", ".vscode"]


# Sources ------------------------------------------------------------------


def allowed_sources(files: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files of active, listed sources, with the source's defaults; and the names that are refused."""
    active = sources.where("active").drop("active")
    return files.join(active, "source_name"), files.select("source_name").distinct().join(active, "source_name", "left_anti")


def host_check(url: Column, hosts: list[str], allow_http: bool = False) -> Column:
    """Null where a url may be read, else why not."""
    host, scheme = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), F.lower(F.regexp_extract(url, r"^([a-zA-Z]+)://", 1))
    return F.when(~host.isin(hosts) | (host == ""), "host_not_allowed").when((scheme != "https") & ~(F.lit(allow_http) & (scheme == "http")), "scheme_not_allowed")


def page_path(url: Column) -> Column:
    return F.concat(F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/:?#]+)", 1)), F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1))


def pages_as_files(pages: DataFrame, source_name: str, hosts: list[str], allow_http: bool = False, max_bytes: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """``pages(url, html)`` as files of a run, and the pages that are refused: another host or scheme, or a body over the cap.

    A page's path is its host and url path, with ``index`` for a folder and ``.md``, as
    its html goes on as text.
    """
    reason = F.coalesce(host_check(F.col("url"), hosts, allow_http), F.when(F.octet_length("html") > max_bytes, "too_large"))
    marked = pages.withColumn("_reason", reason)
    path = F.concat(F.regexp_replace(page_path(F.col("url")), "/$", "/index"), F.lit(".md"))
    files = marked.where("_reason is null and html is not null").select(F.lit(source_name).alias("source_name"), path.alias("path"), F.octet_length("html").cast("long").alias("size_bytes"), F.encode("html", "UTF-8").alias("content"))
    return files, marked.where("_reason is not null").select("url", F.col("_reason").alias("reason"))


def default_walk(path: Column) -> Column:
    """What diagnostics read of a tree: Markdown files, nothing below hidden folders or tool folders."""
    return matches_globs(path, ["**/*.md"], []) & ~F.exists(F.split(path, "/"), lambda s: s.startswith(".") | s.isin("node_modules", "__pycache__"))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ``**/`` any folders, ``*`` and ``?`` within a segment."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            c = glob[i]
            out, i = out + ("[^/]*" if c == "*" else "[^/]" if c == "?" else re.sub(r"(\W)", r"\\\1", c)), i + 1
    return f"^{out}$"


def matches_globs(path: Column, include: list[str], exclude: list[str]) -> Column:
    some = lambda globs: F.lit(False) if not globs else path.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))
    return some(include) & ~some(exclude)


def denied(path: Column) -> Column:
    parts = F.split(path, "/")
    return parts[0].isin(DENIED) | F.exists(parts, lambda s: s.startswith(".") & ~s.isin(".", ".."))


def skip_reason(path: Column, size: Column, include: list[str], exclude: list[str], max_bytes: int, valid: Column | None = None) -> Column:
    """Why a file is not read, by the first check that fails; null where it is."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = F.when(denied(path) | ~matches_globs(path, include, exclude), "excluded_by_pattern").when(~suffix.isin(SUFFIXES), "unsupported_file_type").when(size > max_bytes, "too_large")
    return out if valid is None else out.when(~valid, "binary_content")


def over_caps(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """``source_name, reason`` for sources whose accepted files exceed a cap; such a source is not read at all."""
    sums = files.groupBy("source_name").agg(F.count("*").alias("n_files"), F.sum("size_bytes").alias("n_bytes"))
    return sums.withColumn("reason", F.when(F.col("n_bytes") > max_bytes, "max_repo_bytes").when(F.col("n_files") > max_files, "max_files")).where("reason is not null")


def resolved(files: DataFrame) -> DataFrame:
    """Document columns from front matter (``metadata``), filled up from the source's defaults."""
    m = lambda *names: first_present(F.col("metadata"), list(names))
    return files.select(
        "source_name",
        "path",
        F.coalesce(m("title"), F.col("path")).alias("title"),
        F.coalesce(m("status"), F.col("default_status")).alias("status"),
        F.coalesce(m("owner"), F.col("default_owner")).alias("owner"),
        F.coalesce(m("authority"), F.col("default_authority")).alias("authority"),
        F.coalesce(m("sensitivity"), F.col("default_sensitivity")).alias("sensitivity"),
        m(*DOC_TYPE_NAMES).alias("doc_type"),
        iso_date(m(*LAST_REVIEWED_NAMES)).alias("last_reviewed"),
        safe_url(m("source_url")).alias("source_url"),
    )


def stamped(chunks: DataFrame, phrases: list[str] = INJECTION_PHRASES, patterns: list[str] = SENSITIVE_PATTERNS) -> DataFrame:
    """Chunks with the phrase and the pattern that they contain, and flags."""
    out = chunks.withColumn("injection_phrase", first_phrase(F.col("content"), phrases)).withColumn("sensitive_pattern", first_pattern(F.col("content"), patterns))
    return out.withColumn("has_prompt_injection", F.col("injection_phrase").isNotNull()).withColumn("has_sensitive_content", F.col("sensitive_pattern").isNotNull())


# Merges -------------------------------------------------------------------


def merged(old: DataFrame, new: DataFrame, keys: list[str], old_wins: bool = False, keep_missing: bool = True) -> DataFrame:
    """Upsert of one snapshot into another by key; a new row replaces the old one whole.

    With ``old_wins`` existing values stay and only nulls and new keys are filled.
    Rows without a counterpart in ``new`` stay unless ``keep_missing`` is off. Keys are
    not null and unique on either side.
    """
    rest = [c for c in old.columns if c not in keys]
    a = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in rest], F.lit(True).alias("_a"))
    b = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_b"))
    both = a.join(b, keys, "full" if keep_missing else "right")
    if old_wins:
        cols = [F.coalesce(f"_old_{c}", f"_new_{c}").alias(c) for c in rest]
    else:
        cols = [F.when(F.col("_b"), F.col(f"_new_{c}")).otherwise(F.col(f"_old_{c}")).alias(c) for c in rest]
    return both.select(*keys, *cols)


def chunk_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """``document_id, chunk_index, change``: unchanged, changed, new or orphan, by content hash."""
    keys = ["document_id", "chunk_index"]
    both = old.select(*keys, F.col("content_hash").alias("a")).join(new.select(*keys, F.col("content_hash").alias("b")), keys, "full")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "orphan").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return both.select(*keys, change.alias("change"))


def orphans(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_anti")


def to_embed(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks without a vector for their present content."""
    return chunks.join(embeddings.select("chunk_id", "content_hash"), ["chunk_id", "content_hash"], "left_anti")


# What a run did -----------------------------------------------------------


def skip_histogram(files: DataFrame) -> DataFrame:
    """``source_name, skipped``: how many files each reason kept out."""
    counts = files.where("reason is not null").groupBy("source_name", "reason").agg(F.count("*").alias("n"))
    return counts.groupBy("source_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("skipped"))


def run_status(n_errors: Column, n_done: Column) -> Column:
    return F.when(n_errors == 0, "succeeded").when(n_done > 0, "partial").otherwise("failed")


def run_summary(files: DataFrame, changes: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """One row per source: counters over files, chunk changes and, if given, ``vectors(source_name, outcome)``, and the run's status.

    A vector's outcome is ``created``, ``unchanged`` or ``failed``.
    """
    a = files.groupBy("source_name").agg(F.count("*").alias("files_scanned"), F.count_if(F.col("reason").isNull()).alias("files_indexed"), F.count_if(F.col("reason").isNotNull()).alias("files_skipped"), F.count_if(F.col("reason") == "binary_content").alias("errors"))
    b = changes.groupBy("source_name").agg(
        F.count_if(F.col("change").isin("new", "changed")).alias("chunks_created"),
        F.count_if(F.col("change") == "unchanged").alias("chunks_unchanged"),
        F.count_if(F.col("change") == "orphan").alias("chunks_deleted"),
        F.count_if("flagged").alias("chunks_flagged"),
    )
    out = a.join(b, "source_name", "left")
    if vectors is not None:
        c = vectors.groupBy("source_name").agg(*[F.count_if(F.col("outcome") == x).alias(f"embeddings_{x}") for x in ("created", "unchanged", "failed")])
        out = out.join(c, "source_name", "left")
    out = out.na.fill(0)
    return out.withColumn("status", run_status(F.col("errors"), F.col("files_indexed")))
