"""One ingestion run over all sources in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import markdown, providers
from siltstone.operators import ingest
from siltstone.sources.snapshots import Store
from siltstone.sources.storage import run as storage_run
from siltstone.sources.storage import stored as stored_table


@dataclass(frozen=True)
class Limits:
    include: tuple = ("**/*",)
    exclude: tuple = ()
    max_file_bytes: int = 1 << 20
    max_files: int = 10_000
    max_source_bytes: int = 1 << 30
    max_tokens: int = markdown.MAX_TOKENS


@dataclass(frozen=True)
class Snapshot:
    """What is stored: ``documents``, ``chunks``, ``embeddings``."""

    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame


@dataclass(frozen=True)
class Delta:
    """What a run changes: rows that are new or differ, and keys of what goes."""

    documents: DataFrame
    chunks: DataFrame
    embeddings: DataFrame
    gone_documents: DataFrame  # document_id
    gone_chunks: DataFrame  # document_id, chunk_index, chunk_id


@dataclass(frozen=True)
class Outcome:
    snapshot: Snapshot
    skipped: DataFrame
    changes: DataFrame
    summary: DataFrame
    delta: Delta


CHUNKS = "document_id string, chunk_index int, chunk_id string, heading_path array<string>, content string, content_tokens int, content_hash string, has_prompt_injection boolean, has_sensitive_content boolean"
DOCUMENTS = "document_id string, source_name string, path string, title string, status string, owner string, authority string, sensitivity string, doc_type string, last_reviewed date, source_url string"
EMBEDDINGS = "chunk_id string, content_hash string, embedding array<float>, error string, model string, dimensions int"


def empty(spark) -> Snapshot:
    return Snapshot(spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], CHUNKS), spark.createDataFrame([], EMBEDDINGS))


def run_sources(files: DataFrame, sources: DataFrame, stored: Snapshot, embedder, limits: Limits = Limits(), phrases: list[str] | None = None, patterns: list[str] | None = None, prune_missing: bool = False) -> Outcome:
    """Ingests ``files(source_name, path, size_bytes, content)`` of the allowed sources into a snapshot.

    Files are checked in order, sources over a cap are left out whole, documents are
    parsed, chunks stamped, compared with what is stored, merged, and embedded where
    their content is new. Orphan chunks of documents that were read go. Documents
    whose files are gone stay unless ``prune_missing``: then those of the sources in
    this run go whose path was not among its files at all. A file that was skipped
    or did not parse, and a source that was left out or not in the run, keeps what is stored.
    """
    allowed, _ = ingest.allowed_sources(files, sources)
    checked = allowed.withColumn("reason", ingest.skip_reason(F.col("path"), F.col("size_bytes"), list(limits.include), list(limits.exclude), limits.max_file_bytes, F.is_valid_utf8("content")))
    accepted = checked.where("reason is null")
    capped = ingest.over_caps(accepted, limits.max_files, limits.max_source_bytes)
    accepted = accepted.join(capped.select("source_name"), "source_name", "left_anti")
    ids = F.sha2(F.concat("source_name", F.lit("\x1f"), "path"), 256)
    texts = accepted.withColumn("document_id", ids).withColumn("text", F.decode("content", "UTF-8"))
    # Parsed once: documents, chunks and errors all come from it.
    parsed = stored_table(markdown.parse_documents(texts, ["document_id", "source_name", "path"], limit=limits.max_tokens), "parsed")
    errors = parsed.where("error is not null").select("source_name", "path", F.col("error").alias("reason"))
    good = parsed.where("error is null")

    defaults = sources.where("active").drop("active")
    fields = F.transform_values(F.from_json("metadata", "map<string,string>"), lambda _, v: v)
    named = good.withColumn("metadata", fields).join(defaults, "source_name")
    found_title = good.select("document_id", F.col("title").alias("_title"))
    docs = ingest.resolved(named.select("source_name", "document_id", "metadata", F.col("path"), *[c for c in defaults.columns if c != "source_name"]))
    docs = docs.withColumn("document_id", ids).join(found_title, "document_id").withColumn("title", F.coalesce("_title", "path")).drop("_title")

    chunks = markdown.chunks_of(good, ["document_id"]).withColumn("chunk_id", F.sha2(F.concat("document_id", F.lit("\x1f"), F.col("chunk_index").cast("string")), 256))
    chunks = ingest.stamped(chunks, phrases or ingest.INJECTION_PHRASES, patterns or ingest.SENSITIVE_PATTERNS).drop("injection_phrase", "sensitive_pattern").select(*stored.chunks.columns)

    read = docs.select("document_id")
    before = stored.chunks.join(read, "document_id", "left_semi")
    changes = ingest.chunk_diff(before, chunks).join(docs.select("document_id", "source_name"), "document_id")
    flags = chunks.select("document_id", "chunk_index", (F.col("has_prompt_injection") | F.col("has_sensitive_content")).alias("flagged"))
    changes = changes.join(flags, ["document_id", "chunk_index"], "left")

    kept = stored.documents
    gone = kept.select("document_id").limit(0)
    if prune_missing:
        walked = checked.select("source_name").distinct().join(capped.select("source_name"), "source_name", "left_anti")
        there = checked.select(ids.alias("document_id"))
        gone = kept.join(walked, "source_name", "left_semi").join(there, "document_id", "left_anti").select("document_id")
        kept = kept.join(gone, "document_id", "left_anti")
    all_docs = ingest.merged(kept, docs.select(*stored.documents.columns), ["document_id"])
    rest = stored.chunks.join(read, "document_id", "left_anti").join(kept.select("document_id"), "document_id", "left_semi")
    all_chunks = rest.unionByName(chunks)
    # Stored: what a model has made is read by the vectors and by the counters.
    new = stored_table(providers.embedded(ingest.to_embed(chunks, stored.embeddings.where("error is null")), embedder), "vectors")
    vectors = ingest.merged(stored.embeddings, new.select(*stored.embeddings.columns), ["chunk_id"]).join(all_chunks.select("chunk_id"), "chunk_id", "left_semi")

    skipped = checked.where("reason is not null").select("source_name", "path", "reason").unionByName(errors)
    marks = checked.select("source_name", "path", F.col("reason").alias("_first")).join(skipped, ["source_name", "path"], "left")
    outcomes = chunks.select("chunk_id", "document_id").join(new.select("chunk_id", F.col("error").alias("_error"), F.lit(True).alias("_new")), "chunk_id", "left").join(docs.select("document_id", "source_name"), "document_id")
    outcomes = outcomes.select("source_name", F.when(F.col("_new").isNull(), "unchanged").when(F.col("_error").isNull(), "created").otherwise("failed").alias("outcome"))
    summary = ingest.run_summary(marks, changes, outcomes).join(capped.select("source_name", F.col("reason").alias("cap")), "source_name", "left")
    summary = summary.withColumn("status", F.when(F.col("cap").isNotNull(), "failed").otherwise(F.col("status")))
    orphans = before.join(chunks.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_anti")
    lost = orphans.unionByName(stored.chunks.join(gone, "document_id", "left_semi")).select("document_id", "chunk_index", "chunk_id")
    delta = Delta(docs.select(*stored.documents.columns).exceptAll(stored.documents), chunks.exceptAll(before.select(*chunks.columns)), new.select(*stored.embeddings.columns), gone, lost)
    return Outcome(Snapshot(all_docs, all_chunks, vectors), skipped, changes, summary, delta)


def stored_snapshot(store: Store) -> Snapshot:
    """What the store holds; empty tables before the first run."""
    if "documents" not in store.manifest()["tables"]:
        return empty(store.spark)
    return Snapshot(*(store.read(name) for name in ("documents", "chunks", "embeddings")))


def run_into(store: Store, files: DataFrame, sources: DataFrame, embedder, limits: Limits = Limits(), stream: str = "ingest", batch: int | None = None, n_buckets: int = 64, **more) -> int | None:
    """``run_sources`` on what a store holds, and its changes into the store: one version for all tables, and for the run's summary.

    Only buckets of documents and chunks that change are rewritten. A ``batch`` of a
    ``stream`` that is in the store already returns None and does nothing; a run
    that ends before its commit leaves the version before, and may run again. ``runs``
    gets a row per source and run, ``run`` is the version that holds it.
    """
    change = store.begin(stream if batch is not None else None, batch)
    if change is None:
        return None
    with storage_run(store.spark):
        if "documents" not in change.tables:
            made = empty(store.spark)
            change.create("documents", made.documents, ["document_id"], n_buckets=n_buckets)
            change.create("chunks", made.chunks, ["document_id", "chunk_index"], ["document_id"], n_buckets)
            change.create("embeddings", made.embeddings, ["chunk_id"], n_buckets=n_buckets)
        now = Snapshot(*(store._read(change.tables[name], None, False) for name in ("documents", "chunks", "embeddings")))
        out = run_sources(files, sources, now, embedder, limits, **more)
        # Each change is read for its buckets and for its rows.
        lost = stored_table(out.delta.gone_chunks, "gone-chunks")
        change.merge("documents", stored_table(out.delta.documents, "new-documents"), out.delta.gone_documents)
        change.merge("chunks", stored_table(out.delta.chunks, "new-chunks"), lost.select("document_id", "chunk_index"))
        change.merge("embeddings", out.delta.embeddings, lost.select("chunk_id"))
        summary = out.summary.withColumn("run", F.lit(change.base["version"] + 1))
        if "runs" in change.tables:
            change.append("runs", summary)
        else:
            change.create("runs", summary, ["source_name", "run"], n_buckets=1)
        return change.commit()


def reembedded(chunks: DataFrame, embedder, dry_run: bool = False) -> DataFrame:
    """All chunks embedded anew, whatever is stored; a dry run only counts them."""
    return chunks.agg(F.count("*").alias("would_embed")) if dry_run else providers.embedded(chunks, embedder)
