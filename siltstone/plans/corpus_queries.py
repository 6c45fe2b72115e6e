"""Registered queries over functions, filters, ingestion and reports, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import markdown, providers, scoring, text
from siltstone.operators import evaluation, ingest, search, telemetry
from siltstone.plans.search_queries import _STEPS, CONFIG, PATTERNS, PHRASES
from siltstone.sources import corpus
from siltstone.streaming import jobs

T = corpus.table
DAY = f"DATE '{corpus.AS_OF}'"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


# Filters --------------------------------------------------------------------


def filter_documents(spark, sf):
    docs = search.filtered(corpus.documents_view(spark, sf), status=["active", "approved"], doc_type=["guide", "adr"], repo=None, path_prefix=["doc-1", "doc-2"], controls=["AC-1", "AC-3", "SC-0"], tags=["en", "t3"], last_reviewed_after="2023-06-01")
    return docs.select("document_id", "repo", "path", "status", "doc_type", "last_reviewed")


SQL_FILTER = (
    _with(corpus.SQL_DOCUMENTS)
    + """SELECT document_id, repo, path, status, doc_type, last_reviewed FROM docs
WHERE status IN ('active', 'approved') AND doc_type IN ('guide', 'adr') AND (starts_with(path, 'doc-1') OR starts_with(path, 'doc-2'))
  AND list_has_any(controls, ['AC-1', 'AC-3', 'SC-0']) AND list_has_any(tags, ['en', 't3']) AND last_reviewed >= DATE '2023-06-01'"""
)


def filter_requests(spark, sf):
    """A table of filters, one row a request, against documents: lists are columns, null means no constraint, an empty list nothing.

    Requests with the same filters are answered once, from documents counted by what the filters read.
    """
    r = T(spark, sf, "events").select(
        "event_id",
        F.when(F.col("user_id") % 5 == 0, F.array().cast("array<string>")).when(F.col("user_id") % 5 == 1, F.lit(None)).otherwise(F.array(F.lit("active"), F.lit("draft"))).alias("statuses"),
        F.when(F.col("user_id") % 2 == 0, F.array(F.lit("guide"))).alias("types"),
    )
    r = r.withColumn("filter", F.to_json(F.struct("statuses", "types")))
    docs = corpus.documents_view(spark, sf).groupBy("status", "doc_type").agg(F.count("*").alias("n"))
    counts = docs.groupBy(F.lit(1).alias("one")).agg(F.collect_list(F.struct("status", "doc_type", "n")).alias("counts"))  # one row: an entry for each pair of a status and a type
    fits = lambda x: (F.col("statuses").isNull() | F.array_contains("statuses", x["status"])) & (F.col("types").isNull() | F.array_contains("types", x["doc_type"]))
    asked = r.groupBy("filter").agg(F.first("statuses").alias("statuses"), F.first("types").alias("types")).withColumn("one", F.lit(1)).join(F.broadcast(counts), "one")  # one row, of known statuses and types
    answered = asked.select("filter", F.aggregate(F.filter("counts", fits), F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n_documents"))
    return r.join(answered, "filter").select("event_id", "n_documents")


SQL_FILTER_REQUESTS = (
    _with(corpus.SQL_DOCUMENTS)
    + """, r AS (SELECT event_id, user_id % 10 AS f, CASE WHEN user_id % 5 = 0 THEN [] WHEN user_id % 5 = 1 THEN NULL ELSE ['active', 'draft'] END AS statuses, CASE WHEN user_id % 2 = 0 THEN ['guide'] END AS types FROM events),
fs AS (SELECT f, any_value(statuses) AS statuses, any_value(types) AS types FROM r GROUP BY f),
fn AS (SELECT f, count(document_id) AS n_documents FROM fs LEFT JOIN docs ON (statuses IS NULL OR list_contains(statuses, status)) AND (types IS NULL OR list_contains(types, doc_type)) GROUP BY f)
SELECT event_id, n_documents FROM r JOIN fn USING (f)"""
)


def tagged_chunks(spark, sf):
    """Chunks with a tag of their own, by their number, or one of their document."""
    chunks = corpus.chunks_view(spark, sf).withColumn("tags", F.array(F.concat(F.lit("c"), (F.col("chunk_index") % 5).cast("string"))))
    return search.tagged(chunks, corpus.documents_view(spark, sf), ["c3", "t2"]).select("chunk_id", "document_id")


SQL_TAGGED = _with(corpus.SQL_DOCUMENTS, corpus.SQL_CHUNKS) + "SELECT chunk_id, document_id FROM chunks JOIN docs USING (document_id) WHERE chunk_index % 5 = 3 OR list_contains(tags, 't2')"


def json_overlap(spark, sf):
    docs = corpus.documents_view(spark, sf).withColumn("metadata", F.to_json(F.struct("controls", F.col("owner").alias("controls_owner"))))
    both = search.json_overlaps(F.col("metadata"), "controls", ["AC-2", "SC-5"]) | search.json_overlaps(F.col("metadata"), "controls_owner", ["data-team"])
    return docs.where(both).select("document_id", "owner")


def rejected_queries(spark, sf):
    turns = T(spark, sf, "conversations").where("role = 'user'")
    cleaned, removed = text.stripped_query(F.col("text"), PHRASES)
    reason = F.coalesce(search.request_error(F.col("text"), max_results=F.col("turn") * 12 + 1, max_chunks=F.col("turn") * 9 + 6, max_tokens=F.col("turn") * 6400 + 99), F.when(F.trim(cleaned) == "", "empty_after_stripping"))
    return turns.select("conv_id", "turn", reason.alias("reason"), F.array_join(removed, ",").alias("removed"), F.md5(cleaned).alias("cleaned_md5"))


_STRIP = "text"
for _p in PHRASES:
    _STRIP = f"regexp_replace({_STRIP}, '(?i)\\b{_p}\\b', '', 'g')"
_REMOVED = "concat_ws(',', " + ", ".join(f"CASE WHEN {a} <> {b} THEN '{p}' END" for p, a, b in zip(PHRASES, _STEPS, _STEPS[1:], strict=False)) + ")"
SQL_REJECTED = f"""WITH t AS (SELECT *, {_REMOVED} AS removed, trim(regexp_replace({_STRIP}, '\\s+', ' ', 'g')) AS stripped FROM conversations WHERE role = 'user'),
c AS (SELECT *, CASE WHEN removed <> '' THEN stripped ELSE text END AS cleaned FROM t)
SELECT conv_id, turn, CASE WHEN coalesce(length(text), 0) < 1 THEN 'empty' WHEN length(text) > 4096 THEN 'too_long' WHEN turn * 12 + 1 NOT BETWEEN 1 AND 50 THEN 'max_results_out_of_range' WHEN turn * 9 + 6 NOT BETWEEN 1 AND 50 THEN 'max_chunks_out_of_range' WHEN turn * 6400 + 99 NOT BETWEEN 100 AND 32000 THEN 'max_tokens_out_of_range' WHEN trim(cleaned) = '' THEN 'empty_after_stripping' END AS reason, removed, md5(cleaned) AS cleaned_md5 FROM c"""


def newest_events(spark, sf):
    return search.newest(search.equals(T(spark, sf, "events"), event_type="error", user_id=None), "ts", 50, F.lit("2024-01-10").cast("timestamp"), "event_id").select("event_id", "ts", "user_id")


def rail_filters(spark, sf):
    """Filter forms of a web page, one for each event."""
    i = F.col("event_id")
    forms = T(spark, sf, "events").select(
        "event_id",
        F.when(i % 4 == 0, F.array(F.lit("draft"), F.lit("bogus"))).when(i % 4 == 1, F.array(F.lit("bogus"))).when(i % 4 == 2, F.array().cast("array<string>")).alias("status"),
        F.when(i % 3 == 0, F.concat(F.lit(" src"), (i % 5).cast("string"), F.lit(" ,, src9 "))).when(i % 3 == 1, "  ").alias("repo"),
        F.when(i % 5 < 3, F.concat(F.lit("team-"), F.col("user_id").cast("string"))).alias("owner"),
        F.lit(None).cast("string").alias("tags"),
        F.when(i % 7 == 0, "2024-02-30").when(i % 7 == 1, "2024-02-03").alias("last_reviewed_after"),
    )
    out = search.web_filters(forms, list(scoring.STATUS_GLOSS))
    return out.select("event_id", F.array_join("status", "|").alias("statuses"), F.array_join("repo", "|").alias("repos"), F.array_join("owner", "|").alias("owners"), "last_reviewed_after", "n_active")


SQL_RAIL = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'draft' WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'active|approved' END AS statuses, CASE WHEN event_id % 3 = 0 THEN 'src' || (event_id % 5) || '|src9' END AS repos,
  CASE WHEN event_id % 5 < 3 THEN 'team-' || user_id END AS owners, CASE WHEN event_id % 7 = 1 THEN DATE '2024-02-03' END AS last_reviewed_after,
  ((event_id % 4 <> 3)::INT + (event_id % 3 = 0)::INT + (event_id % 5 < 3)::INT + (event_id % 7 = 1)::INT)::BIGINT AS n_active FROM events"""


# Scalars --------------------------------------------------------------------


def scalar_text(spark, sf):
    d = corpus.documents_view(spark, sf)
    c = F.col("text")
    return d.select(
        "document_id",
        text.content_hash(c).alias("content_hash"),
        F.size(text.white_space_tokens(c)).cast("long").alias("n_words"),
        text.first_phrase(c, PHRASES).alias("phrase"),
        text.first_pattern(c, PATTERNS).alias("pattern"),
        text.safe_url(F.col("source_url")).alias("url"),
        text.iso_date(F.concat(F.lit("2024-"), F.lpad((F.col("document_id") % 14).cast("string"), 2, "0"), F.lit("-30"))).alias("day"),
        text.uuid_or_null(F.when(F.col("document_id") % 3 == 0, F.lit("0A1b2C3d-0000-4000-8000-00000000000F")).otherwise(F.lit("nope"))).alias("uuid"),
        text.opaque_header(F.concat(F.lit("  req "), F.col("path"), F.lit("/é "))).alias("header"),
        text.citation_key(F.col("repo"), F.col("path"), F.array("doc_type", "authority")).alias("citation"),
        text.model_prefix(F.lit("intfloat/e5-small-v2"), F.col("title"), False).alias("prefixed"),
        text.cache_key(F.lit("m"), F.lower("title")).alias("cache_key"),
        text.request_hash({"q": F.col("title"), "k": F.col("document_id")}).alias("body_hash"),
    )


SQL_SCALAR_TEXT = (
    _with(corpus.SQL_DOCUMENTS)
    + """SELECT document_id, 'sha256:' || sha256(text) AS content_hash, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS n_words,
  CASE WHEN lower(text) LIKE '%of the%' THEN 'of the' WHEN lower(text) LIKE '%on the%' THEN 'on the' WHEN lower(text) LIKE '%that in%' THEN 'that in' END AS phrase,
  CASE WHEN regexp_matches(text, '[0-9]{4,}') THEN '[0-9]{4,}' WHEN regexp_matches(text, '[a-z]{14,}') THEN '[a-z]{14,}' END AS pattern,
  CASE WHEN regexp_matches(trim(source_url), '(?i)^https?://[^/?#]+') THEN trim(source_url) END AS url,
  TRY_CAST('2024-' || lpad((document_id % 14)::VARCHAR, 2, '0') || '-30' AS DATE) AS day,
  CASE WHEN document_id % 3 = 0 THEN '0a1b2c3d-0000-4000-8000-00000000000f' END AS uuid,
  nullif(regexp_replace(substr(trim('  req ' || path || '/é '), 1, 200), '[^A-Za-z0-9._-]', '_', 'g'), '') AS header,
  repo || '/' || path || '#' || doc_type || '/' || authority AS citation, 'query: ' || title AS prefixed, sha256('m' || chr(31) || lower(title)) AS cache_key,
  sha256('{"k":' || document_id || ',"q":"' || title || '"}') AS body_hash FROM docs"""
)


def scalar_scores(spark, sf):
    day = F.lit(corpus.AS_OF).cast("date")
    d = corpus.documents_view(spark, sf).withColumn("score", (F.col("document_id") % 101) / 100.0)
    return d.select(
        "document_id",
        scoring.status_weight(F.col("status")).alias("weight"),
        F.round(scoring.freshness_factor(F.col("last_reviewed"), day, 365), 9).alias("freshness"),
        F.round(scoring.boosted(F.col("score"), F.col("status"), F.col("last_reviewed"), day, CONFIG), 9).alias("boosted"),
        F.round(scoring.boosted(F.col("score"), F.col("status"), F.col("last_reviewed"), day, scoring.RankingConfig(stale_after_days=None)), 9).alias("boosted_undated"),
        scoring.score_tier(F.col("score")).cast("long").alias("tier"),
        scoring.freshness_bucket(F.col("last_reviewed"), day).alias("bucket"),
    )


_WEIGHT = "CASE status WHEN 'active' THEN 1.0 WHEN 'approved' THEN 0.95 WHEN 'draft' THEN 0.5 WHEN 'deprecated' THEN 0.2 WHEN 'archived' THEN 0.1 WHEN 'superseded' THEN 0.05 ELSE 1.0 END::DOUBLE"
_FRESH = f"CASE WHEN last_reviewed IS NULL THEN 0.3 WHEN {DAY} - last_reviewed <= 365 THEN 1.0 ELSE greatest(0.3, 1 - 0.7::DOUBLE * least(1.0, ({DAY} - last_reviewed - 365) / 365.0::DOUBLE)) END::DOUBLE"
SQL_SCALAR_SCORES = (
    _with(corpus.SQL_DOCUMENTS)
    + f""", s AS (SELECT *, (document_id % 101) / 100.0::DOUBLE AS score FROM docs)
SELECT document_id, {_WEIGHT} AS weight, round({_FRESH}, 9) AS freshness, round(score * {_WEIGHT} * {_FRESH}, 9) AS boosted, round(score * {_WEIGHT}, 9) AS boosted_undated,
  CASE WHEN score >= 0.85 THEN 5 WHEN score >= 0.65 THEN 4 WHEN score >= 0.5 THEN 3 WHEN score >= 0.46 THEN 2 ELSE 1 END::BIGINT AS tier,
  CASE WHEN last_reviewed IS NULL THEN NULL WHEN {DAY} - last_reviewed < 0 THEN 'stale' WHEN {DAY} - last_reviewed < 180 THEN 'fresh' WHEN {DAY} - last_reviewed < 365 THEN 'recent' WHEN {DAY} - last_reviewed < 730 THEN 'aging' ELSE 'stale' END AS bucket FROM s"""
)


def expansion_gate(spark, sf):
    q = T(spark, sf, "conversations").where("role = 'user'").withColumn("q", F.col("text"))
    return q.select("conv_id", "turn", F.size(text.white_space_tokens(F.col("q"))).cast("long").alias("n_tokens"), F.round(text.jargon_density(F.col("q")), 9).alias("density"), text.should_expand(F.col("q")).alias("expand"))


_JARGON = "regexp_matches(t, '[^a-zA-Z0-9]') OR (length(t) >= 2 AND regexp_matches(t, '[A-Z]') AND NOT regexp_matches(t, '[a-z]')) OR regexp_matches(t, '[a-z][A-Z]|[A-Z][a-z]+[A-Z]') OR length(t) >= 12"
SQL_GATE = f"""WITH q AS (SELECT conv_id, turn, text AS q FROM conversations WHERE role = 'user'),
k AS (SELECT *, list_filter(regexp_split_to_array(trim(q), '\\s+'), lambda x: x <> '') AS ts FROM q),
j AS (SELECT *, CASE WHEN len(ts) > 0 THEN len(list_filter(ts, lambda t: {_JARGON})) / len(ts)::DOUBLE ELSE 0.0 END AS density FROM k)
SELECT conv_id, turn, len(ts) AS n_tokens, round(density, 9) AS density, len(ts) > 0 AND (len(ts) < 8 OR density > 0.4 OR regexp_matches(q, '(?i){text.IMPERATIVE.replace("'", "''")}')) AS expand FROM j"""


def expanded_queries(spark, sf):
    q = T(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    return providers.expanded(q, providers.EchoGenerator(40))


# Ingestion ------------------------------------------------------------------

_SOURCES = [("src0", True, "active", "core-team", "platform", "internal"), ("src1", True, "draft", None, None, "public"), ("src2", False, "active", "x", None, None), ("src3", True, "active", "ops-team", "ops", "internal")]
_SOURCE_SHAPE = "source_name string, active boolean, default_status string, default_owner string, default_authority string, default_sensitivity string"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    ext = F.when(i % 7 == 0, ".txt").when(i % 7 == 1, ".markdown").when(i % 7 == 2, ".MD").otherwise(".md")
    at = F.when(i % 17 == 0, "node_modules/").when(i % 17 == 1, "docs/.cache/").when(i % 17 == 2, "archive/old/").when(i % 2 == 0, "docs/").otherwise("docs/deep/er/")
    return T(spark, sf, "documents").select(F.col("source").alias("source_name"), "doc_id", F.concat(at, F.lit("doc-"), i.cast("string"), ext).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"), "text")


SQL_FILES = """files AS (SELECT source AS source_name, doc_id, CASE WHEN doc_id % 17 = 0 THEN 'node_modules/' WHEN doc_id % 17 = 1 THEN 'docs/.cache/' WHEN doc_id % 17 = 2 THEN 'archive/old/' WHEN doc_id % 2 = 0 THEN 'docs/' ELSE 'docs/deep/er/' END || 'doc-' || doc_id
  || CASE WHEN doc_id % 7 = 0 THEN '.txt' WHEN doc_id % 7 = 1 THEN '.markdown' WHEN doc_id % 7 = 2 THEN '.MD' ELSE '.md' END AS path, strlen(text) AS size_bytes, text FROM documents)"""
SQL_REASON = """reasoned AS (SELECT *, CASE WHEN split_part(path, '/', 1) = 'node_modules' OR contains(path, '/.') OR NOT (starts_with(path, 'docs/') OR starts_with(path, 'archive/')) OR starts_with(path, 'archive/') THEN 'excluded_by_pattern'
  WHEN lower(regexp_extract(path, '\\.([^./]+)$', 1)) NOT IN ('md', 'markdown') THEN 'unsupported_file_type' WHEN size_bytes > 6000 THEN 'too_large' END AS reason FROM files)"""


def _reasoned(spark, sf):
    return _files(spark, sf).withColumn("reason", ingest.skip_reason(F.col("path"), F.col("size_bytes"), ["docs/**/*", "archive/**"], ["archive/**"], 6000))


def file_filters(spark, sf):
    return _reasoned(spark, sf).select("source_name", "path", "reason")


def skip_histogram(spark, sf):
    return ingest.skip_histogram(_reasoned(spark, sf)).select("source_name", F.explode("skipped").alias("reason", "n"))


def source_caps(spark, sf):
    return ingest.over_caps(_reasoned(spark, sf).where("reason is null"), 3, 12000)


def allowed_files(spark, sf):
    allowed, refused = ingest.allowed_sources(_files(spark, sf), spark.createDataFrame(_SOURCES, _SOURCE_SHAPE))
    return allowed.groupBy("source_name").agg(F.count("*").alias("n"), F.lit("allowed").alias("verdict")).unionByName(refused.select("source_name", F.lit(0).cast("long").alias("n"), F.lit("refused").alias("verdict")))


_SQL_SOURCES = "sources(source_name, active, default_status, default_owner, default_authority, default_sensitivity) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else repr(v).lower() if isinstance(v, bool) else f"'{v}'" for v in row) + ")" for row in _SOURCES) + ")"


def resolved_metadata(spark, sf):
    allowed, _ = ingest.allowed_sources(_files(spark, sf), spark.createDataFrame(_SOURCES, _SOURCE_SHAPE))
    i = F.col("doc_id")
    entries = F.filter(
        F.array(
            F.struct(F.lit("status").alias("k"), F.when(i % 3 == 0, "approved").when(i % 3 == 1, "").alias("v")),
            F.struct(F.lit("doc-type").alias("k"), F.when(i % 4 == 0, "runbook").alias("v")),
            F.struct(F.lit("type").alias("k"), F.lit("note").alias("v")),
            F.struct(F.lit("last-verified").alias("k"), F.when(i % 5 == 0, "2024-02-30").when(i % 5 == 1, "2024-02-03").alias("v")),
            F.struct(F.lit("verified").alias("k"), F.lit("2023-01-01").alias("v")),
            F.struct(F.lit("source_url").alias("k"), F.when(i % 2 == 0, " https://x.example.com/a ").otherwise("data:text/html,x").alias("v")),
        ),
        lambda e: e["v"].isNotNull(),
    )
    return ingest.resolved(allowed.withColumn("metadata", F.map_from_entries(entries)))


SQL_RESOLVED = (
    _with(SQL_FILES, _SQL_SOURCES)
    + """SELECT source_name, path, path AS title, CASE WHEN doc_id % 3 = 0 THEN 'approved' ELSE default_status END AS status, default_owner AS owner, default_authority AS authority, default_sensitivity AS sensitivity,
  CASE WHEN doc_id % 4 = 0 THEN 'runbook' ELSE 'note' END AS doc_type, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN DATE '2024-02-03' ELSE DATE '2023-01-01' END AS last_reviewed,
  CASE WHEN doc_id % 2 = 0 THEN 'https://x.example.com/a' END AS source_url FROM files JOIN sources USING (source_name) WHERE active"""
)


def _old_new(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two snapshots of chunks: the second lost some, changed some and gained some."""
    chunks = corpus.chunks_view(spark, sf).withColumn("content_hash", text.content_hash(F.col("content")))
    i = F.col("document_id") + F.col("chunk_index")
    old = chunks.where(i % 11 != 0).withColumn("content_hash", F.when(i % 7 == 0, F.concat("content_hash", F.lit("x"))).otherwise(F.col("content_hash")))
    return old, chunks.where(i % 13 != 0)


SQL_OLD_NEW = (
    corpus.SQL_CHUNKS
    + """,
hashed AS (SELECT *, 'sha256:' || sha256(content) AS content_hash, document_id + chunk_index AS i FROM chunks),
old AS (SELECT document_id, chunk_index, chunk_id, content, content_hash || CASE WHEN i % 7 = 0 THEN 'x' ELSE '' END AS content_hash FROM hashed WHERE i % 11 <> 0),
new AS (SELECT document_id, chunk_index, chunk_id, content, content_hash FROM hashed WHERE i % 13 <> 0)"""
)
_CHANGE = "CASE WHEN a.content_hash IS NULL THEN 'new' WHEN b.content_hash IS NULL THEN 'orphan' WHEN a.content_hash = b.content_hash THEN 'unchanged' ELSE 'changed' END"


def chunk_diff(spark, sf):
    return ingest.chunk_diff(*_old_new(spark, sf)).groupBy("document_id", "change").agg(F.count("*").alias("n"))


def upsert_chunks(spark, sf):
    old, new = _old_new(spark, sf)
    return ingest.merged(old, new, ["document_id", "chunk_index"]).select("document_id", "chunk_index", "chunk_id", "content_hash")


def upsert_old_wins(spark, sf):
    docs = corpus.documents_view(spark, sf).select("document_id", "owner", "authority")
    new = docs.select((F.col("document_id") + 5).alias("document_id"), F.coalesce("owner", F.lit("nobody")).alias("owner"), F.lit("fresh").alias("authority"))
    return ingest.merged(docs, new, ["document_id"], old_wins=True)


def orphan_chunks(spark, sf):
    return ingest.orphans(*_old_new(spark, sf)).select("chunk_id")


def chunks_to_embed(spark, sf):
    old, new = _old_new(spark, sf)
    return ingest.to_embed(new, old).select("chunk_id", "content_hash")


def stamped_chunks(spark, sf):
    out = ingest.stamped(corpus.chunks_view(spark, sf), PHRASES, PATTERNS)
    return out.select("chunk_id", "injection_phrase", "sensitive_pattern", "has_prompt_injection", "has_sensitive_content")


def run_summary(spark, sf):
    old, new = _old_new(spark, sf)
    repos = T(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("source_name"))
    flagged = ingest.stamped(new, PHRASES, PATTERNS).select("document_id", "chunk_index", (F.col("has_prompt_injection") | F.col("has_sensitive_content")).alias("flagged"))
    changes = ingest.chunk_diff(old, new).join(repos, "document_id").join(flagged, ["document_id", "chunk_index"], "left")
    return ingest.run_summary(_reasoned(spark, sf), changes)


SQL_SUMMARY = (
    _with(SQL_FILES, SQL_REASON, SQL_OLD_NEW)
    + f""", ch AS (SELECT coalesce(a.document_id, b.document_id) AS document_id, coalesce(a.chunk_index, b.chunk_index) AS chunk_index, {_CHANGE} AS change, b.content FROM old a FULL JOIN new b USING (document_id, chunk_index)),
fl AS (SELECT *, lower(content) LIKE '%of the%' OR lower(content) LIKE '%on the%' OR lower(content) LIKE '%that in%' OR regexp_matches(content, '[0-9]{{4,}}') OR regexp_matches(content, '[a-z]{{14,}}') AS flagged FROM ch),
b AS (SELECT d.source AS source_name, count(*) FILTER (change IN ('new', 'changed')) AS chunks_created, count(*) FILTER (change = 'unchanged') AS chunks_unchanged, count(*) FILTER (change = 'orphan') AS chunks_deleted, count(*) FILTER (flagged) AS chunks_flagged
  FROM fl JOIN documents d ON d.doc_id = document_id GROUP BY 1),
a AS (SELECT source_name, count(*) AS files_scanned, count(*) FILTER (reason IS NULL) AS files_indexed, count(*) FILTER (reason IS NOT NULL) AS files_skipped, 0::BIGINT AS errors FROM reasoned GROUP BY 1)
SELECT a.*, coalesce(chunks_created, 0) AS chunks_created, coalesce(chunks_unchanged, 0) AS chunks_unchanged, coalesce(chunks_deleted, 0) AS chunks_deleted, coalesce(chunks_flagged, 0) AS chunks_flagged, 'succeeded' AS status FROM a LEFT JOIN b USING (source_name)"""
)


def page_sources(spark, sf):
    pages = T(spark, sf, "pages")
    hosts = [f"www.th{x}.example.com" for x in ("thhe", "thre", "thth")]
    return pages.select("page_id", ingest.page_path(F.col("url")).alias("path"), ingest.host_check(F.col("url"), hosts, allow_http=False).alias("refused"), (F.octet_length("html") > 4000).alias("over_cap"))


SQL_PAGES = """WITH p AS (SELECT *, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme FROM pages)
SELECT page_id, host || regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path, CASE WHEN host NOT IN ('www.ththhe.example.com', 'www.ththre.example.com', 'www.ththth.example.com') OR host = '' THEN 'host_not_allowed' WHEN scheme <> 'https' THEN 'scheme_not_allowed' END AS refused, strlen(html) > 4000 AS over_cap FROM p"""


def markdown_chunks(spark, sf):
    docs = T(spark, sf, "documents").select("doc_id", F.concat(F.lit("# "), F.col("source"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("text"))
    return markdown.chunks_of(markdown.parse_documents(docs, ["doc_id"], limit=200), ["doc_id"])


def embedded_chunks(spark, sf):
    old, new = _old_new(spark, sf)
    return providers.embedded(ingest.to_embed(new, old), providers.HashEmbedder(16)).select("chunk_id", "content_hash", "error", "dimensions")


def ingest_run(spark, sf):
    """A whole run over the documents as Markdown files of four sources, and its summary."""
    from siltstone.operators import run

    files = _files(spark, sf)
    content = F.encode(F.concat(F.lit("---\nstatus: "), F.when(F.col("doc_id") % 3 == 0, "approved").otherwise("draft"), F.lit("\n---\n# Doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text")), "UTF-8")
    files = files.withColumn("content", content).drop("text")
    # A source grows with the corpus here, so the caps on whole sources are out of its reach.
    limits = run.Limits(include=("docs/**/*", "archive/**"), exclude=("archive/**",), max_files=(1 << 63) - 1, max_source_bytes=(1 << 63) - 1)
    sources = spark.createDataFrame(_SOURCES, _SOURCE_SHAPE)
    return run.run_sources(files, sources, run.empty(spark), providers.HashEmbedder(16), limits).summary


# Reports --------------------------------------------------------------------


def registry(spark, sf):
    return telemetry.registry(corpus.documents_view(spark, sf))


SQL_REGISTRY = (
    _with(corpus.SQL_DOCUMENTS)
    + ", u AS ("
    + " UNION ALL ".join(f"SELECT '{d}' AS dimension, {d} AS value, last_reviewed FROM docs" for d in telemetry.DIMENSIONS if d != "tag")
    + " UNION ALL SELECT 'tag', unnest(list_distinct(tags)), last_reviewed FROM docs)\nSELECT dimension, value, count(*) AS count, max(last_reviewed) AS last_indexed FROM u WHERE value IS NOT NULL AND value <> '' GROUP BY ALL"
)


def neighbours(spark, sf):
    out = telemetry.neighbours(corpus.chunks_view(spark, sf), 2, 50)
    names = lambda c: F.array_join(F.transform(c, lambda x: x["chunk_id"]), ",")
    return out.select("chunk_id", names("before").alias("before"), names("after").alias("after"), F.md5(F.array_join("before.preview", "|")).alias("previews_md5"), F.size(F.filter("after", lambda x: x["truncated"])).cast("long").alias("n_cut"))


SQL_NEIGHBOURS = (
    _with(corpus.SQL_CHUNKS)
    + """, w AS (SELECT chunk_id, list(chunk_id) OVER b AS bi, list(substr(content, 1, 50)) OVER b AS bp, list(chunk_id) OVER a AS ai, list(length(content) > 50) OVER a AS ac FROM chunks
  WINDOW b AS (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), a AS (PARTITION BY document_id ORDER BY chunk_index ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
SELECT chunk_id, coalesce(array_to_string(bi, ','), '') AS before, coalesce(array_to_string(ai, ','), '') AS after, md5(coalesce(array_to_string(bp, '|'), '')) AS previews_md5, coalesce(len(list_filter(ac, lambda x: x)), 0)::BIGINT AS n_cut FROM w"""
)


def evidence_lookup(spark, sf):
    """A pack for each event, which cites the first chunk of one document and the second of another."""
    n = T(spark, sf, "documents").count()
    cited = F.array(F.concat((F.col("event_id") % n).cast("string"), F.lit("-0")), F.concat(((F.col("event_id") * 7 + 3) % n).cast("string"), F.lit("-1")))
    packs = T(spark, sf, "events").select(F.col("event_id").alias("pack_id"), cited.alias("evidence_chunk_ids"))
    return telemetry.evidence_of(packs, corpus.chunks_view(spark, sf), corpus.documents_view(spark, sf))


SQL_EVIDENCE = (
    _with(corpus.SQL_DOCUMENTS, corpus.SQL_CHUNKS)
    + """, p AS (SELECT event_id AS pack_id, 0 AS place, (event_id % n) || '-0' AS chunk_id FROM events CROSS JOIN (SELECT count(*) AS n FROM documents)
  UNION ALL SELECT event_id, 1, ((event_id * 7 + 3) % n) || '-1' FROM events CROSS JOIN (SELECT count(*) AS n FROM documents))
SELECT pack_id, place, chunk_id, repo, path, title, substr(content, 1, 200) AS excerpt FROM p JOIN chunks USING (chunk_id) JOIN docs USING (document_id)"""
)


def related(spark, sf):
    return telemetry.related_sources(corpus.documents_view(spark, sf))


SQL_RELATED = (
    _with(corpus.SQL_DOCUMENTS)
    + """, p AS (SELECT a.document_id AS x, b.document_id AS y FROM docs a JOIN docs b ON a.superseded_by = b.document_id)
SELECT x AS document_id, y AS related_id, 'superseded_by' AS relationship FROM p UNION ALL SELECT y, x, 'supersedes' FROM p"""
)

_SIGNAL = {"click": "helpful", "view": "not_helpful", "error": "wrong", "signup": "missing", "purchase": "stale"}


def feedback(spark, sf):
    rows = T(spark, sf, "events").select(F.concat((F.col("user_id") % 40).cast("string"), F.lit("-0")).alias("chunk_id"), scoring.lookup(F.col("event_type"), _SIGNAL).alias("signal"))
    return telemetry.feedback_counts(rows)


SQL_FEEDBACK = (
    "SELECT (user_id % 40) || '-0' AS chunk_id, "
    + ", ".join(f"count(*) FILTER (event_type = '{next((k for k, v in _SIGNAL.items() if v == s), '-')}') AS {s}" for s in telemetry.SIGNALS)
    + " FROM events GROUP BY 1"
)


def _runs(spark, sf):
    o = T(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "partial").otherwise("running").alias("status"), F.col("o_orderdate").cast("timestamp").alias("started_at"))


SQL_RUNS = "runs AS (SELECT o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'partial' ELSE 'running' END AS status, o_orderdate AS started_at FROM orders)"


def reconciled(spark, sf):
    jobs_ = T(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("job_id"), F.when(F.col("l_linestatus") == "O", "running").otherwise("done").alias("status"), (F.col("l_orderkey") + F.col("l_suppkey") % 3).alias("result_run_id"))
    return telemetry.reconciled_jobs(jobs_, _runs(spark, sf)).groupBy("action").agg(F.count("*").alias("n"))


def stuck(spark, sf):
    return telemetry.stuck_runs(_runs(spark, sf), F.lit("1996-01-01").cast("timestamp")).select("run_id", "started_at", "seconds")


def request_log(spark, sf):
    log = T(spark, sf, "events").select("event_id", F.concat(F.when(F.col("event_type") == "view", "/static/").when(F.col("event_type") == "error", "/health").otherwise("/search/"), F.col("user_id").cast("string")).alias("path"))
    return telemetry.request_log(log)


def last_attempts(spark, sf):
    rows = T(spark, sf, "events").select(F.col("event_id").alias("id"), F.concat_ws("-", "user_id", F.to_date("ts")).alias("request_id"), F.col("ts").alias("created_at"))
    return telemetry.last_attempts(rows)


def _requests(spark, sf):
    return T(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("user_id").cast("string").alias("key"),
        F.col("event_type").alias("route"),
        F.md5((F.col("event_id") % 3).cast("string")).alias("request_hash"),
        F.when(F.col("event_id") % 10 == 0, 500).otherwise(200).cast("int").alias("status"),
        "ts",
    )


def replay_by_day(spark, sf):
    """Answers hold to the end of their day."""
    return telemetry.first_in_day(_requests(spark, sf))


SQL_REPLAY = """WITH r AS (SELECT event_id AS id, user_id::VARCHAR AS key, event_type AS route, md5((event_id % 3)::VARCHAR) AS h, event_id % 10 <> 0 AS ok, ts FROM events),
b AS (SELECT *, first(CASE WHEN ok THEN h END IGNORE NULLS) OVER (PARTITION BY key, route, ts::DATE ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM r)
SELECT id, key, route, CASE WHEN held IS NULL THEN 'MISS' WHEN held = h THEN 'HIT' ELSE 'CONFLICT' END AS outcome FROM b"""


def replay(spark, sf):
    return telemetry.replay(_requests(spark, sf))


def token_bucket(spark, sf):
    return jobs.token_bucket(_requests(spark, sf), 3, 0.02)


def hourly(spark, sf):
    return telemetry.hourly(T(spark, sf, "events"))


def sliding(spark, sf):
    return jobs.sliding_counts(T(spark, sf, "events"), "1 hour", "30 minutes")


def sessions(spark, sf):
    return telemetry.sessions(T(spark, sf, "events"))


SQL_SESSIONS = """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS sid FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, sid"""


def settled_queries(spark, sf):
    rows = T(spark, sf, "events").withColumn("source", F.when(F.col("event_type") == "view", "keyup-debounce").when(F.col("event_type") == "click", "form"))
    return jobs.without_keystrokes(rows).groupBy("user_id").agg(F.count("*").alias("n"))


# Evaluation -----------------------------------------------------------------


def latencies(spark, sf):
    return evaluation.latencies(T(spark, sf, "events").select(F.col("value").alias("seconds")))


def _sections(spark, sf):
    c = corpus.chunks_view(spark, sf).join(corpus.documents_view(spark, sf).select("document_id", "repo", "path"), "document_id")
    n = F.length("content").cast("long")
    return c.select("repo", "path", F.col("chunk_index").cast("long").alias("section_idx"), F.concat(F.lit("h"), (F.col("chunk_index") % 3).cast("string")).alias("heading"), n.alias("section_tokens"), (F.floor(n / 400) + 1).alias("n_chunks_produced"), (n >= 400).alias("was_split"))


SQL_SECTIONS = (
    corpus.SQL_DOCUMENTS + ",\n" + corpus.SQL_CHUNKS
    + """,
sections AS (SELECT repo, path, chunk_index::BIGINT AS section_idx, 'h' || (chunk_index % 3) AS heading, length(content) AS section_tokens, length(content) // 400 + 1 AS n_chunks_produced, length(content) >= 400 AS was_split FROM chunks JOIN docs USING (document_id))"""
)


def chunking_summary(spark, sf):
    return evaluation.chunking_summary(_sections(spark, sf))


def document_sections(spark, sf):
    return evaluation.document_sections(_sections(spark, sf))


def longest_sections(spark, sf):
    return evaluation.longest_sections(_sections(spark, sf), 20).select("repo", "path", "section_idx", "section_tokens", F.col("place").cast("long").alias("place"))


def floor_percentiles(spark, sf):
    return evaluation.floor_percentiles(T(spark, sf, "events"), "event_type", "value", 3, 4, "p75")


def path_matches(spark, sf):
    expected = T(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.when(F.col("item_id") % 2 == 0, "deep/er/").otherwise(""), F.lit("doc-"), F.col("item_id").cast("string")).alias("expected"))
    return evaluation.path_matches(expected, _files(spark, sf).select("path")).select("qid", "expected", "path")


def long_misses(spark, sf):
    misses = T(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.concat(F.lit("src"), (F.col("item_id") % 4).cast("string")).alias("repo"), F.concat(F.lit("doc-"), F.col("item_id").cast("string"), F.lit(".md")).alias("path"))
    return evaluation.long_document_misses(misses, evaluation.document_sections(_sections(spark, sf)))


def _grades(spark, sf):
    return T(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.concat(F.lit("c"), (F.col("event_id") % 40).cast("string")).alias("citation"), F.pmod(F.floor("value").cast("int"), F.lit(4)).alias("grade"))


SQL_CONSENSUS = """g AS (SELECT user_id AS case_id, 'c' || (event_id % 40) AS citation, (((floor(value)::BIGINT % 4) + 4) % 4)::INT AS grade FROM events),
agreed AS (SELECT case_id, citation, list_sort(list(grade)) AS grades, round_even(quantile_cont(grade, 0.5), 0)::INT AS median, max(grade) - min(grade) AS spread FROM g GROUP BY ALL)"""


def consensus(spark, sf):
    return evaluation.consensus(_grades(spark, sf)).withColumn("grades", F.array_join("grades", ","))


def consensus_health(spark, sf):
    return evaluation.consensus_health(evaluation.consensus(_grades(spark, sf)))


def service_rates(spark, sf):
    log = T(spark, sf, "events").select("ts", (F.col("event_type") == "signup").alias("requires_human_review"), (F.col("event_type") == "error").alias("refused"), F.when(F.col("event_id") % 9 == 0, 429).otherwise(200).alias("status"))
    return telemetry.service_rates(log)


def recent_jobs(spark, sf):
    o = T(spark, sf, "orders")
    jobs_ = o.select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.length("o_orderpriority").cast("long").alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.col("o_orderdate").cast("timestamp").alias("enqueued_at"))
    return telemetry.recent_jobs(jobs_)


def attempts_of(spark, sf):
    """The newest five rows of each request of the users that a benchmark item names."""
    rows = T(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("request_id"), F.col("ts").alias("created_at"))
    return telemetry.attempts_of(rows, T(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("request_id")))


def feedback_labels(spark, sf):
    rows = T(spark, sf, "events").select("event_id", scoring.lookup(F.col("event_type"), _SIGNAL).alias("signal"))
    return telemetry.feedback_labels(rows)


def walked_files(spark, sf):
    return _files(spark, sf).where(ingest.default_walk(F.col("path"))).select("path")


def page_files(spark, sf):
    """Pages as the files of a source, and what a run over them keeps out."""
    hosts = [f"www.th{x}.example.com" for x in ("thhe", "thre", "thth")]
    files, refused = ingest.pages_as_files(T(spark, sf, "pages"), "web", hosts, max_bytes=4000)
    return files.select(F.col("path").alias("name"), F.lit("file").alias("kind"), "size_bytes").union(refused.select("url", "reason", F.lit(None).cast("long")))


SQL_PAGE_FILES = """WITH p AS (SELECT *, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host, lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) AS scheme, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS tail FROM pages),
r AS (SELECT *, CASE WHEN host NOT IN ('www.ththhe.example.com', 'www.ththre.example.com', 'www.ththth.example.com') OR host = '' THEN 'host_not_allowed' WHEN scheme <> 'https' THEN 'scheme_not_allowed' WHEN strlen(html) > 4000 THEN 'too_large' END AS reason FROM p)
SELECT CASE WHEN reason IS NULL THEN regexp_replace(host || tail, '/$', '/index') || '.md' ELSE url END AS name, coalesce(reason, 'file') AS kind, CASE WHEN reason IS NULL THEN strlen(html) END AS size_bytes FROM r WHERE reason IS NOT NULL OR html IS NOT NULL"""


QUERIES = {
    "filter_documents": (filter_documents, SQL_FILTER),
    "filter_requests": (filter_requests, SQL_FILTER_REQUESTS),
    "tagged_chunks": (tagged_chunks, SQL_TAGGED),
    "filter_json_overlap": (json_overlap, _with(corpus.SQL_DOCUMENTS) + "SELECT document_id, owner FROM docs WHERE list_has_any(controls, ['AC-2', 'SC-5']) OR coalesce(owner = 'data-team', false)"),
    "rejected_queries": (rejected_queries, SQL_REJECTED),
    "newest_events": (newest_events, "SELECT event_id, ts, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-10' ORDER BY ts DESC, event_id LIMIT 50"),
    "rail_filters": (rail_filters, SQL_RAIL),
    "scalar_text": (scalar_text, SQL_SCALAR_TEXT),
    "scalar_scores": (scalar_scores, SQL_SCALAR_SCORES),
    "expansion_gate": (expansion_gate, SQL_GATE),
    "expanded_queries": (expanded_queries, None),
    "file_filters": (file_filters, _with(SQL_FILES, SQL_REASON) + "SELECT source_name, path, reason FROM reasoned"),
    "skip_histogram": (skip_histogram, _with(SQL_FILES, SQL_REASON) + "SELECT source_name, reason, count(*) AS n FROM reasoned WHERE reason IS NOT NULL GROUP BY ALL"),
    "source_caps": (source_caps, _with(SQL_FILES, SQL_REASON) + "SELECT * FROM (SELECT source_name, count(*) AS n_files, sum(size_bytes)::BIGINT AS n_bytes, CASE WHEN sum(size_bytes) > 12000 THEN 'max_repo_bytes' WHEN count(*) > 3 THEN 'max_files' END AS reason FROM reasoned WHERE reason IS NULL GROUP BY 1) WHERE reason IS NOT NULL"),
    "allowed_sources": (allowed_files, _with(SQL_FILES, _SQL_SOURCES) + "SELECT source_name, count(*) FILTER (active) AS n, CASE WHEN bool_or(coalesce(active, false)) THEN 'allowed' ELSE 'refused' END AS verdict FROM files LEFT JOIN sources USING (source_name) GROUP BY 1"),
    "resolved_metadata": (resolved_metadata, SQL_RESOLVED),
    "chunk_diff": (chunk_diff, _with(SQL_OLD_NEW) + f"SELECT document_id, {_CHANGE} AS change, count(*) AS n FROM old a FULL JOIN new b USING (document_id, chunk_index) GROUP BY ALL"),
    "upsert_chunks": (upsert_chunks, _with(SQL_OLD_NEW) + "SELECT document_id, chunk_index, coalesce(b.chunk_id, a.chunk_id) AS chunk_id, coalesce(b.content_hash, a.content_hash) AS content_hash FROM old a FULL JOIN new b USING (document_id, chunk_index)"),
    "upsert_old_wins": (upsert_old_wins, _with(corpus.SQL_DOCUMENTS) + "SELECT document_id, coalesce(a.owner, b.owner) AS owner, coalesce(a.authority, b.authority) AS authority FROM docs a FULL JOIN (SELECT document_id + 5 AS document_id, coalesce(owner, 'nobody') AS owner, 'fresh' AS authority FROM docs) b USING (document_id)"),
    "orphan_chunks": (orphan_chunks, _with(SQL_OLD_NEW) + "SELECT chunk_id FROM old ANTI JOIN new USING (document_id, chunk_index)"),
    "chunks_to_embed": (chunks_to_embed, _with(SQL_OLD_NEW) + "SELECT chunk_id, content_hash FROM new ANTI JOIN old USING (chunk_id, content_hash)"),
    "stamped_chunks": (
        stamped_chunks,
        _with(corpus.SQL_CHUNKS)
        + """SELECT chunk_id, CASE WHEN lower(content) LIKE '%of the%' THEN 'of the' WHEN lower(content) LIKE '%on the%' THEN 'on the' WHEN lower(content) LIKE '%that in%' THEN 'that in' END AS injection_phrase,
  CASE WHEN regexp_matches(content, '[0-9]{4,}') THEN '[0-9]{4,}' WHEN regexp_matches(content, '[a-z]{14,}') THEN '[a-z]{14,}' END AS sensitive_pattern, injection_phrase IS NOT NULL AS has_prompt_injection, sensitive_pattern IS NOT NULL AS has_sensitive_content FROM chunks""",
    ),
    "run_summary": (run_summary, SQL_SUMMARY),
    "page_sources": (page_sources, SQL_PAGES),
    "markdown_chunks": (markdown_chunks, None),
    "embedded_chunks": (embedded_chunks, None),
    "ingest_run": (ingest_run, None),
    "registry": (registry, SQL_REGISTRY),
    "neighbours": (neighbours, SQL_NEIGHBOURS),
    "evidence_lookup": (evidence_lookup, SQL_EVIDENCE),
    "related_sources": (related, SQL_RELATED),
    "feedback_counts": (feedback, SQL_FEEDBACK),
    "reconciled_jobs": (
        reconciled,
        _with(SQL_RUNS)
        + ", j AS (SELECT l_orderkey + l_suppkey % 3 AS rid FROM lineitem WHERE l_linestatus = 'O') SELECT CASE WHEN status IN ('succeeded', 'partial') THEN 'done' ELSE 'requeue' END AS action, count(*) AS n FROM j LEFT JOIN runs ON run_id = rid GROUP BY 1",
    ),
    "stuck_runs": (stuck, _with(SQL_RUNS) + "SELECT run_id, started_at, date_diff('second', started_at, TIMESTAMP '1996-01-01') AS seconds FROM runs WHERE status = 'running' AND date_diff('second', started_at, TIMESTAMP '1996-01-01') > 300"),
    "request_log": (request_log, "SELECT event_id, '/search/' || user_id AS path FROM events WHERE event_type NOT IN ('view', 'error')"),
    "last_attempts": (last_attempts, "SELECT event_id AS id, user_id || '-' || ts::DATE AS request_id, ts AS created_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) = 1"),
    "replay_by_day": (replay_by_day, SQL_REPLAY),
    "replay": (replay, None),
    "token_bucket": (token_bucket, None),
    "hourly_usage": (hourly, "SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS n_purchases, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS total FROM events GROUP BY 1"),
    "sliding_usage": (sliding, "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL"),
    "sessions": (sessions, SQL_SESSIONS),
    "settled_queries": (settled_queries, "SELECT user_id, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1"),
    "latencies": (latencies, "SELECT count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events"),
    "chunking_summary": (
        chunking_summary,
        _with(SQL_SECTIONS)
        + "SELECT repo, count(*) AS n_sections, count(*) FILTER (was_split) AS n_split, round(avg(was_split::INT), 4) AS split_fraction, floor(quantile_cont(section_tokens, 0.5))::INT AS p50_tokens, floor(quantile_cont(section_tokens, 0.95))::INT AS p95_tokens, max(section_tokens) AS max_tokens, round(avg(n_chunks_produced), 4) AS mean_chunks, max(n_chunks_produced) AS max_chunks FROM sections GROUP BY repo",
    ),
    "document_sections": (document_sections, _with(SQL_SECTIONS) + "SELECT repo, path, count(*) AS n_sections, count(*) FILTER (section_tokens > 800) AS n_long, arg_max(heading, (section_tokens, -section_idx)) AS longest_heading FROM sections GROUP BY ALL"),
    "longest_sections": (longest_sections, _with(SQL_SECTIONS) + "SELECT repo, path, section_idx, section_tokens, row_number() OVER (PARTITION BY repo ORDER BY section_tokens DESC, path, section_idx) AS place FROM sections QUALIFY place <= 20"),
    "floor_percentiles": (floor_percentiles, "SELECT event_type, list_sort(list(value))[(count(*) * 3 // 4 + 1)::INT] AS p75 FROM events GROUP BY 1"),
    "path_matches": (path_matches, _with(SQL_FILES) + ", e AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN 'deep/er/' ELSE '' END || 'doc-' || item_id AS expected FROM benchmark), f AS (SELECT path, regexp_replace(path, '\\.md$', '') AS stem FROM files) SELECT qid, expected, path FROM e JOIN f ON stem = expected OR ends_with(stem, '/' || expected)"),
    "long_document_misses": (
        long_misses,
        _with(SQL_SECTIONS)
        + ", st AS (SELECT repo, path, count(*) FILTER (section_tokens > 800) AS n_long FROM sections GROUP BY ALL), m AS (SELECT item_id AS qid, 'src' || (item_id % 4) AS repo, 'doc-' || item_id || '.md' AS path FROM benchmark), per AS (SELECT qid, bool_or(coalesce(n_long > 0, false)) AS il FROM m LEFT JOIN st USING (repo, path) GROUP BY qid) SELECT count(*) AS n_misses, count(*) FILTER (il) AS n_in_long, round(coalesce(avg(il::INT), 0), 4) AS share FROM per",
    ),
    "judge_consensus": (consensus, _with(SQL_CONSENSUS) + "SELECT case_id, citation, array_to_string(grades, ',') AS grades, median, spread FROM agreed"),
    "consensus_health": (consensus_health, _with(SQL_CONSENSUS) + "SELECT count(*) AS n, count(*) FILTER (spread = 0) AS unanimous, count(*) FILTER (spread >= 2) AS spread_2 FROM agreed"),
    "service_rates": (
        service_rates,
        "SELECT date_trunc('hour', ts) AS start, count(*) AS n, round(avg((event_type = 'signup')::INT), 4) AS review_rate, round(avg((event_type = 'error')::INT), 4) AS refusal_rate, round(avg((event_id % 9 = 0)::INT), 4) AS deny_rate FROM events GROUP BY 1",
    ),
    "recent_jobs": (recent_jobs, "SELECT o_orderkey AS job_id, o_orderstatus AS status, length(o_orderpriority) AS attempts, NULL::VARCHAR AS last_error, o_orderdate::TIMESTAMP AS enqueued_at FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20"),
    "attempts_of": (attempts_of, "SELECT event_id AS id, user_id::VARCHAR AS request_id, ts AS created_at FROM events WHERE user_id IN (SELECT item_id FROM benchmark) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5"),
    "feedback_labels": (
        feedback_labels,
        f"SELECT event_id, signal, CASE signal {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in telemetry.FEEDBACK_LABELS.items())} END AS label FROM (SELECT event_id, CASE event_type {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in _SIGNAL.items())} END AS signal FROM events)",
    ),
    "walked_files": (walked_files, _with(SQL_FILES) + "SELECT path FROM files WHERE ends_with(path, '.md') AND NOT contains('/' || path, '/.') AND NOT contains('/' || path, '/node_modules/')"),
    "page_files": (page_files, SQL_PAGE_FILES),
}
