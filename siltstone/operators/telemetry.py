"""Registry, neighbours, feedback and usage reports over append-only tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.scoring import lookup

DIMENSIONS = ["repo", "status", "doc_type", "owner", "authority", "sensitivity", "tag"]
#: Fixed value: what feedback can say.
SIGNALS = ["helpful", "not_helpful", "stale", "wrong", "duplicate", "missing"]
#: What the feedback form shows for each signal.
FEEDBACK_LABELS = {"helpful": "Helpful", "not_helpful": "Not helpful", "stale": "Out of date", "wrong": "Wrong", "duplicate": "Duplicate", "missing": "Something is missing"}
SKIPPED_PATHS = ["/health", "/ready", "/static/", "/favicon"]


def registry_values(docs: DataFrame) -> DataFrame:
    """``dimension, value, last_reviewed``: a row for each value of a document; nulls and '' are left out."""
    pairs = [F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in DIMENSIONS if d != "tag"]
    tags = F.transform(F.array_distinct("tags"), lambda t: F.struct(F.lit("tag").alias("dimension"), t.alias("value")))
    return docs.select("last_reviewed", F.explode(F.concat(F.array(*pairs), tags)).alias("x")).select("x.*", "last_reviewed").where("value is not null and value <> ''")


def registry(docs: DataFrame) -> DataFrame:
    """``dimension, value, count, last_indexed`` over all dimensions in one pass."""
    return registry_values(docs).groupBy("dimension", "value").agg(F.count("*").alias("count"), F.max("last_reviewed").alias("last_indexed"))


def neighbours(chunks: DataFrame, n: int = 1, chars: int = 500) -> DataFrame:
    """Each chunk with the ids and cut texts of up to n chunks before and after it in its document."""
    order = Window.partitionBy("document_id").orderBy("chunk_index")
    item = F.struct("chunk_index", "chunk_id", F.substring("content", 1, chars).alias("preview"), (F.length("content") > chars).alias("truncated"))
    return chunks.select("document_id", "chunk_id", "chunk_index", F.collect_list(item).over(order.rowsBetween(-n, -1)).alias("before"), F.collect_list(item).over(order.rowsBetween(1, n)).alias("after"))


def evidence_of(packs: DataFrame, chunks: DataFrame, docs: DataFrame, chars: int = 200) -> DataFrame:
    """The chunks that stored packs cite, in order, with their documents."""
    ids = packs.select("pack_id", F.posexplode("evidence_chunk_ids").alias("place", "chunk_id"))
    return ids.join(chunks, "chunk_id").join(docs.select("document_id", "repo", "path", "title"), "document_id").select("pack_id", "place", "chunk_id", "repo", "path", "title", F.substring("content", 1, chars).alias("excerpt"))


def related_sources(docs: DataFrame) -> DataFrame:
    """Both directions of the succession between documents that exist."""
    pairs = docs.where("superseded_by is not null").select("document_id", F.col("superseded_by").alias("other"))
    pairs = pairs.join(docs.select(F.col("document_id").alias("other")), "other")
    return pairs.select("document_id", F.col("other").alias("related_id"), F.lit("superseded_by").alias("relationship")).union(pairs.select(F.col("other").alias("document_id"), F.col("document_id").alias("related_id"), F.lit("supersedes").alias("relationship")))


def feedback_counts(feedback: DataFrame) -> DataFrame:
    """Per chunk, a column for each signal of the closed list."""
    return feedback.groupBy("chunk_id").pivot("signal", SIGNALS).agg(F.count("signal")).na.fill(0, SIGNALS)


def feedback_labels(feedback: DataFrame) -> DataFrame:
    """Feedback with the label of its signal; null for a signal outside the closed list."""
    return feedback.withColumn("label", lookup(F.col("signal"), FEEDBACK_LABELS))


def reconciled_jobs(jobs: DataFrame, runs: DataFrame) -> DataFrame:
    """What to do with jobs that are marked running: done where their run ended well, else queue again."""
    both = jobs.where("status = 'running'").join(runs.select(F.col("run_id").alias("result_run_id"), F.col("status").alias("run_status")), "result_run_id", "left")
    return both.select("job_id", F.when(F.col("run_status").isin("succeeded", "partial"), "done").otherwise("requeue").alias("action"))


def stuck_runs(runs: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    age = F.unix_timestamp(as_of) - F.unix_timestamp("started_at")
    return runs.where((F.col("status") == "running") & (age > 60 * minutes)).select("run_id", "started_at", age.alias("seconds")).orderBy("started_at", "run_id")


def request_log(requests: DataFrame) -> DataFrame:
    """Requests worth a log line: no probes, no static files."""
    out = requests
    for p in SKIPPED_PATHS:
        out = out.where(~F.col("path").startswith(p))
    return out


def last_attempts(rows: DataFrame, key: str = "request_id", time: str = "created_at", tie: str = "id") -> DataFrame:
    """Of the rows of a retried request, the last one: what the caller saw."""
    order = Window.partitionBy(key).orderBy(F.desc(time), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def replay(requests: DataFrame, hours: int = 24) -> DataFrame:
    """Classifies each request of ``key, route, request_hash, status, ts`` against the answers stored before it.

    The first answer of a key and route that can be stored (200 to 499) holds for
    ``hours``: later requests with its hash are a HIT, with another hash a CONFLICT.
    Without one that still holds, a request is a MISS, and may store the next.

    Requests are dealt by key and route and sorted by time; a task walks them with the
    small state of the one at hand, so a key with many requests is never held as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, until, span = None, None, None, dt.timedelta(hours=hours)
        for b in batches:
            out = []
            for key, route, h, status, ts in zip(*(b.column(c).to_pylist() for c in range(1, 6)), strict=True):
                if (key, route) != at:
                    at, held = (key, route), None
                if held is not None and ts < until:
                    out.append("HIT" if h == held else "CONFLICT")
                    continue
                out.append("MISS")
                held, until = (h if status is not None and 200 <= status < 500 else None), ts + span
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.string())], ["id", "key", "route", "outcome"])

    dealt = requests.select("id", "key", "route", "request_hash", "status", "ts").repartition("key", "route").sortWithinPartitions("key", "route", "ts", "id")
    return dealt.mapInArrow(run, "id long, key string, route string, outcome string")


def first_in_day(requests: DataFrame) -> DataFrame:
    """The form of replay whose answers hold to the end of their day: the first storable row of a key, route and day decides."""
    w = Window.partitionBy("key", "route", F.to_date("ts")).orderBy("ts", "id")
    ok = F.col("status").between(200, 499)
    before = F.first(F.when(ok, F.col("request_hash")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return requests.select("id", "key", "route", F.when(before.isNull(), "MISS").when(before == F.col("request_hash"), "HIT").otherwise("CONFLICT").alias("outcome"))


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling hours: events by kind, users, values."""
    w = events.groupBy(F.window("ts", "1 hour").alias("w"))
    return w.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("n_purchases"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "n", "n_purchases", "n_users", "total")


def service_rates(log: DataFrame, span: str = "1 hour") -> DataFrame:
    """Per tumbling window of a request log: requests, and the shares sent to review, refused and denied.

    ``log(ts, requires_human_review, refused, status)``; a request is denied by status 429.
    """
    share = lambda c, n: F.round(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 4).alias(n)
    w = log.groupBy(F.window("ts", span).alias("w"))
    return w.agg(F.count("*").alias("n"), share(F.col("requires_human_review"), "review_rate"), share(F.col("refused"), "refusal_rate"), share(F.col("status") == 429, "deny_rate")).select(F.col("w.start").alias("start"), "n", "review_rate", "refusal_rate", "deny_rate")


def recent_jobs(jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest jobs with status, attempts and last error: a report of a fixed length."""
    return jobs.orderBy(F.desc("enqueued_at"), "job_id").limit(limit).select("job_id", "status", "attempts", "last_error", "enqueued_at")


def attempts_of(rows: DataFrame, wanted: DataFrame, key: str = "request_id", n: int = 5) -> DataFrame:
    """For each wanted key the newest ``n`` rows: point lookups, many at a time."""
    order = Window.partitionBy(key).orderBy(F.desc("created_at"), F.desc("id"))
    return rows.join(wanted.select(key).distinct(), key, "left_semi").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
