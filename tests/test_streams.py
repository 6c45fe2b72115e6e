import datetime
import time

import pytest

from siltstone.operators import ingest, telemetry
from siltstone.streaming import jobs

T0 = datetime.datetime(2024, 1, 1)
REQUESTS = [(1, "k", "/a", "x", 200, 0), (2, "k", "/a", "x", 200, 1), (3, "k", "/a", "y", 200, 2), (4, "k", "/a", "y", 200, 25), (5, "k", "/a", "x", 200, 26), (6, "k", "/b", "x", 500, 0), (7, "k", "/b", "x", 200, 1), (8, "k", "/b", "x", 200, 2)]
WANT = {1: "MISS", 2: "HIT", 3: "CONFLICT", 4: "MISS", 5: "CONFLICT", 6: "MISS", 7: "MISS", 8: "HIT"}
SHAPE = "id long, key string, route string, request_hash string, status int, ts timestamp"


def requests(spark):
    return spark.createDataFrame([(*r[:5], T0 + datetime.timedelta(hours=r[5])) for r in REQUESTS], SHAPE)


def test_replay(spark):
    assert {r.id: r.outcome for r in telemetry.replay(requests(spark)).collect()} == WANT
    day = requests(spark).where("ts < '2024-01-02'")
    assert {r.id: r.outcome for r in telemetry.first_in_day(day).collect()} == {k: v for k, v in WANT.items() if k not in (4, 5)}


def test_token_bucket(spark):
    log = spark.createDataFrame([(i, "a", T0 + datetime.timedelta(seconds=s)) for i, s in enumerate([0, 0, 0, 30, 31, 90])], "id long, key string, ts timestamp")
    got = {r.id: (r.allowed, round(r.retry_after)) for r in jobs.token_bucket(log, 2, 2.0).collect()}
    assert got == {0: (True, 0), 1: (True, 0), 2: (False, 30), 3: (True, 0), 4: (False, 29), 5: (True, 0)}


def test_ingest_stream_merges_once(spark, tmp_path):
    shape = "document_id string, chunk_index int, content_hash string"
    state = str(tmp_path / "state-0")
    spark.createDataFrame([], shape).write.parquet(state)
    versions = [state]

    def apply(batch, n):
        merged = ingest.merged(spark.read.parquet(versions[-1]), batch, ["document_id", "chunk_index"])
        merged.write.mode("overwrite").parquet(str(tmp_path / f"state-{len(versions)}"))
        versions.append(str(tmp_path / f"state-{len(versions)}"))

    for rows in ([("a", 0, "h1"), ("b", 0, "h2")], [("a", 0, "h3")], []):
        if rows:
            spark.createDataFrame(rows, shape).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.ingest(spark, str(tmp_path / "in"), shape, str(tmp_path / "check"), apply).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(versions[-1]).collect())) == [("a", 0, "h3"), ("b", 0, "h2")]


def test_hourly_stream_equals_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").selectExpr("event_type", "cast(ts as timestamp) as ts")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    query = jobs.hourly_counts(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(str, spark.table("hours").collect())) == sorted(map(str, jobs.hourly_counts(events).collect()))


def test_replay_stream(spark, tmp_path):
    requests(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(SHAPE).parquet(str(tmp_path / "in"))
        query = jobs.replayed(stream).writeStream.format("memory").queryName("replays").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert {r.id: r.outcome for r in spark.table("replays").collect()} == WANT


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


class Feed:
    """A stream whose micro-batches are given one at a time; each is a start of its own from the checkpoint."""

    def __init__(self, spark, folder, shape, make, mode="append"):
        self.spark, self.folder, self.shape, self.make, self.mode, self.n = spark, str(folder), shape, make, mode, 0
        self.progress = []

    def push(self, rows, name="feed"):
        self.n += 1
        self.spark.createDataFrame(rows, self.shape).coalesce(1).write.parquet(f"{self.folder}/in/{self.n}")
        out = self.make(self.spark.readStream.schema(self.shape).option("recursiveFileLookup", "true").parquet(f"{self.folder}/in"))
        query = out.writeStream.queryName(name).outputMode(self.mode).option("checkpointLocation", f"{self.folder}/check").trigger(availableNow=True).foreachBatch(lambda b, k: b.write.mode("append").parquet(f"{self.folder}/out")).start()
        query.awaitTermination()
        self.progress += query.recentProgress
        return query

    def rows(self):
        return sorted(map(tuple, self.spark.read.parquet(f"{self.folder}/out").collect()))


def test_replay_state_ends(spark, tmp_path, rocks):
    """Batch by batch as the batch form has it; a day later the answers' state is gone."""
    feed = Feed(spark, tmp_path, SHAPE, jobs.replayed)
    own = sorted([(*r[:5], T0 + datetime.timedelta(hours=r[5])) for r in REQUESTS], key=lambda r: r[5])
    for part in (own[:4], own[4:6], own[6:]):
        feed.push(part)
    assert {r[0]: r[3] for r in feed.rows()} == WANT
    held = feed.progress[-1]["stateOperators"][0]["numRowsTotal"]
    assert held > 0
    late = (99, "other", "/z", "x", 500, T0 + datetime.timedelta(days=9))
    feed.push([late])
    feed.push([(100, *late[1:])])
    assert feed.progress[-1]["stateOperators"][0]["numRowsTotal"] < held and feed.progress[-1]["stateOperators"][0]["numRowsTotal"] <= 2
    assert dict((r[0], r[3]) for r in feed.rows())[99] == "MISS"


def test_token_bucket_stream_equals_batch(spark, tmp_path, rocks):
    shape = "id long, key string, ts timestamp"
    rows = [(i, k, T0 + datetime.timedelta(seconds=s)) for i, (k, s) in enumerate([("a", 0), ("a", 0), ("b", 0), ("a", 0), ("a", 30), ("b", 31), ("a", 31), ("b", 32), ("a", 40), ("b", 33), ("a", 90)])]
    rows.sort(key=lambda r: r[2])
    feed = Feed(spark, tmp_path, shape, lambda s: jobs.token_bucket_stream(s, 2, 2.0))
    for a in range(0, len(rows), 4):
        feed.push(rows[a : a + 4])
    want = sorted(map(tuple, jobs.token_bucket(spark.createDataFrame(rows, shape), 2, 2.0).collect()))
    close = lambda rows: [(*r[:4], round(r[4], 6)) for r in rows]
    assert close(feed.rows()) == close(want)


def test_late_rows_are_counted_and_sessions_close(spark, tmp_path):
    shape = "event_id long, user_id long, event_type string, ts timestamp"
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    listener = jobs.LateRows()
    spark.streams.addListener(listener)
    try:
        feed = Feed(spark, tmp_path, shape, lambda s: jobs.session_counts(jobs.counted_once(s), "30 minutes", None))
        feed.push([(1, 7, "view", at(0)), (2, 7, "view", at(20)), (2, 7, "view", at(20)), (3, 8, "view", at(5))], "late")
        feed.push([(4, 7, "view", at(45)), (5, 9, "view", at(200))], "late")
        feed.push([(6, 7, "view", at(50)), (7, 8, "view", at(60)), (8, 9, "view", at(210))], "late")  # two are too late by now
        feed.push([(9, 1, "view", at(900))], "late")
        feed.push([(10, 1, "view", at(901))], "late")
        for _ in range(50):
            if listener.dropped.get("late", 0) >= 2:
                break
            time.sleep(0.2)
        assert listener.dropped["late"] == 2
    finally:
        spark.streams.removeListener(listener)
    kept = [(1, 7, "view", at(0)), (2, 7, "view", at(20)), (3, 8, "view", at(5)), (4, 7, "view", at(45)), (5, 9, "view", at(200)), (8, 9, "view", at(210))]
    assert feed.rows() == sorted(map(tuple, jobs.session_counts(spark.createDataFrame(kept, shape)).collect()))


def test_last_attempts_stream_equals_batch(spark, tmp_path, rocks):
    shape = "id long, request_id string, created_at timestamp, status int"
    at = lambda m: T0 + datetime.timedelta(minutes=m)
    first = [(1, "r", at(0), 500), (2, "s", at(1), 200), (3, "r", at(2), 503)]
    second = [(4, "r", at(4), 200), (4, "r", at(4), 200), (5, "t", at(5), 200)]
    feed = Feed(spark, tmp_path, shape, jobs.last_attempts_stream)
    feed.push(first)
    feed.push(second)
    feed.push([(8, "u", at(500), 200)])
    feed.push([(9, "v", at(501), 200)])
    want = telemetry.last_attempts(spark.createDataFrame(first + second, shape)).collect()
    assert [r for r in feed.rows() if r[1] in "rst"] == sorted(map(tuple, want))


def test_registry_follows_changes(spark, sf, tmp_path):
    """Equal to a recount after documents come, change and go; a batch that runs again counts once; few buckets are rewritten."""
    from pyspark.sql import functions as F

    from siltstone.sources.corpus import documents_view
    from siltstone.sources.snapshots import Store
    from siltstone.sources.storage import run

    counts = lambda docs: sorted(map(str, telemetry.registry(docs).select("dimension", "value", "count", "last_indexed").collect()))
    with run(spark):
        store = Store(spark, str(tmp_path / "r"))
        docs = documents_view(spark, sf)
        old, none = docs.where("document_id < 150"), docs.limit(0)
        jobs.refreshed_registry(store, none, old, "docs", 0)
        assert sorted(map(str, jobs.stored_registry(store).select("dimension", "value", "count", "last_indexed").collect())) == counts(old)
        newest = old.where("last_reviewed is not null").orderBy(F.desc("last_reviewed")).limit(3)
        ids = [r.document_id for r in newest.collect()]
        changed = old.where("document_id between 20 and 25")
        after = changed.withColumn("status", F.lit("brand-new")).union(docs.where("document_id >= 190"))
        for _ in range(2):  # the second time it is known
            jobs.refreshed_registry(store, changed.union(old.where(F.col("document_id").isin(ids))), after, "docs", 1)
        now = old.where(~F.col("document_id").between(20, 25) & ~F.col("document_id").isin(ids)).union(after)
        assert sorted(map(str, jobs.stored_registry(store).select("dimension", "value", "count", "last_indexed").collect())) == counts(now)
        assert store.manifest()["version"] == 2


def test_latencies_over_ranges(spark):
    import math

    from siltstone.operators import evaluation

    for n in (0, 1, 2, 19, 20, 100, 101):
        values = sorted(float((x * 37) % 101) for x in range(n))
        row = evaluation.latencies(spark.createDataFrame([(v,) for v in values], "seconds double")).first()
        want = [values[math.ceil(n * p / 100) - 1] if n else 0.0 for p in (50, 95, 99)]
        assert (row.n, [row.p50, row.p95, row.p99]) == (n, want)


def test_floor_percentiles_over_ranges(spark):
    from siltstone.operators import evaluation

    rows = [("a", float(x % 7)) for x in range(100)] + [("b", 1.0)] + [("c", None), ("c", 2.0), ("c", 1.0)]
    got = {r.k: r.p for r in evaluation.floor_percentiles(spark.createDataFrame(rows, "k string, v double"), "k", "v", 3, 4, "p").collect()}
    assert got == {"a": sorted(x % 7 for x in range(100))[75], "b": 1.0, "c": 2.0}


def test_rates_jobs_and_attempts(spark):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    log = spark.createDataFrame([(at(1, 0), True, False, 200), (at(1, 5), None, True, 429), (at(2, 0), False, None, 200)], "ts timestamp, requires_human_review boolean, refused boolean, status int")
    got = sorted(map(tuple, telemetry.service_rates(log).collect()))
    assert got == [(at(1, 0), 2, 0.5, 0.5, 0.5), (at(2, 0), 1, 0.0, 0.0, 0.0)]
    jobs_ = spark.createDataFrame([(i, "done", i % 3, None, at(i % 24, 0)) for i in range(24)], "job_id long, status string, attempts int, last_error string, enqueued_at timestamp")
    assert [r.job_id for r in telemetry.recent_jobs(jobs_).collect()] == list(range(23, 3, -1))
    rows = spark.createDataFrame([(i, "r" if i % 2 else "s", at(0, i)) for i in range(20)], "id long, request_id string, created_at timestamp")
    assert sorted(r.id for r in telemetry.attempts_of(rows, spark.createDataFrame([("r",), ("x",)], "request_id string")).collect()) == [11, 13, 15, 17, 19]
    assert [r.label for r in telemetry.feedback_labels(spark.createDataFrame([("stale",), ("odd",)], "signal string")).collect()] == ["Out of date", None]
