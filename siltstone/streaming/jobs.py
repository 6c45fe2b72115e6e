"""Structured Streaming jobs: ingestion, idempotent replay, token buckets, rollups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from siltstone.sources.snapshots import Store, bucket_of
from siltstone.sources.storage import stored


def ingest(spark: SparkSession, folder: str, schema: str, checkpoint: str, apply: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """New Parquet files of a folder go to ``apply(batch, id)`` as they come; the checkpoint is the work queue.

    ``apply`` must be a merge by key, so a batch that is run again after a failure changes nothing.
    """
    out = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if once else out.trigger(processingTime="5 seconds")).start()


def ingest_into(store: Store, folder: str, schema: str, checkpoint: str, sources: DataFrame, embedder, name: str = "ingest", once: bool = True, **more) -> StreamingQuery:
    """Files of a folder (Parquet, of ``run_sources``' columns) into a store, each micro-batch exactly once.

    The store's manifest names the last batch of the stream ``name``: one that Spark
    gives again, as its checkpoint was not written before the driver was lost, is known
    and changes nothing; one that was lost before its commit has changed nothing.
    """
    from siltstone.operators.run import run_into

    return ingest(store.spark, folder, schema, checkpoint, lambda batch, n: run_into(store, batch, sources, embedder, stream=name, batch=n, **more), once)


def without_keystrokes(queries: DataFrame) -> DataFrame:
    """Search log rows without those of a query that was still being typed."""
    return queries.where(F.coalesce("source", F.lit("")) != "keyup-debounce")


def _ms(ts) -> int:
    return int(pd.Timestamp(ts).timestamp() * 1000)


def _in_order(rows: Iterator[pd.DataFrame], *by: str) -> pd.DataFrame:
    """A key's rows of a micro-batch, sorted: as many as a trigger lets in (``maxFilesPerTrigger`` or the like)."""
    return pd.concat(list(rows)).sort_values(list(by), kind="stable")


class Replay(StatefulProcessor):
    """Keeps the first answer that can be stored of a key until it ends; see ``replayed``."""

    def __init__(self, hours: int = 24):
        self.hours = hours

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "request_hash string, until timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame, out = _in_order(rows, "ts", "id"), []
        got = self.held.get() if self.held.exists() else None
        held, until = (got[0], pd.Timestamp(got[1])) if got else (None, None)
        for i, h, status, ts in zip(frame["id"], frame["request_hash"], frame["status"], frame["ts"], strict=True):
            if held is not None and ts < until:
                out.append((i, key[0], key[1], "HIT" if h == held else "CONFLICT"))
                continue
            out.append((i, key[0], key[1], "MISS"))
            held, until = (h, ts + pd.Timedelta(hours=self.hours)) if 200 <= status < 500 else (None, None)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if held is None:
            self.held.clear()
        else:
            self.held.update((held, until.to_pydatetime()))
            self.handle.registerTimer(_ms(until))
        yield pd.DataFrame(out, columns=["id", "key", "route", "outcome"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield pd.DataFrame([], columns=["id", "key", "route", "outcome"])

    def close(self) -> None:
        pass


def replayed(requests: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Classifies a stream of requests as MISS, HIT or CONFLICT; an answer holds for ``hours``.

    An answer's state ends with it: a timer of event time clears it once no row before
    its end can come any more. Rows later than ``late`` behind the newest are dropped.
    """
    keyed = requests.withWatermark("ts", late).groupBy("key", "route")
    return keyed.transformWithStateInPandas(Replay(hours), outputStructType="id long, key string, route string, outcome string", outputMode="append", timeMode="EventTime")


class Bucket(StatefulProcessor):
    """A key's tokens and when they were counted; see ``token_bucket_stream``."""

    def __init__(self, capacity: int, per_minute: float):
        self.capacity, self.per_second = capacity, per_minute / 60

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "tokens double, last timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame, out = _in_order(rows, "ts", "id"), []
        got = self.held.get() if self.held.exists() else None
        tokens, last = (got[0], pd.Timestamp(got[1])) if got else (float(self.capacity), None)
        for i, ts in zip(frame["id"], frame["ts"], strict=True):
            if last is not None:
                tokens = min(self.capacity, tokens + max(0.0, (ts - last).total_seconds()) * self.per_second)
            last, ok = ts, tokens >= 1
            tokens -= 1 if ok else 0
            out.append((i, key[0], ts, ok, 0.0 if ok else (1 - tokens) / self.per_second))
        self.held.update((tokens, last.to_pydatetime()))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # Full again, a bucket is as good as none.
        self.handle.registerTimer(_ms(last) + int(1000 * (self.capacity - tokens) / self.per_second) + 1)
        yield pd.DataFrame(out, columns=["id", "key", "ts", "allowed", "retry_after"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.held.clear()
        yield pd.DataFrame({"id": pd.Series(dtype="int64"), "key": pd.Series(dtype=str), "ts": pd.Series(dtype="datetime64[ns]"), "allowed": pd.Series(dtype=bool), "retry_after": pd.Series(dtype=float)})

    def close(self) -> None:
        pass


def token_bucket_stream(log: DataFrame, capacity: int, per_minute: float, late: str = "1 minute") -> DataFrame:
    """``token_bucket`` of a stream: a bucket lasts from one micro-batch, and one start from a checkpoint, to the next.

    Buckets refill with the time of their requests, in the order of arrival by
    micro-batch; one that is full again is forgotten. Rows later than ``late`` behind
    the newest are dropped.
    """
    keyed = log.select("id", "key", "ts").withWatermark("ts", late).groupBy("key")
    return keyed.transformWithStateInPandas(Bucket(capacity, per_minute), outputStructType="id long, key string, ts timestamp, allowed boolean, retry_after double", outputMode="append", timeMode="EventTime")


class Attempts(StatefulProcessor):
    """The last attempt of a request so far; see ``last_attempts_stream``."""

    def __init__(self, wait_ms: int, names: list[str]):
        self.wait_ms, self.names = wait_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "created_at timestamp, id long, row string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = _in_order(rows, "created_at", "id")
        last = (frame["created_at"].iloc[-1], int(frame["id"].iloc[-1]), frame["row"].iloc[-1])
        if not self.held.exists():
            self.handle.registerTimer(_ms(frame["created_at"].iloc[0]) + self.wait_ms)
            held = None
        else:
            held = self.held.get()
        if held is None or (pd.Timestamp(held[0]), held[1]) < last[:2]:
            self.held.update((last[0].to_pydatetime(), last[1], last[2]))
        yield pd.DataFrame({"request_id": pd.Series(dtype=str), "row": pd.Series(dtype=str)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        row = self.held.get()[2]
        self.held.clear()
        yield pd.DataFrame({"request_id": [key[0]], "row": [row]})

    def close(self) -> None:
        pass


def last_attempts_stream(rows: DataFrame, wait: str = "10 minutes") -> DataFrame:
    """``telemetry.last_attempts`` of a stream of ``rows(request_id, created_at, id, ...)``: a request's last row, ``wait`` after its first.

    A row that comes twice is one (``request_id`` and ``id``), retries within ``wait``
    replace each other, and a timer gives the last one out and ends the state.
    """
    shape = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    once = rows.withWatermark("created_at", wait).dropDuplicatesWithinWatermark(["request_id", "id"])
    told = once.select("request_id", "created_at", F.col("id").cast("long").alias("id"), F.to_json(F.struct(*rows.columns)).alias("row"))
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    kept = told.groupBy("request_id").transformWithStateInPandas(Attempts(wait_ms, rows.columns), outputStructType="request_id string, row string", outputMode="append", timeMode="EventTime")
    return kept.select(F.from_json("row", shape).alias("r")).select("r.*")


def token_bucket(log: DataFrame, capacity: int, per_minute: float) -> DataFrame:
    """``id, key, ts, allowed, retry_after`` for a log of requests: a bucket per key that refills with time.

    Requests are dealt by key and sorted by time; a task walks them with the bucket of
    the key at hand, so a key with many requests is never held as a whole.
    """
    per_second = per_minute / 60

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, tokens, last = object(), 0.0, None
        for b in batches:
            allowed, wait = [], []
            for key, ts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if key != at:
                    at, tokens, last = key, float(capacity), ts
                tokens = min(capacity, tokens + max(0.0, (ts - last).total_seconds()) * per_second)
                last, ok = ts, tokens >= 1
                tokens -= 1 if ok else 0
                allowed.append(ok)
                wait.append(0.0 if ok else (1 - tokens) / per_second)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(allowed, pa.bool_()), pa.array(wait, pa.float64())], ["id", "key", "ts", "allowed", "retry_after"])

    dealt = log.select("id", "key", "ts").repartition("key").sortWithinPartitions("key", "ts", "id")
    return dealt.mapInArrow(run, "id long, key string, ts timestamp, allowed boolean, retry_after double")


def hourly_counts(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Tumbling hours of a stream by kind; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("hour"), "event_type", "n")


def counted_once(events: DataFrame, late: str = "10 minutes", id_col: str = "event_id") -> DataFrame:
    """A stream without rows that come again within ``late``. It is also where late rows are dropped, one by one, so that ``LateRows`` can count them."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([id_col])


class LateRows(StreamingQueryListener):
    """Counts, by query name, the rows that came too late for a watermark; add it to ``spark.streams``.

    A window counts rows that its first step has put together. Behind
    ``counted_once`` each row counts for itself.
    """

    def __init__(self):
        self.dropped: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.dropped.setdefault(event.name, 0)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.dropped[p.name] = self.dropped.get(p.name, 0) + sum(o.numRowsDroppedByWatermark for o in p.stateOperators)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str | None = "10 minutes") -> DataFrame:
    """``user_id, start, end, n``: a user's events with no pause longer than ``gap``; in a stream given out when no row can join any more.

    ``late`` is None for a stream that has its watermark already, as ``counted_once`` gives it.
    """
    own = (events if late is None else events.withWatermark("ts", late)).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return own.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sliding_counts(events: DataFrame, length: str = "1 hour", slide: str = "15 minutes") -> DataFrame:
    return events.groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def refreshed_registry(store: Store, before: DataFrame, after: DataFrame, stream: str | None = None, batch: int | None = None) -> None:
    """Brings the stored counts behind ``stored_registry`` up to date with changed documents.

    ``before`` are the documents that change or go as they were, ``after`` those that
    change or come as they are; others are not read. Counts are kept by dimension,
    value and day of review, so a deletion can lower the newest day as well as the
    count; only the buckets of the values that change are rewritten. With ``stream``, a
    ``batch`` that runs again changes nothing.
    """
    from siltstone.operators.telemetry import registry_values

    keys = ["dimension", "value", "day"]
    # A missing day is one of its own.
    values = lambda docs, n: registry_values(docs).select("dimension", "value", F.coalesce(F.col("last_reviewed").cast("string"), F.lit("")).alias("day"), F.lit(n).alias("n"))
    deltas = values(before, -1).union(values(after, 1)).groupBy(*keys).agg(F.sum("n").alias("n")).where("n <> 0")
    change = store.begin(stream, batch)
    if change is None:
        return
    if "registry" not in change.tables:
        change.create("registry", deltas, keys, ["dimension", "value"], 32)
    else:
        deltas = stored(deltas, "registry-deltas")
        own = bucket_of(["dimension", "value"], change.tables["registry"]["n_buckets"])
        touched = [r[0] for r in deltas.select(own).distinct().collect()]  # at most n_buckets numbers
        now = deltas.join(store._read(change.tables["registry"], touched, False).select(*keys, F.col("n").alias("old")), keys, "left").select(*keys, (F.col("n") + F.coalesce("old", F.lit(0))).alias("n"))
        now = stored(now, "registry-now")
        change.merge("registry", now.where("n <> 0"), now.where("n = 0").select(*keys))
    change.commit()


def stored_registry(store: Store) -> DataFrame:
    """What ``telemetry.registry`` gives for the documents, from the stored counts."""
    day = F.when(F.col("day") != "", F.col("day")).cast("date")
    return store.read("registry").groupBy("dimension", "value").agg(F.sum("n").alias("count"), F.max(day).alias("last_indexed"))
