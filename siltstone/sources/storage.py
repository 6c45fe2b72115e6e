"""Tables that are written once and read several times."""

from __future__ import annotations

import hashlib
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where that is unset, a local session (driver and tasks in one process) gets a
    temporary folder of its own; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


class _Tables(threading.local):
    """The paths of the tables that a thread has stored and not deleted, oldest first."""

    def __init__(self):
        self.paths: list[str] = []


_TABLES = _Tables()


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def signature(spark: SparkSession, *names: str) -> str:
    """A name for what lies at these paths now: it changes with their files' names, sizes and times."""
    found = []
    for name in names:
        fs, at = _path(spark, name)
        found += sorted(f"{f.getPath()}|{f.getLen()}|{f.getModificationTime()}" for f in fs.listStatus(at))
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:24]


def kept_folder(spark: SparkSession, name: str) -> str:
    """A folder in the shared one that outlives runs, until the driver ends: for what is made once and read by many.

    It is the driver's own: another one that shares the folder doesn't lose it when this one ends.
    """
    path = f"{shared_folder(spark)}/siltstone-{name}-{spark.sparkContext.applicationId}"
    fs, at = _path(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def new_folder(spark: SparkSession, name: str) -> str:
    """An empty folder in the shared one, for what tasks write themselves; it goes as the tables of ``stored`` do."""
    path = f"{shared_folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    _TABLES.paths.append(path)
    fs, at = _path(spark, path)
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def stored(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it again.

    This cuts the lineage: a lost executor costs a read of the table, not a
    recomputation, and every later reader sees the same rows. The table belongs to
    the thread that stored it: operators that run at once in one session, a thread
    each, never see each other's tables. It goes with the ``run`` that it was stored
    in, and at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/siltstone-{name}-{uuid.uuid4().hex}"
    _TABLES.paths.append(path)  # before it is written, so that a failed write is deleted too
    df.write.partitionBy(*partition_by).parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def so_far() -> int:
    """How many tables this thread has stored and not deleted; for ``drop_stored``."""
    return len(_TABLES.paths)


def drop_stored(spark: SparkSession, since: int = 0, but: int = 0) -> None:
    """Delete the tables that this thread has stored after the first ``since``, but for the last ``but``.

    What reads them must have been written. Operators delete so what only led to
    their last tables; whoever has written a result deletes the rest, best with ``run``.
    """
    end = len(_TABLES.paths) - but
    gone = _TABLES.paths[since:end]
    del _TABLES.paths[since:end]
    for name in gone:
        fs, at = _path(spark, name)
        fs.delete(at, True)


@contextmanager
def run(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, whether it succeeds or fails.

    ``with run(spark): op(...).write.parquet(path)`` leaves the result and nothing else.
    """
    begin = so_far()
    try:
        yield
    finally:
        drop_stored(spark, begin)
