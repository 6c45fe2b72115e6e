"""Tables of one folder that change together, version by version.

A table's rows lie in buckets by a hash of some of its key columns, and a manifest
says which folders hold each bucket of each table. A change writes new folders for
the buckets that it touches and leaves the others where they are; it becomes
visible, for all its tables at once, with its manifest, whose creation either
succeeds or finds that another change came first. So a writer that is killed leaves
folders that no manifest names, readers see one version or the next, and a batch of a
stream that runs again is known by its number in the manifest.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The column that holds the bucket in the folders.
BUCKET = "_bucket"


class ConflictError(RuntimeError):
    """Another change was committed since this one began."""


def bucket_of(columns: list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int").alias(BUCKET)


@dataclass
class Store:
    """The tables under ``path``, which driver and executors share."""

    spark: SparkSession
    path: str
    _fs: object = field(init=False, repr=False)

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        self._fs = self._at("").getFileSystem(self.spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("manifests"))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def _names(self, name: str) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._at(name))] if self._fs.exists(self._at(name)) else []

    def _manifests(self) -> list[str]:
        return sorted(n for n in self._names("manifests") if re.fullmatch(r"\d+\.json", n))

    def manifest(self) -> dict:
        """The newest whole manifest; one whose writer was killed while writing it doesn't count."""
        for name in reversed(self._manifests()):
            stream = self._fs.open(self._at(f"manifests/{name}"))
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue
            finally:
                stream.close()
        return {"version": 0, "batches": {}, "tables": {}}

    def read(self, name: str, buckets: list[int] | None = None, with_bucket: bool = False) -> DataFrame:
        """A table as it is now, or some of its buckets; later changes don't alter what was read."""
        return self._read(self.manifest()["tables"][name], buckets, with_bucket)

    def _read(self, table: dict, buckets: list[int] | None, with_bucket: bool) -> DataFrame:
        schema = StructType.fromJson(table["schema"])
        found = [(b, d) for b, dirs in table["buckets"].items() for d in dirs if buckets is None or int(b) in buckets]
        full = StructType([*schema.fields, *StructType.fromDDL(f"{BUCKET} int").fields])
        if not found:
            out = self.spark.createDataFrame([], full)
        else:
            paths = [f"{self.path}/{d}/{BUCKET}={b}" for b, d in found]
            out = None
            # One scan for each change that still holds buckets: its folder is the base of their paths.
            for base in sorted({d for _, d in found}):
                part = self.spark.read.schema(full).option("basePath", f"{self.path}/{base}").parquet(*[p for p, (_, d) in zip(paths, found, strict=True) if d == base])
                out = part if out is None else out.unionByName(part)
        return out if with_bucket else out.drop(BUCKET)

    def begin(self, stream: str | None = None, batch: int | None = None) -> Change | None:
        """A change to commit, or None if this batch of the stream (or a later one) is in the store already."""
        now = self.manifest()
        if stream is not None and now["batches"].get(stream, -1) >= batch:
            return None
        return Change(self, now, stream, batch)

    def vacuum(self) -> int:
        """Deletes folders that the newest manifest doesn't name, and older manifests; readers of those must be done."""
        now = self.manifest()
        live = {d for t in now["tables"].values() for dirs in t["buckets"].values() for d in dirs}
        gone = [f"data/{t}/{d}" for t in self._names("data") for d in self._names(f"data/{t}") if f"data/{t}/{d}" not in live]
        for d in gone:
            self._fs.delete(self._at(d), True)
        for name in self._manifests():
            if int(name[:-5]) < now["version"]:
                self._fs.delete(self._at(f"manifests/{name}"), False)
        return len(gone)


@dataclass
class Change:
    store: Store
    base: dict
    stream: str | None
    batch: int | None
    tables: dict = field(init=False)
    #: Buckets that were written, by table.
    written: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.tables = json.loads(json.dumps(self.base["tables"]))

    def _write(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        """Rows with their bucket into a new folder; its buckets."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        rows.write.partitionBy(BUCKET).parquet(f"{self.store.path}/{folder}")
        buckets = [n.split("=")[1] for n in self.store._names(folder) if n.startswith(f"{BUCKET}=")]
        self.written[name] = self.written.get(name, 0) + len(buckets)
        return {b: [folder] for b in buckets}

    def create(self, name: str, rows: DataFrame, keys: list[str], bucket_by: list[str] | None = None, n_buckets: int = 64, sort: list[str] | None = None, after: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, list[str]]:
        """A table, new or anew; returns the folders of its buckets. ``bucket_by`` are the hashed columns (the keys, if not given), ``sort`` orders the rows of a file. ``after`` makes the rows from what was dealt to the buckets, whose other columns it keeps."""
        plain = (rows if after is None else after(rows)).drop(BUCKET)
        table = {"schema": plain.schema.jsonValue(), "keys": keys, "bucket_by": bucket_by or keys, "n_buckets": n_buckets, "sort": sort or keys, "buckets": {}}
        self.tables[name] = table
        table["buckets"] = self._write(name, self._dealt(table, rows, after))
        return table["buckets"]

    def _dealt(self, table: dict, rows: DataFrame, after: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        out = rows if BUCKET in rows.columns else rows.withColumn(BUCKET, bucket_of(table["bucket_by"], table["n_buckets"]))
        # Adaptive execution deals a large bucket out to several tasks, and files.
        out = out.hint("rebalance", F.col(BUCKET))
        return (out if after is None else after(out)).sortWithinPartitions(BUCKET, *table["sort"])

    def append(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        """More rows, in folders of their own beside what the buckets hold (returned); ``compact`` puts them together."""
        table = self.tables[name]
        made = self._write(name, self._dealt(table, rows))
        for b, dirs in made.items():
            table["buckets"].setdefault(b, []).extend(dirs)
        return made

    def compact(self, name: str, most: int = 1, live: DataFrame | None = None) -> None:
        """Rewrites the buckets that lie in more than ``most`` folders; of their rows those stay that have a counterpart in ``live``."""
        table = self.tables[name]
        spread = [int(b) for b, dirs in table["buckets"].items() if len(dirs) > most]
        if spread:
            rows = self.store._read(table, spread, True)
            rows = rows if live is None else rows.join(live, live.columns, "left_semi")
            made = self._write(name, self._dealt(table, rows))
            table["buckets"] |= {str(b): made.get(str(b), []) for b in spread}

    def merge(self, name: str, updates: DataFrame, deletes: DataFrame | None = None, old_wins: bool = False) -> list[int]:
        """Upserts by the table's keys, and deletes by columns of ``deletes``; returns the buckets that were rewritten.

        Only the buckets of the rows in ``updates`` and ``deletes`` are read and written,
        so ``updates`` should hold what has changed. ``deletes`` has the ``bucket_by`` columns,
        and may have all keys. A key in both is updated.
        """
        from siltstone.operators.ingest import merged

        table = self.tables[name]
        own = bucket_of(table["bucket_by"], table["n_buckets"])
        asked = updates.select(own)
        if deletes is not None:
            asked = asked.union(deletes.select(own))
        touched = sorted(r[0] for r in asked.distinct().collect())  # at most n_buckets numbers
        if not touched:
            return []
        old = self.store._read(table, touched, False)
        if deletes is not None:
            old = old.join(deletes.select(*[c for c in table["keys"] if c in deletes.columns]).distinct(), [c for c in table["keys"] if c in deletes.columns], "left_anti")
        rows = merged(old, updates.select(*old.columns), table["keys"], old_wins).select(*old.columns)
        made = self._write(name, self._dealt(table, rows))
        for b in touched:
            table["buckets"].pop(str(b), None)
        table["buckets"] |= made
        return touched

    def commit(self) -> int:
        """Makes the change visible as a whole, or raises ``ConflictError``; returns its version."""
        version = self.base["version"] + 1
        taken = [int(n[:-5]) for n in self.store._manifests()]
        if self.store.manifest()["version"] != self.base["version"]:
            raise ConflictError(f"version {version} of {self.store.path} is there already")
        version = max([version, *[t + 1 for t in taken]])
        batches = self.base["batches"] | ({self.stream: self.batch} if self.stream is not None else {})
        body = json.dumps({"version": version, "batches": batches, "tables": self.tables})
        try:
            out = self.store._fs.create(self.store._at(f"manifests/{version:012d}.json"), False)
        except Exception as e:
            raise ConflictError(f"version {version} of {self.store.path} is there already") from e
        out.write(bytearray(body, "utf-8"))
        out.close()
        return version
