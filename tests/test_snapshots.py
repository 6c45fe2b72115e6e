import pytest
from pyspark.sql import functions as F

from siltstone.sources.snapshots import BUCKET, ConflictError, Store, bucket_of


def filled(spark, path, n=2000, buckets=256):
    store = Store(spark, str(path))
    change = store.begin()
    change.create("docs", spark.range(n).select(F.col("id").alias("k"), F.lit("old").alias("v")), ["k"], n_buckets=buckets)
    change.commit()
    return store


def rows(store, name="docs"):
    return {r.k: r.v for r in store.read(name).collect()}


def test_a_merge_rewrites_only_what_it_touches(spark, tmp_path):
    store = filled(spark, tmp_path / "s")
    change = store.begin()
    updates = spark.createDataFrame([(3, "new"), (5000, "added")], "k long, v string")
    touched = change.merge("docs", updates, spark.createDataFrame([(7,)], "k long"))
    assert len(touched) <= 3 and change.written["docs"] <= 3  # of 256
    assert rows(store)[3] == "old"  # until it is committed
    assert change.commit() == 2
    got = rows(store)
    assert got[3] == "new" and got[5000] == "added" and 7 not in got and len(got) == 2000
    assert {d for dirs in store.manifest()["tables"]["docs"]["buckets"].values() for d in dirs} != set() and store.vacuum() == 0
    assert len(rows(store)) == 2000


def test_merges_of_one_percent(spark, tmp_path):
    store = filled(spark, tmp_path / "s", 5000, 1024)
    change = store.begin()
    change.merge("docs", spark.range(10).select(F.col("id").alias("k"), F.lit("new").alias("v")))
    assert change.written["docs"] <= 10


def test_old_values_win_and_reads_are_stable(spark, tmp_path):
    store = filled(spark, tmp_path / "s", 10, 4)
    before = store.read("docs")
    change = store.begin()
    change.merge("docs", spark.createDataFrame([(1, "x"), (99, "y")], "k long, v string"), old_wins=True)
    change.commit()
    assert rows(store)[1] == "old" and rows(store)[99] == "y" and before.count() == 10


def test_of_two_changes_one_is_committed(spark, tmp_path):
    store = filled(spark, tmp_path / "s", 10, 4)
    a, b = store.begin(), store.begin()
    for change, v in ((a, "a"), (b, "b")):
        change.merge("docs", spark.createDataFrame([(1, v)], "k long, v string"))
    a.commit()
    with pytest.raises(ConflictError):
        b.commit()
    assert rows(store)[1] == "a"
    assert store.vacuum() >= 1 and rows(store)[1] == "a"  # what the second wrote goes


def test_a_batch_counts_once_and_a_torn_manifest_never(spark, tmp_path):
    store = filled(spark, tmp_path / "s", 10, 4)
    change = store.begin("in", 0)
    change.merge("docs", spark.createDataFrame([(1, "zero")], "k long, v string"))
    change.commit()
    assert store.begin("in", 0) is None and store.begin("other", 0) is not None
    (tmp_path / "s/manifests/000000000003.json").write_text('{"version": 3, "tab')
    assert store.manifest()["version"] == 2 and rows(store)[1] == "zero"
    change = store.begin("in", 1)
    change.merge("docs", spark.createDataFrame([(2, "one")], "k long, v string"))
    assert change.commit() == 4 and rows(store)[2] == "one"


def test_appended_rows_are_compacted(spark, tmp_path):
    store = filled(spark, tmp_path / "s", 100, 4)
    for n in (100, 200):
        change = store.begin()
        change.append("docs", spark.range(n, n + 100).select(F.col("id").alias("k"), F.lit("more").alias("v")))
        change.commit()
    assert all(len(d) == 3 for d in store.manifest()["tables"]["docs"]["buckets"].values())
    change = store.begin()
    change.compact("docs")
    change.commit()
    assert all(len(d) == 1 for d in store.manifest()["tables"]["docs"]["buckets"].values())
    assert len(rows(store)) == 300 and store.read("docs").count() == 300


def test_buckets_are_read_alone(spark, tmp_path):
    store = filled(spark, tmp_path / "s", 100, 8)
    part = store.read("docs", [3], with_bucket=True)
    assert {r[BUCKET] for r in part.collect()} == {3}
    assert part.count() == spark.range(100).select(F.col("id").alias("k")).where(bucket_of(["k"], 8) == 3).count()
    assert store.read("docs", []).count() == 0
