import os
import re
from concurrent.futures import ThreadPoolExecutor

import pytest

from siltstone.sources.storage import drop_stored, run, shared_folder, so_far, stored


def left(spark):
    return sorted(os.listdir(shared_folder(spark).removeprefix("file:")))


def test_threads_keep_their_tables_apart(spark):
    """Each of four threads stores, deletes what led to its last table, and reads that one while the others do the same."""

    def work(n):
        with run(spark):
            begin = so_far()
            t = spark.range(n)
            for _ in range(4):
                t = stored(t.where("id >= 0"), "step")
                drop_stored(spark, begin, 1)
            return t.count(), so_far() - begin

    before = left(spark)
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(work, [10, 20, 30, 40])) == [(10, 1), (20, 1), (30, 1), (40, 1)]
    assert left(spark) == before


def test_a_failed_run_leaves_nothing(spark):
    before = left(spark)
    with pytest.raises(Exception, match="stop here"), run(spark):
        stored(spark.range(3), "fine")
        stored(spark.range(3).selectExpr("raise_error('stop here') AS x"), "broken")
    assert left(spark) == before


def test_inner_runs_leave_the_tables_of_outer_ones(spark):
    with run(spark):
        outer = stored(spark.range(5), "outer")
        with run(spark):
            stored(spark.range(5), "inner")
        assert outer.count() == 5


@pytest.mark.parametrize("name", ["hybrid_search", "warnings", "vector_cells", "hybrid_filtered"])
def test_search_queries_leave_the_index_and_nothing_else(spark, sf, name, tmp_path):
    """After a query's result is written, the tables that led to it are gone; the index stays for the next."""
    from siltstone.plans import registry

    before = left(spark)
    with run(spark):
        registry.queries()[name](spark, sf).write.parquet(str(tmp_path / "out"))
    assert [n for n in left(spark) if n not in before and re.match("siltstone-(?!index-|vectors-)", n)] == []
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
