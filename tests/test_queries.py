"""Every query with SQL against DuckDB over the same tables."""

import math

import duckdb
import pytest

from siltstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, sf, duck, name):
    out = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(out.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in out.columns]
    rows = want.fetchall()
    assert rows, "the SQL returns nothing"
    assert sorted(tuple(map(plain, r)) for r in out.collect()) == sorted(tuple(plain(r[i]) for i in order) for r in rows)


def test_entry(spark, sf):
    rows = registry.entry(spark, sf).collect()
    assert 0 < len(rows) <= 10 and all(0 <= r.score <= 1 for r in rows)


def test_cells_find_most_neighbours(spark):
    assert registry.queries()["vector_cells_recall"](spark, "/root/testdata/sf0.01").first()[0] >= 0.9
