import numpy as np
import pytest

from siltstone.llm import ego_join as ego


def brute(rows, cosine=0.98):
    n = len(rows)

    def unit(r):
        if r[0] is None or r[1] is None or not r[2] or any(x is None for x in r[2]):
            return None
        v = np.array(r[2], np.float64)
        v = v / (np.abs(v).max() or 1)
        return v / np.linalg.norm(v) if np.isfinite(v).all() and v.any() else None

    units = [unit(r) for r in rows]
    link = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = min(rows[j][0] for j in seen) if rows[i][0] is not None else None
        out.append((rows[i][0], len(link[i]), low, None if low is None else low == rows[i][0]))
    return sorted(out, key=str)


SHAPE = "vec_id long, label int, embedding array<float>, n long, id string"


@pytest.mark.parametrize("block", [1024, 16])
def test_matches_brute_force(spark, block):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(260):
        v = centres[rng.integers(12)] + rng.normal(size=8) * rng.choice([0, 0.05, 0.2])
        rows.append((1000 - i, int(rng.integers(3)), v.astype(np.float32).tolist(), 1, "x"))
    rows += [(2000 + i, 1, rows[0][2], 1, "x") for i in range(9)] + [(2100, 1, [2 * x for x in rows[0][2]], 1, "x")]
    rows += [(3000, None, rows[0][2], 1, "x"), (3001, 1, None, 1, "x"), (3002, 1, [0.0] * 8, 1, "x"), (3003, 1, [float("nan")] * 8, 1, "x")]
    rows += [(3004, 1, [None] * 8, 1, "x"), (3005, 1, [float("inf")] * 8, 1, "x"), (3006, 1, [1.0, 0.0], 1, "x"), (3007, 1, [1.0, 0.01], 1, "x"), (3008, 1, [], 1, "x"), (None, 1, rows[0][2], 1, "x")]
    got = ego.near_duplicates(spark.createDataFrame(rows, SHAPE), block=block)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_extreme_lengths_in_double(spark):
    base = [0.3, -0.7, 0.2]
    rows = [(k, 1, [x * s for x in base]) for k, s in enumerate([1.0, 1e200, 1e-200, 1e300, 5e-320])] + [(9, 1, [1.0, 0.0, 0.0])]
    got = ego.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert brute(rows)[0][1] >= 3


def test_recursion_skips_distant_blocks(spark):
    """Clusters far apart: of all pairs of blocks only those within a cluster are left."""
    rng = np.random.default_rng(3)
    centres = np.eye(8)
    rows = [(k, 1, (centres[k % 8] + rng.normal(size=8) * 0.01).tolist()) for k in range(800)]
    seen = []
    real, ego.near_blocks = ego.near_blocks, lambda *a: seen.append(real(*a).collect()) or real(*a)
    try:
        got = ego.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), block=10)
    finally:
        ego.near_blocks = real
    assert {r.component_id for r in got.collect()} == set(range(8)) and all(r.n_links == 99 for r in got.collect())
    assert 80 * 4 < len(seen[0]) < 80 * 10


def test_tiles_are_bounded_by_bytes():
    assert [ego.tile_bits(2048, w) for w in (1, 64, 768, 1024, 5000)] == [3, 3, 2, 2, 0]


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_dense_tiles(spark, monkeypatch, bits):
    """One cluster that fills every pair of blocks, in tiles of any size."""
    monkeypatch.setattr(ego, "TILE_BITS", bits)
    rng = np.random.default_rng(9)
    rows = [(k, 1, (np.eye(6)[0] + rng.normal(size=6) * 0.06).tolist()) for k in range(240)]
    got = ego.near_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), block=8)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_table_and_empty(spark, sf):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(map(tuple, ego.op6_ego_join(spark, sf).collect()), key=str) == brute(rows)
    assert ego.near_duplicates(spark.createDataFrame([], SHAPE)).collect() == []


def test_ids_that_are_no_numbers(spark):
    """Strings in their own order, also where one id has two vectors, and a null one."""
    rows = [("b10", 1, [1.0, 0.0]), ("b9", 1, [1.0, 0.01]), ("a", 1, [1.0, 0.001]), ("c", 1, [0.0, 1.0]), ("z", 1, [0.0, 1.0]), ("z", 2, [0.0, 1.0]), (None, 1, [0.0, 1.0]), ("d", None, [1.0, 0.0])]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in ego.near_duplicates(spark.createDataFrame(rows, "vec_id string, label int, embedding array<float>")).collect()}
    assert got == {("a", 2, "a", True), ("b10", 2, "a", False), ("b9", 2, "a", False), ("c", 1, "c", True), ("z", 1, "c", False), ("z", 0, "z", True), (None, 0, None, None), ("d", 0, "d", True)}
