"""Search in one pass over the tables, without an index."""

import re

import numpy as np
import pytest

from siltstone.operators import retrieval, search
from siltstone.sources import corpus, storage
from siltstone.sources.storage import run
from tests.test_indexes import DAY, DOC_SHAPE, DOCS, SHAPE, rows


@pytest.fixture(autouse=True)
def own_run(spark):
    with run(spark):
        yield


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


@pytest.mark.parametrize("stems", [False, True])
def test_chunks_are_ranked_where_they_are_read(spark, stems, monkeypatch):
    """Every chunk with all terms, ranked as from postings: repeats, gaps, stop words, texts that are empty or null, batches of few rows, queries in parts."""
    rng = np.random.default_rng(5)
    words = np.array(["alpha", "beta", "gamma", "the", "running", "runs", "été", "x1"])
    texts = [" ".join(rng.choice(words, size=rng.integers(0, 40))) for _ in range(200)] + ["", None, "alpha", "beta alpha"]
    chunks = spark.createDataFrame([(f"c{k}", k, 0, t) for k, t in enumerate(texts)], SHAPE)
    queries = asked(spark, "alpha", "beta alpha", "alpha beta beta the", "running gamma alpha x1", "the", "", "été", "nowhere", "alpha nowhere", "runs", None)
    want = rows(search.text_arm(queries, search.postings(chunks, stems=stems), 1000, stems=stems).drop("rnk"))
    assert len(want) > 500
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert rows(search.matched(queries, chunks, stems=stems)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    monkeypatch.setattr(search, "PASS_QUERIES", 3)
    assert rows(search.matched(queries, chunks, stems=stems)) == want


def test_matching_shuffles_no_text_and_no_posting(spark, sf):
    plan = search.matched(corpus.queries_view(spark, sf), corpus.chunks_view(spark, sf), stems=False)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_scan_finds_what_an_index_finds(spark, tmp_path):
    many = [(f"m{k}", 1 + k % 3, k, "alpha " * (k % 7) + "beta") for k in range(300)] + [("rare", 4, 0, "alpha once here")]
    vectors = spark.createDataFrame([(c, [1.0, 0.001 * k]) for k, (c, *_) in enumerate(many)], "chunk_id string, embedding array<double>")
    docs = spark.createDataFrame([*DOCS, (4, "active", "small", "q", DAY, [], [])], DOC_SHAPE)
    chunks = spark.createDataFrame(many, SHAPE)
    index = retrieval.SearchIndex.at(spark, str(tmp_path / "s"), stems=False).build(chunks, vectors)
    scan = retrieval.Scan(chunks.drop("content"), chunks, lambda own: own.join(vectors, "chunk_id"), stems=False)
    texts = lambda wanted: chunks.join(wanted, "document_id", "left_semi")
    plain = spark.createDataFrame([(1, "alpha", [1.0, 0.0]), (2, "beta alpha", [1.0, 0.2]), (3, "", [0.0, 1.0])], "query_id int, query string, query_vector array<double>")
    filtered = spark.createDataFrame([(1, "alpha", [1.0, 0.0], ["small"]), (2, "alpha beta", [1.0, 0.0], None), (3, "beta", [1.0, 0.0], ["r1", "r2"])], "query_id int, query string, query_vector array<double>, repo array<string>")
    columns = ["query_id", "chunk_id", "base_score", "score", "rn", "content", "chunk_count"]
    for queries in (plain, filtered):
        got = rows(retrieval.hybrid(queries, docs, scan, "2024-06-01", texts=texts).select(columns))
        assert got == rows(retrieval.hybrid(queries, docs, index, "2024-06-01").select(columns))
    assert [r.chunk_id for r in retrieval.hybrid(filtered, docs, scan, "2024-06-01", texts=texts).collect() if r.query_id == 1] == ["rare"]


@pytest.mark.parametrize(
    "name",
    ["score_distribution", "hybrid_filtered", "expected_in_top", "golden_overall", "expanded_search", "grading_worksheet", "hybrid_search", "result_cards", "warning_kinds", "shown_warnings", "calibration", "bucket_precision", "context_packs", "conflicts", "warnings", "card_warnings"],
)
def test_a_table_of_queries_is_searched_without_writing_an_index(spark, sf, name, monkeypatch):
    """What a search stores is narrow: no postings and no vectors (both were written for each, and were most of its time and bytes)."""
    from siltstone.plans import registry
    from siltstone.sources.snapshots import Change

    monkeypatch.setattr(Change, "_write", lambda *_: pytest.fail("an index was written"))
    kept, wide = storage.stored, []
    note = lambda df, what, *more: wide.extend(f.name for f in df.schema.fields if re.match("positions|embedding", f.name)) or kept(df, what, *more)
    for module in (search, retrieval):
        monkeypatch.setattr(module, "stored", note)
    assert registry.queries()[name](spark, sf).count() > 0
    assert not wide


def test_a_task_holds_few_of_its_first_vectors(monkeypatch):
    """Before any bound is known, a query's bound comes from the first block: all of its vectors were held (and sorted) for every query."""
    rng = np.random.default_rng(3)
    a, b = search._unit(rng.normal(size=(40, 16))), search._unit(rng.normal(size=(3000, 16)))
    b[100:200] = b[:100]  # ties
    ids, exact = np.array([f"{k:04}" for k in range(3000)], object), np.round(1 - a @ b.T, 9)
    found = search._Nearest(40, 10)
    found.near(ids, (a @ b.T).astype(np.float32), np.arange(40), lambda q, r: np.einsum("ij,ij->i", a[q], b[r]), 1e-5)
    assert found.size < 40 * 15
    q, d, i = found.best()
    for k in range(40):
        assert list(zip(i[q == k], d[q == k].round(9), strict=True)) == [(ids[x], exact[k, x].round(9)) for x in np.lexsort((ids, exact[k]))[:10]]


@pytest.mark.parametrize("block", [50, 1 << 21])
def test_vectors_are_compared_in_blocks_of_queries(spark, block, monkeypatch):
    """Filters, ties, sizes that differ and more queries than a block takes: as by brute force."""
    rng = np.random.default_rng(4)
    v, q = rng.integers(-2, 3, size=(300, 4)).astype(float), rng.integers(-2, 3, size=(30, 4)).astype(float)
    v, q = v[np.abs(v).sum(1) > 0], q[np.abs(q).sum(1) > 0]
    met = rng.random((len(v), 3)) < 0.4
    vectors = spark.createDataFrame([(f"v{k:03}", x.tolist(), bytearray(np.packbits(m).tobytes())) for k, (x, m) in enumerate(zip(v, met, strict=True))], "chunk_id string, embedding array<double>, fits binary")
    queries = spark.createDataFrame([(k, x.tolist(), k % 3) for k, x in enumerate(q)], "query_id int, query_vector array<double>, filter int")
    monkeypatch.setattr(search, "BLOCK", block)
    got = {}
    for r in search.vector_arm(queries, vectors, 7).orderBy("query_id", "rnk").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, r.distance))
    far = np.round(1 - (q / np.linalg.norm(q, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T, 9) + 0.0
    for k in range(len(q)):
        own = sorted((far[k, x], f"v{x:03}") for x in range(len(v)) if met[x, k % 3])[:7]
        assert [(c, round(d, 9)) for c, d in got[k]] == [(c, round(d, 9)) for d, c in own]


@pytest.mark.parametrize("filtered", [False, True])
def test_a_task_gives_out_a_querys_best_matches_only(spark, filtered):
    """A word of every chunk made a row for each chunk and query; ties, filters and repeated queries come out as from all of them."""
    rng = np.random.default_rng(6)
    words = np.array(["alpha", "beta", "gamma", "common"])
    texts = [" ".join(["common", *rng.choice(words, size=rng.integers(0, 30))]) for _ in range(2000)]
    met = rng.random((2000, 2)) < 0.3
    chunks = spark.createDataFrame([(f"c{k}", t, bytearray(np.packbits(m).tobytes())) for k, (t, m) in enumerate(zip(texts, met, strict=True))], "chunk_id string, content string, fits binary").repartition(3)
    queries = asked(spark, *["common", "alpha beta", "common gamma", "common", "beta"] * 10)
    if filtered:
        queries = queries.selectExpr("*", "query_id % 2 as filter")
    every = [r for r in search.matched(queries.drop("filter"), chunks, stems=False).collect() if not filtered or met[int(r.chunk_id[1:]), r.query_id % 2]]
    few = search.matched(queries, chunks, stems=False, limit=5).collect()
    best = lambda found: [sorted(((-r.rank_score, r.chunk_id) for r in found if r.query_id == k))[:5] for k in range(50)]
    assert best(few) == best(every)
    assert len(every) > 10_000 and len(few) < 50 * 3 * 15


def test_chunks_of_documents_are_searched_where_they_are_read(spark, sf):
    """Documents split in place give what keys that are joined give, with filters and without; the text arm joins and shuffles nothing before its cut."""
    from siltstone.plans import search_queries

    queries, docs, scan = search_queries._scan(spark, sf)
    joined = retrieval.Scan(scan.keys, scan.contents, scan.vectors, stems=False)
    columns = ["query_id", "chunk_id", "score", "rn"]
    for own in (queries, search_queries._with_filters(queries)):
        assert rows(retrieval.fused(own, docs, scan).select(columns)) == rows(retrieval.fused(own, docs, joined).select(columns))
    split = scan.split(docs.select("document_id", "text"))
    plan = search.matched(queries, split, stems=False, limit=100)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
