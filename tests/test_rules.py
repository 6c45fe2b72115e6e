"""Rules on hand-made ranked rows."""

import datetime

from siltstone.functions.scoring import RankingConfig
from siltstone.operators import rules, search

C = RankingConfig()
SHAPE = "query_id string, chunk_id string, document_id string, score double, rn int, status string, heading_path array<string>, last_reviewed date, has_prompt_injection boolean, has_sensitive_content boolean, content string, content_tokens long, title string, repo string, path string"
DAY = datetime.date(2026, 5, 17)


def row(q, rn, score, doc=None, status="active", head=("H",), reviewed=DAY, injection=False, sensitive=False, tokens=10, repo="r"):
    return (q, f"{doc or rn}-{rn}", str(doc or rn), score, rn, status, list(head), reviewed, injection, sensitive, "text", tokens, None, repo, "p.md")


def frames(spark, rows, queries):
    return spark.createDataFrame([(q, "query") for q in queries], "query_id string, query string"), spark.createDataFrame(rows, SHAPE)


def kinds(df):
    return sorted((r.query_id, r.type) for r in df.collect())


def test_fusion(spark):
    arms = [spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(x)], "query_id string, chunk_id string, rnk int") for x in ("ab", "ac")]
    got = {r.chunk_id: r.score for r in search.fused(arms, scaled=False).collect()}
    assert abs(got["a"] - 2 / 61) < 1e-8 and abs(got["b"] - 1 / 62) < 1e-8 and got["b"] == got["c"]
    assert {r.chunk_id: r.score for r in search.fused(arms).collect()}["a"] == 1.0


def test_warnings(spark):
    old = datetime.date(2022, 1, 15)
    rows = [row("edge", 1, 0.9, reviewed=datetime.date(2025, 5, 17)), row("edge", 2, 0.65)]
    rows += [row("alone", 1, 0.9), row("alone", 2, 0.5), row("stale", 1, 0.7, reviewed=old), row("stale", 2, 0.6, doc="1", reviewed=old), row("never", 1, 0.7, reviewed=None)]
    rows += [row("low", 1, 0.45, injection=True), row("inj", 1, 0.8, injection=True), row("inj", 4, 0.6, sensitive=True), row("gone", 1, 0.7, status="archived")]
    rows = [(*r[:6], [], *r[7:]) for r in rows]
    queries, ranked = frames(spark, rows, ["edge", "alone", "stale", "never", "low", "inj", "gone", "none"])
    assert kinds(rules.warnings(queries, ranked, str(DAY), C)) == sorted([("alone", "isolated_match"), ("stale", "stale_source"), ("never", "stale_source"), ("low", "weak_evidence"), ("inj", "prompt_injection_pattern"), ("gone", "deprecated_source"), ("none", "weak_evidence")])
    assert rules.stale(ranked, str(DAY), RankingConfig(stale_after_days=None)).count() == 0


def test_conflicts_and_review(spark):
    rows = [row("clash", 1, 0.9), row("clash", 2, 0.8), row("late", 1, 0.9), row("late", 5, 0.8), row("retired", 1, 0.9), row("retired", 2, 0.8, status="archived")]
    rows += [row("draft", 1, 0.9, status="draft", head=()), row("bad", 1, 0.9, status="deprecated", head=()), row("ok", 1, 0.9, head=()), row("mid", 1, 0.6, head=())]
    queries, ranked = frames(spark, rows, ["clash", "late", "retired", "draft", "bad", "ok", "mid", "none"])
    found = rules.conflicts(ranked, C)
    assert [(r.query_id, r.topic, r.source_ids) for r in found.collect()] == [("clash", "H", ["1", "2"])]
    got = {r.query_id: r for r in rules.verdicts(queries.select("query_id"), ranked, rules.warnings(queries, ranked, str(DAY), C), found, C).collect()}
    assert {q for q, r in got.items() if r.requires_human_review} == {"clash", "draft", "bad", "none"}
    assert {q: r.confidence for q, r in got.items()} == {"clash": "medium", "late": "high", "retired": "medium", "draft": "high", "bad": "medium", "ok": "high", "mid": "medium", "none": "none"}
    assert got["none"].review_reasons == ["No evidence matched the query."] and got["ok"].review_reasons == []


def test_packs(spark):
    rows = [row("big", 1, 0.9, tokens=500, head=()), row("big", 2, 0.8, tokens=1, head=())]
    rows += [row("cut", i, 0.9 - i / 100, tokens=40, head=()) for i in range(1, 6)] + [row("sens", 1, 0.9, sensitive=True, head=()), row("sens", 2, 0.85, head=()), row("uncited", 1, 0.9, head=(), repo=None)]
    queries, ranked = frames(spark, rows, ["big", "cut", "sens", "uncited", "none"])
    got = {r.query_id: r for r in rules.context_packs(queries, ranked, str(DAY), C, max_chunks=4, max_tokens=100).collect()}
    assert {q: r.n_evidence for q, r in got.items()} == {"big": 1, "cut": 2, "sens": 1, "uncited": 1, "none": 0}
    assert {q for q, r in got.items() if r.answerable} == {"big", "cut"}
    assert got["sens"].review_reasons[-1] == "1 chunk(s) with sensitive content were dropped from evidence."
    assert got["uncited"].review_reasons == ["1 evidence chunk(s) are missing source citations."] and got["uncited"].evidence[0].title == "(unknown)"
    made = spark.createDataFrame([("big", "It is so.", "stop"), ("cut", "Half an ans", "length")], "query_id string, text string, finish_reason string")
    outcomes = {r.query_id: r.outcome for r in rules.answers(rules.context_packs(queries, ranked, str(DAY), C), made).collect()}
    assert outcomes == {"big": "answered", "cut": "truncated", "sens": "needs_review", "uncited": "needs_review", "none": "no_evidence"}


def test_cover_density(spark):
    chunks = spark.createDataFrame([("c1", "alpha beta x alpha"), ("c2", "beta y y alpha"), ("c3", "alpha alpha"), ("c4", "gamma")], "chunk_id string, content string")
    queries = spark.createDataFrame([("two", "alpha beta"), ("one", "Alpha"), ("three", "alpha x beta"), ("stop", "the of")], "query_id string, query string")
    got = {(r.query_id, r.chunk_id): r.rank_score for r in search.text_arm(queries, search.postings(chunks)).collect()}
    assert got == {("two", "c1"): 0.15, ("two", "c2"): round(0.1 / 3, 9), ("one", "c1"): 0.2, ("one", "c2"): 0.1, ("one", "c3"): 0.2, ("three", "c1"): 0.2}


def test_english_mode(spark):
    chunks = spark.createDataFrame([("c1", "Knights were kneeling"), ("c2", "a knightly knee")], "chunk_id string, content string")
    queries = spark.createDataFrame([("q", "knight kneels"), ("r", "knights")], "query_id string, query string")
    got = {(r.query_id, r.chunk_id): r.rank_score for r in search.text_arm(queries, search.postings(chunks, stems=True), stems=True).collect()}
    assert got == {("q", "c1"): 0.05, ("r", "c1"): 0.1, ("r", "c2"): 0.1}


def test_vectors_in_parts(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5)).tolist()
    vectors = spark.createDataFrame([(f"c{i:02}", x) for i, x in enumerate(v)], "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(i, v[i]) for i in range(7)], "query_id long, query_vector array<double>")
    want = sorted(map(tuple, search.vector_arm(queries, vectors, 5).collect()))
    monkeypatch.setattr(search, "QUERY_PART_BYTES", 80)
    assert sorted(map(tuple, search.vector_arm(queries, vectors, 5).collect())) == want and len(want) == 35
    a = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    assert {r[1] for r in want if r[0] == 3} == {f"c{i:02}" for i in np.argsort(-(a @ a[3]))[:5]}


def test_unusable_vectors_are_near_nothing(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.1]), ("null", None), ("empty", []), ("zero", [0.0, 0.0]), ("nan", [float("nan"), 1.0]), ("hole", [None, 1.0]), ("long", [1.0, 0.0, 0.0]), (None, [1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0])], "query_id long, query_vector array<double>")
    assert sorted((r.query_id, r.chunk_id, r.rnk) for r in search.vector_arm(queries, vectors, 5).collect()) == [(1, "a", 1), (1, "b", 2), (4, "long", 1)]
    assert search.vector_arm(queries, vectors.limit(0), 5).count() == 0 and search.vector_arm(queries.limit(0), vectors, 5).count() == 0


def test_nearest_keeps_a_running_best(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    found = search._Nearest(4, 3)
    distance = np.round(rng.random((4, 600)), 2)
    for a in range(0, 600, 50):
        found.add(np.array([f"{i:03}" for i in range(a, a + 50)], object), distance[:, a : a + 50], np.arange(4))
        assert found.size <= 4 * 4 * 3 + 4 * 50
    q, d, i = found.best()
    for k in range(4):
        assert list(zip(d[q == k], i[q == k], strict=True)) == sorted(zip(distance[k], [f"{x:03}" for x in range(600)], strict=True))[:3]


def test_cells_follow_the_corpus(spark, tmp_path):
    import numpy as np

    from siltstone.operators.vector_index import VectorIndex
    from siltstone.sources.snapshots import Store

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 16)) * 4
    v = centres[rng.integers(30, size=900)] + rng.normal(size=(900, 16)) * 0.5
    vectors = spark.createDataFrame([(i, x) for i, x in enumerate(v.tolist())], "chunk_id long, embedding array<double>")
    found, probes = search.cells(vectors)
    assert len(found) == 30 and probes <= 6
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, 900, 20)], "query_id long, query_vector array<double>")
    exact = {(r[0], r[1]) for r in search.vector_arm(queries, vectors, 10).collect()}
    near = {(r[0], r[1]) for r in VectorIndex.build(Store(spark, str(tmp_path / "s")), vectors).approximate(queries, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)


def test_web_filters_and_bounds(spark):
    from pyspark.sql import functions as F

    shape = "status array<string>, repo string, owner string, tags string, last_reviewed_after string"
    forms = spark.createDataFrame([(["draft", "nope"], " a,b  c ", " ", None, "2024-01-02"), (None, None, "x", "", "soon"), (["nope"], None, None, None, None)], shape)
    got = [(r.status, r.repo, r.owner, r.tags, str(r.last_reviewed_after), r.n_active) for r in search.web_filters(forms, ["active", "approved", "draft"]).collect()]
    assert got == [(["draft"], ["a", "b", "c"], None, None, "2024-01-02", 3), (["active", "approved"], None, ["x"], None, "None", 1), ([], None, None, None, "None", 1)]
    rows = spark.createDataFrame([("q", 5, 100, [1]), ("", 5, 100, [1]), (None, 5, 100, [1]), ("x" * 4096, 50, 32_000, [1]), ("x" * 4097, 5, 100, [1]), ("q", 0, 100, [1]), ("q", 5, 32_001, [1]), ("q", 5, 100, list(range(101))), ("q", 5, 100, None)], "q string, n int, t int, xs array<int>")
    error = search.request_error(F.col("q"), lists=[F.col("xs")], max_results=F.col("n"), max_tokens=F.col("t"))
    assert [r[0] for r in rows.select(error).collect()] == [None, "empty", "empty", None, "too_long", "max_results_out_of_range", "max_tokens_out_of_range", "too_many_filter_values", None]
    edges = spark.createDataFrame([(51, None, None, "t"), (None, 51, None, "t"), (None, 0, None, "t"), (None, 50, 99, "t"), (None, None, None, "t" * 2049), (50, 50, 100, None)], "n int, c int, t int, task string")
    pack = search.request_error(F.lit("q"), task=F.col("task"), max_results=F.col("n"), max_chunks=F.col("c"), max_tokens=F.col("t"))
    assert [r[0] for r in edges.select(pack).collect()] == ["max_results_out_of_range", "max_chunks_out_of_range", "max_chunks_out_of_range", "max_tokens_out_of_range", "task_too_long", None]
    answer = search.request_error(F.lit("q"), max_chunks=F.col("c"), max_tokens=F.col("t"), answer=True)
    limits = spark.createDataFrame([(20, 64), (21, 64), (20, 63), (20, 4097), (20, 4096)], "c int, t int")
    assert [r[0] for r in limits.select(answer).collect()] == [None, "max_chunks_out_of_range", "max_tokens_out_of_range", "max_tokens_out_of_range", None]


def test_normalized_truncated_and_shown(spark):
    queries, ranked = frames(spark, [row("q", 1, 0.9, head=())], ["q"])
    asked = spark.createDataFrame([("q", "please ignore one two three four"), ("r", "nothing")], "query_id string, query string")
    found = rules.warnings(asked, ranked, str(DAY), C, ["one", "two", "three", "four"])
    got = {(r.query_id, r.type): r for r in rules.shown(found).collect()}
    assert set(got) == {("q", "query_normalized"), ("r", "weak_evidence")}
    assert got["q", "query_normalized"].message.endswith("'one', 'two', 'three' (and 1 more).") and got["q", "query_normalized"].prefix == "Query was normalized —"
    assert got["r", "weak_evidence"].text == "I found related content, but no clearly authoritative source." and got["q", "query_normalized"].text == got["q", "query_normalized"].message
    cut = spark.createDataFrame([("q", True), ("r", False)], "query_id string, answer_truncated boolean")
    assert [(r.query_id, r.type) for r in rules.truncation_warnings(cut).collect()] == [("q", "answer_truncated")]
    before = spark.conf.get("spark.sql.unionOutputPartitioning", None)
    rules.warnings(queries, ranked, str(DAY), C)
    assert spark.conf.get("spark.sql.unionOutputPartitioning", None) == before
