import datetime

import numpy as np
import pytest

from siltstone.operators import query_filters, retrieval, search
from siltstone.operators.text_index import TextIndex
from siltstone.operators.vector_index import VectorIndex
from siltstone.sources import corpus
from siltstone.sources.snapshots import BUCKET, Store
from siltstone.sources.storage import run


@pytest.fixture(autouse=True)
def own_run(spark):
    with run(spark):
        yield


def rows(df):
    return sorted(map(tuple, df.collect()))


def clustered(rng, n, clusters=40, dims=32):
    centres = rng.normal(size=(clusters, dims))
    return centres[rng.integers(clusters, size=n)] + 0.15 * rng.normal(size=(n, dims))


def frame(spark, data, name="embedding", id_col="chunk_id"):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(data)], f"{id_col} long, {name} array<double>")


@pytest.fixture(scope="module")
def vectors(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    data = clustered(rng, 3000)
    table = frame(spark, data).union(spark.createDataFrame([(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9004, [1.0, 2.0]), (9005, [2.0, 1.0])], "chunk_id long, embedding array<double>"))
    queries = frame(spark, data[rng.integers(3000, size=30)] + 0.05 * rng.normal(size=(30, 32)), "query_vector", "query_id").union(spark.createDataFrame([(900, [1.0, 1.9]), (901, None)], "query_id long, query_vector array<double>"))
    store = Store(spark, str(tmp_path_factory.mktemp("vectors")))
    return table, queries, VectorIndex.build(store, table)


def test_exact_search_over_cells(vectors):
    table, queries, index = vectors
    want = search.vector_arm(queries, table, 10)
    assert rows(index.nearest(queries, 10)) == rows(want)


def test_near_search_reads_few_cells_and_finds_most(spark, vectors):
    """Recall at 10 of 0.9 or more from under a fifth of the cells; files of other cells are not in the plan."""
    table, queries, index = vectors
    model = index.model()
    n = len(model.centres)
    probes = max(1, n // 10)
    want = {(r.query_id, r.chunk_id) for r in search.vector_arm(queries, table, 10).collect()}
    got = {(r.query_id, r.id) for r in index.approximate(queries, 10, probes).collect()}
    assert len(want & got) >= 0.9 * len(want) and {(900, 9004), (900, 9005)} <= got
    one = queries.where("query_id = 3")
    looks = index._looks(one.collect(), model, probes)[0][1]
    files = index.vectors(looks).inputFiles()
    assert {int(f.split(f"{BUCKET}=")[1].split("/")[0]) for f in files} <= set(looks) and probes < n / 5
    assert [r.id for r in index.approximate(one, 10, probes).collect()]


def test_exact_search_leaves_far_cells_out(vectors):
    _, queries, index = vectors
    asked = []
    real = VectorIndex._among
    try:
        VectorIndex._among = lambda self, rows, kind, cells, *a: (asked.append({c for own in cells for c in own}), real(self, rows, kind, cells, *a))[1]
        index.nearest(queries.where("query_id = 3"), 10).collect()
    finally:
        VectorIndex._among = real
    assert len(set().union(*asked)) < 0.5 * len(index.model().centres)


def test_queries_come_in_parts(vectors, monkeypatch):
    """Of several parts each is stored before the next is on the driver."""
    table, queries, index = vectors
    monkeypatch.setattr(search, "QUERY_PART_BYTES", 2000)
    parts = list(search.query_parts(queries))
    assert len(parts) > 3 and sum(map(len, parts)) == 31
    want = rows(search.vector_arm(queries, table, 5))
    monkeypatch.undo()
    assert want == rows(search.vector_arm(queries, table, 5)) == rows(index.nearest(queries, 5))


def test_vectors_come_and_go(spark, tmp_path):
    rng = np.random.default_rng(4)
    data = clustered(rng, 600)
    first, more = frame(spark, data).where("chunk_id < 400"), frame(spark, data).where("chunk_id >= 400")
    index = VectorIndex.build(Store(spark, str(tmp_path / "s")), first)
    index.add(more)
    index.remove(spark.createDataFrame([(5,), (401,)], "id long"))
    queries = frame(spark, data[:20], "query_vector", "query_id")
    want = search.vector_arm(queries, frame(spark, data).where("chunk_id not in (5, 401)"), 7)
    assert rows(index.nearest(queries, 7)) == rows(want)


def test_an_empty_vector_index(spark, tmp_path):
    index = VectorIndex.build(Store(spark, str(tmp_path / "s")), frame(spark, np.zeros((0, 4))))
    queries = frame(spark, np.ones((2, 4)), "query_vector", "query_id")
    assert index.nearest(queries, 3).count() == 0 and index.approximate(queries, 3).count() == 0


CHUNKS = [("a", 1, 0, "alpha beta alpha"), ("b", 1, 1, "beta gamma"), ("c", 2, 0, "alpha alpha alpha gamma beta"), ("d", 3, 0, "delta")]
SHAPE = "chunk_id string, document_id long, chunk_index int, content string"


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")


def test_text_index_equals_the_search_without_one(spark, sf, tmp_path):
    chunks, queries = corpus.chunks_view(spark, sf), corpus.queries_view(spark, sf)
    index = TextIndex(Store(spark, str(tmp_path / "s")), stems=False).build(chunks, 8)
    for limit in (3, 100):
        want = search.text_arm(queries, search.postings(chunks, stems=False, only=search.query_terms(queries, stems=False)), limit, stems=False)
        assert rows(index.ranked(queries, limit)) == rows(want)


def test_searches_read_their_terms_buckets_and_no_text(spark, tmp_path):
    index = TextIndex(Store(spark, str(tmp_path / "s"))).build(spark.createDataFrame(CHUNKS, SHAPE), 32)
    files = index.postings(search.query_terms(asked(spark, "alpha"))).inputFiles()
    assert len(files) == 1 and "postings" in files[0]
    plan = index.ranked(asked(spark, "alpha beta"))._jdf.queryExecution().toString()
    assert "content" not in plan


def test_deltas_and_their_compaction(spark, tmp_path):
    index = TextIndex(Store(spark, str(tmp_path / "s")), stems=False).build(spark.createDataFrame(CHUNKS, SHAPE), 8)
    index.update(spark.createDataFrame([("c", 2, 0, "delta only"), ("e", 4, 0, "alpha new beta")], SHAPE), spark.createDataFrame([("b",)], "chunk_id string"))
    now = [CHUNKS[0], ("c", 2, 0, "delta only"), CHUNKS[3], ("e", 4, 0, "alpha new beta")]
    queries = asked(spark, "alpha", "beta alpha", "gamma", "delta")
    want = rows(search.text_arm(queries, search.postings(spark.createDataFrame(now, SHAPE), stems=False), stems=False))
    assert rows(index.ranked(queries)) == want
    index.compact()
    assert rows(index.ranked(queries)) == want
    assert index.store.read("postings").where("term = 'gamma'").count() <= 2 and len(index.store.manifest()["tables"]["postings"]["buckets"]) <= 8


DAY = datetime.date(2024, 5, 1)
DOCS = [(1, "active", "r1", "docs/a.md", DAY, ["AC-1"], ["en"]), (2, "draft", "r2", "docs/b.md", None, ["AC-2", "SC-1"], []), (3, "active", None, "notes%/c.md", datetime.date(2020, 1, 1), None, ["t1"])]
DOC_SHAPE = "document_id long, status string, repo string, path string, last_reviewed date, controls array<string>, tags array<string>"
FILTERS = [
    (None, None, None, None, None, None),
    (["active"], None, None, None, None, None),
    ([], None, None, None, None, None),
    (None, ["r1", "r2"], None, None, None, None),
    (None, [], None, None, None, None),
    (None, None, ["docs/", "x"], None, None, None),
    (None, None, ["notes%"], None, None, None),
    (None, None, ["notes_"], None, None, None),
    (None, None, None, DAY, None, None),
    (None, None, None, None, ["SC-1", "AC-1"], None),
    (None, None, None, None, None, ["t1", "own"]),
    (["active", "draft"], ["r2", "r1"], ["docs/"], datetime.date(2000, 1, 1), ["AC-1"], ["en"]),
]
FILTER_SHAPE = "query_id int, status array<string>, repo array<string>, path_prefix array<string>, last_reviewed_after date, control_id array<string>, tags array<string>"


def meets(f, doc, own_tags):
    status, repo, prefix, day, controls, tags = f
    _, s, r, p, d, cs, ts = doc
    return (
        (status is None or s in status) and (not repo or r in repo) and (not prefix or any(p.startswith(x) for x in prefix)) and (day is None or (d is not None and d >= day))
        and (not controls or bool(set(controls) & set(cs or []))) and (not tags or bool(set(tags) & set((ts or []) + (own_tags or []))))
    )


def test_filters_by_query(spark):
    """Each kind of filter, alone and together, for documents with nulls and empty lists, in parts of few filters."""
    tags = {"a": ["own"], "b": None, "c": [], "d": ["t1"]}
    chunks = spark.createDataFrame([(c, d, tags[c]) for c, d, *_ in CHUNKS], "chunk_id string, document_id long, tags array<string>")
    queries = spark.createDataFrame([(k, *f) for k, f in enumerate(FILTERS)], FILTER_SHAPE).union(spark.createDataFrame([(99, *FILTERS[1])], FILTER_SHAPE))
    want = {(k, c) for k, f in [*enumerate(FILTERS), (99, FILTERS[1])] for c, d, *_ in CHUNKS for doc in DOCS if doc[0] == d and meets(f, doc, tags[c])}
    for most in (4096, 5):
        got, n = set(), 0
        for own, filters in query_filters.numbered(queries, most):
            n += len(filters)
            fits = {r.chunk_id: np.unpackbits(np.frombuffer(r.fits, np.uint8)) for r in query_filters.fitting(chunks, spark.createDataFrame(DOCS, DOC_SHAPE), filters).collect()}
            got |= {(q.query_id, c) for q in own.collect() for c, bits in fits.items() if bits[q.filter]}
        assert got == want and n == len(FILTERS)


def test_filtered_hybrid_finds_what_a_late_filter_would_lose(spark, tmp_path):
    """The only chunk of a rare document is found behind hundreds of better ones of others, in both arms."""
    many = [(f"m{k}", 10, k, "alpha " * 5) for k in range(300)] + [("rare", 11, 0, "alpha once here")]
    vectors = [(c, [1.0, 0.001 * k]) for k, (c, *_) in enumerate(many)]
    docs = spark.createDataFrame([(10, "active", "big", "p", DAY, [], []), (11, "active", "small", "q", DAY, [], [])], DOC_SHAPE)
    index = retrieval.SearchIndex.at(spark, str(tmp_path / "s"), stems=False).build(spark.createDataFrame(many, SHAPE), spark.createDataFrame(vectors, "chunk_id string, embedding array<double>"))
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0], ["small"]), (2, "alpha", [1.0, 0.0], None)], "query_id int, query string, query_vector array<double>, repo array<string>")
    found = retrieval.hybrid(queries, docs, index, "2024-06-01").collect()
    assert [r.chunk_id for r in found if r.query_id == 1] == ["rare"]
    assert [r.base_score for r in found if r.query_id == 1] == [1.0]
    assert len([r for r in found if r.query_id == 2]) == 10


def test_an_index_is_changed_as_a_whole(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, SHAPE)
    vectors = spark.createDataFrame([(c, [float(k), 1.0]) for k, (c, *_) in enumerate(CHUNKS)], "chunk_id string, embedding array<double>")
    index = retrieval.SearchIndex.at(spark, str(tmp_path / "s"), stems=False).build(chunks, vectors)
    index.update(spark.createDataFrame([("d", 3, 0, "alpha now")], SHAPE), spark.createDataFrame([("d", [5.0, 0.0])], "chunk_id string, embedding array<double>"), spark.createDataFrame([("a",)], "chunk_id string"))
    assert index.store.manifest()["version"] == 2
    queries = spark.createDataFrame([(1, "alpha", [1.0, 0.0])], "query_id int, query string, query_vector array<double>")
    near, text = index.arms(queries)
    assert [r.chunk_id for r in near.orderBy("rnk").collect()] == ["d", "c", "b"]
    assert {r.chunk_id for r in text.collect()} == {"c", "d"}


def test_postings_are_put_together_without_a_shuffle(spark):
    chunks = spark.createDataFrame([*CHUNKS, ("n", 9, 0, None), ("s", 9, 1, "the of"), ("t", 9, 2, "of beta the beta")], SHAPE)
    made = search.postings(chunks, stems=False)
    assert "Exchange" not in made._jdf.queryExecution().toString()
    assert sorted((r.chunk_id, r.positions) for r in made.where("term = 'beta'").collect()) == [("a", [1]), ("b", [0]), ("c", [4]), ("t", [1, 3])]
    assert {r.term for r in made.collect()} == {"alpha", "beta", "gamma", "delta"}


def test_a_sample_is_the_smallest_hashes_and_little_more_is_sent(spark):
    """A sort with a limit would send as many rows as are wanted from each task."""
    table = spark.range(0, 60_000, 1, 16).selectExpr("id")
    n = search.about(table)
    assert abs(n - 60_000) < 6_000
    want = [r.id for r in table.orderBy(search.F.xxhash64("id")).limit(200).collect()]
    assert [r.id for r in search.smallest_hashes(table, n, 200)] == want
    asked = []
    real = type(table).collect
    try:
        type(table).collect = lambda self: asked.append(self.count()) or real(self)
        search.smallest_hashes(table, n, 200)
    finally:
        type(table).collect = real
    assert 200 <= asked[0] < 500


def test_a_filter_that_few_pass_is_searched_again(spark, tmp_path):
    """Some queries see enough among the nearest of all, others hardly anything: both get the exact nearest that they may see."""
    rng = np.random.default_rng(6)
    data = clustered(rng, 500)
    index = VectorIndex.build(Store(spark, str(tmp_path / "s")), frame(spark, data))
    queries = frame(spark, data[:6], "query_vector", "query_id").withColumn("filter", search.F.when(search.F.col("query_id") < 3, 0).otherwise(1))
    allowed = spark.createDataFrame([(k, bytes([(128 if k % 10 else 0) | (64 if k % 97 == 0 else 0)])) for k in range(500)], "id long, fits binary")
    got = rows(index.nearest(queries, 5, allowed))
    want = [r for bit, own in ((0, lambda k: k % 10), (1, lambda k: k % 97 == 0)) for r in search.vector_arm(queries.where(f"filter = {bit}").drop("filter"), frame(spark, data).where(search.F.col("chunk_id").isin([k for k in range(500) if own(k)])), 5).collect()]
    assert got == sorted(map(tuple, want))


def test_an_index_without_texts_reads_them_elsewhere(spark, tmp_path):
    chunks = spark.createDataFrame(CHUNKS, SHAPE)
    vectors = spark.createDataFrame([(c, [float(k), 1.0]) for k, (c, *_) in enumerate(CHUNKS)], "chunk_id string, embedding array<double>")
    docs = spark.createDataFrame(DOCS, DOC_SHAPE)
    queries = spark.createDataFrame([(1, "alpha beta", [1.0, 0.0])], "query_id int, query string, query_vector array<double>")
    slim = retrieval.SearchIndex.at(spark, str(tmp_path / "a"), stems=False).build_text(chunks, texts=False)
    assert not slim.built() and slim.built(vectors=False) and "content" not in slim.text.chunks().columns
    slim.build_vectors(vectors)
    whole = retrieval.SearchIndex.at(spark, str(tmp_path / "b"), stems=False).build(chunks, vectors)
    texts = lambda wanted: chunks.join(wanted, "document_id", "left_semi")
    columns = ["chunk_id", "score", "rn", "content", "chunk_count"]
    assert rows(retrieval.hybrid(queries, docs, slim, "2024-06-01", texts=texts).select(columns)) == rows(retrieval.hybrid(queries, docs, whole, "2024-06-01").select(columns))
