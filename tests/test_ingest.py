import datetime

import pytest

from siltstone.functions import providers
from siltstone.functions.markdown import chunks_of, parse_documents, sections_of
from siltstone.operators import evaluation, ingest
from siltstone.sources import files


def test_folder_source(spark, tmp_path):
    for name, data in {"alpha.md": b"# A\n\nzebra", "deep/topic.md": "é".encode(), "deep/raw.md": b"\xff\xfe\xff", ".git/config": b"x", "n.txt": b"x", "big.md": b"x" * 99}.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    found = files.folder(spark, f"file://{tmp_path}/tree", "src", "abc123")
    from pyspark.sql import functions as F

    reason = ingest.skip_reason(F.col("path"), F.col("size_bytes"), ["**/*"], [], 50, F.is_valid_utf8("content"))
    got = {r.path: (r.reason, r.commit_sha) for r in found.withColumn("reason", reason).select("path", "reason", "commit_sha").collect()}
    assert got == {"alpha.md": (None, "abc123"), "deep/topic.md": (None, "abc123"), "deep/raw.md": ("binary_content", "abc123"), "n.txt": ("unsupported_file_type", "abc123"), "big.md": ("too_large", "abc123")}
    # Spark's file sources don't list names that start with a dot; the rule holds for other listings.
    assert spark.range(1).select(ingest.denied(F.lit(".git/config"))).first()[0] and spark.range(1).select(ingest.denied(F.lit("docs/.env"))).first()[0]
    good, bad = files.decoded(found)
    assert {r.path: r.text for r in good.collect()}["deep/topic.md"] == "é" and [r.path for r in bad.collect()] == ["deep/raw.md"]


@pytest.mark.parametrize(("glob", "yes", "no"), [("**/*.md", "a/b/c.md", "a.mdx"), ("**/*.md", "c.md", "c_md"), ("docs/*.md", "docs/a.md", "docs/x/a.md"), ("a?c/**", "abc/x/y", "ac/x"), ("x.y", "x.y", "xzy")])
def test_globs(glob, yes, no):
    import re

    assert re.match(ingest.glob_pattern(glob), yes) and not re.match(ingest.glob_pattern(glob), no)


def test_ingest_twice_changes_nothing(spark):
    docs = spark.createDataFrame([("intro.md", "---\ntitle: I\n---\n# I\n\ntext"), ("guide.md", "# G\n\na\n\n## H\n\nb"), ("gone.md", "# X\n\nx")], "document_id string, text string")
    first = chunks_of(parse_documents(docs, ["document_id"]), ["document_id"])
    assert {r.change for r in ingest.chunk_diff(first, first).collect()} == {"unchanged"}
    stored = ingest.merged(first, first, ["document_id", "chunk_index"])
    assert sorted(map(str, stored.select(*first.columns).collect())) == sorted(map(str, first.collect()))
    later = first.where("document_id <> 'gone.md'")
    assert [r.document_id for r in ingest.orphans(first, later).collect()] == ["gone.md"]
    assert ingest.merged(first, later, ["document_id", "chunk_index"], keep_missing=False).count() == later.count()
    rows = sections_of(parse_documents(docs, ["document_id"]), ["document_id"]).collect()
    assert {(r.document_id, r.section_idx, r.heading) for r in rows} == {("intro.md", 0, "I"), ("guide.md", 0, "G"), ("guide.md", 1, "G > H"), ("gone.md", 0, "X")}


class Flaky(providers.HashEmbedder):
    def encode(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        return super().encode(texts)[: len(texts) - any("short" in t for t in texts)]


def test_partial_embedding_failure(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"h{i}", "bad" if i == 3 else "short" if i == 6 else "fine") for i in range(9)], "chunk_id string, content_hash string, content string").coalesce(1)
    out = providers.embedded(chunks, Flaky(8), batch_size=2).cache()
    assert {r.chunk_id for r in out.where("error is not null").collect()} == {"c2", "c3", "c6", "c7"}
    assert providers.checked(out) == {"embedded": 5, "failed": 4}
    vector = out.where("chunk_id = 'c0'").first().embedding
    assert abs(sum(x * x for x in vector) - 1) < 1e-6 and vector == providers.HashEmbedder(8).encode(["fine"])[0]
    with pytest.raises(RuntimeError):
        providers.checked(providers.embedded(chunks.where("chunk_id = 'c3'"), Flaky(8)))
    with pytest.raises(ValueError):
        providers.provider("nope")


def test_expansion_falls_back(spark):
    class Silent(providers.EchoGenerator):
        def generate(self, prompts, options=providers.Options()):
            return [providers.Generated(" " if "two" in p else "passage", "stop") for p in prompts]

    queries = spark.createDataFrame([(1, "one"), (2, "two"), (3, "One "), (4, "a long and chatty question that says quite enough by itself already")], "query_id long, query string")
    got = {r.query_id: r.vector_text for r in providers.expanded(queries, Silent()).collect()}
    assert got == {1: "passage", 2: "two", 3: "passage", 4: "a long and chatty question that says quite enough by itself already"}


def test_generation_options():
    long = "one two three END four"
    got = providers.EchoGenerator(100).generate([long], providers.Options(max_tokens=2, stop=("END",)))[0]
    assert (got.text, got.finish_reason, got.prompt_tokens, got.completion_tokens) == ("one two", "length", 5, 2)
    assert providers.EchoGenerator(100).generate([long], providers.Options(stop=("END",)))[0].finish_reason == "stop"


@pytest.fixture
def server():
    """A server that speaks the completion interface and keeps what it was asked."""
    import http.server
    import json
    import threading

    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body, self.headers.get("Authorization")))
            if self.path.endswith("/embeddings"):
                out = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            else:
                out = {"choices": [{"message": {"content": body["messages"][0]["content"].upper()}, "finish_reason": "length"}], "usage": {"prompt_tokens": 3, "completion_tokens": 2}}
            raw = json.dumps(out).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}/v1/", asked
    own.shutdown()


def test_http_providers(spark, server, monkeypatch):
    url, asked = server
    monkeypatch.setenv("TEST_KEY", "k1")
    embedder = providers.provider("http-embedder", base_url=url, model="intfloat/e5-small-v2", dimensions=2, key_name="TEST_KEY")
    assert embedder.encode(["ab", "c"]) == [[11.0, 1.0], [10.0, 1.0]] and embedder.encode_queries(["ab"]) == [[9.0, 1.0]]
    assert asked[0][1]["input"] == ["passage: ab", "passage: c"] and asked[2 - 1][1]["input"] == ["query: ab"] and asked[0][2] == "Bearer k1"
    with pytest.raises(ValueError):
        providers.HttpEmbedder(url, "m", 3).encode(["x"])
    got = providers.provider("http-generator", base_url=url, model="m").generate(["hi"], providers.Options(max_tokens=7, stop=("s",)))[0]
    assert (got.text, got.finish_reason, got.prompt_tokens) == ("HI", "length", 3) and asked[-1][1]["max_tokens"] == 7 and asked[-1][1]["stop"] == ["s"]
    made = providers.generated(spark.createDataFrame([(1, "hi"), (2, "yo")], "query_id long, prompt string"), providers.HttpGenerator(url, "m"))
    assert {(r.query_id, r.text, r.completion_tokens) for r in made.collect()} == {(1, "HI", 2), (2, "YO", 2)}
    down = providers.generated(spark.createDataFrame([(1, "hi")], "query_id long, prompt string"), providers.HttpGenerator("http://127.0.0.1:9", "m", timeout=1))
    assert [(r.text, r.finish_reason) for r in down.collect()] == [(None, "error")]


def test_expanded_queries_reach_the_vector_arm(spark):
    from siltstone.operators import search

    class Telling(providers.EchoGenerator):
        def generate(self, prompts, options=providers.Options()):
            return [providers.Generated("the passage", "stop") for _ in prompts]

    embedder = providers.HashEmbedder(8)
    vectors = providers.embedded(spark.createDataFrame([(c, c, c) for c in ("the passage", "short one", "x")], "chunk_id string, content_hash string, content string"), embedder)
    long = "a long and chatty question that says quite enough by itself already"
    queries = spark.createDataFrame([(1, "short one"), (2, long)], "query_id long, query string")
    out = search.expanded(queries, Telling(), embedder)
    assert {r.query_id: r.vector_text for r in out.collect()} == {1: "the passage", 2: long}
    best = {r.query_id: (r.chunk_id, r.distance) for r in search.vector_arm(out, vectors, 1).collect()}
    assert best[1] == ("the passage", 0.0) and best[2][1] > 0


def test_golden_file_errors(spark, tmp_path):
    path = tmp_path / "g.json"
    rows = [
        '{"case_id": "a", "query": "q", "expected": [{"repo": "r", "path": "p", "heading_path": ["H", "I \\"x\\""], "must_appear_within_k": 3}]}',
        "not json",
        "[1]",
        '{"version": 2, "case_id": "b", "query": "q"}',
        '{"query": "q"}',
        '{"case_id": "c", "query": " "}',
        '{"case_id": "d", "query": "q", "expected": [{"repo": "r"}]}',
        '{"case_id": "e", "query": "q", "expected": [{"repo": "r", "path": "p", "heading_path": [1]}]}',
        '{"case_id": "f", "query": "q", "expected": [{"repo": "r", "path": "p", "heading_path": "H"}]}',
        '{"case_id": "g", "query": "q", "expected": [{"repo": "r", "path": "p", "must_appear_within_k": "x"}]}',
        "",
    ]
    path.write_text("\n".join(rows) + "\n")
    got = {(rows.index(r.line), r.error) for r in files.golden_file_errors(spark, str(path)).collect()}
    assert got == {(1, "no_object"), (2, "no_object"), (3, "unknown_version"), (4, "missing_case_id"), (5, "missing_query"), (6, "missing_path"), (7, "heading_path_no_list_of_strings"), (8, "heading_path_no_list_of_strings"), (9, "k_not_positive")}


def test_pages_as_a_source_of_a_run(spark):
    from siltstone.operators import run

    pages = spark.createDataFrame([("https://a.example/x/", "# X\n\nhello"), ("http://a.example/y", "y"), ("https://b.example/z", "z"), ("https://a.example/big", "b" * 99), ("https://a.example/null", None)], "url string, html string")
    found, refused = ingest.pages_as_files(pages, "web", ["a.example"], max_bytes=50)
    assert {(r.url[-3:], r.reason) for r in refused.collect()} == {("e/y", "scheme_not_allowed"), ("e/z", "host_not_allowed"), ("big", "too_large")}
    sources = spark.createDataFrame([("web", True, "active", None, None, None)], "source_name string, active boolean, default_status string, default_owner string, default_authority string, default_sensitivity string")
    out = run.run_sources(found, sources, run.empty(spark), providers.HashEmbedder(4))
    assert [(r.path, r.status) for r in out.snapshot.documents.collect()] == [("a.example/x/index.md", "active")]
    s = out.summary.first()
    assert (s.embeddings_created, s.embeddings_unchanged, s.embeddings_failed) == (1, 0, 0)


def test_golden_set_source_and_reports(spark, tmp_path):
    path = tmp_path / "golden.json"
    path.write_text('{"case_id": "a", "query": "q", "expected": [{"repo": "r", "path": "p.md", "heading_path": ["H"], "must_appear_within_k": 3}, {"repo": "r", "path": "z.md"}]}\n{"case_id": "a", "query": " "}\n')
    cases, hits = files.golden_set(spark, str(path))
    assert [(r.hit_idx, r.path, r.must_appear_within_k) for r in hits.orderBy("hit_idx").collect()] == [(0, "p.md", 3), (1, "z.md", 10)]
    assert {(r.case_id, r.error) for r in evaluation.golden_errors(cases, hits).collect()} == {("a", "duplicate_case_id"), ("a", "missing_query")}
    assert evaluation.review_errors(spark.createDataFrame([("x", {"c": 4}), ("y", {"c": 3})], "case_id string, relevance map<string,int>")).collect()[0].case_id == "x"
    empty = evaluation.latencies(spark.createDataFrame([], "seconds double")).first()
    assert (empty.n, empty.p50, empty.p99) == (0, 0.0, 0.0)
    report = spark.createDataFrame([("a", 0.123456)], "k string, v double")
    files.write_json_report(report, str(tmp_path / "j"))
    files.write_csv_report(report, str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "j")).first().v == 0.1235 and spark.read.csv(str(tmp_path / "c"), header=True).first().v == "0.123456"
    log = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1)), (2, datetime.datetime(2024, 1, 2))], "id long, created_at timestamp")
    files.append_log(log, str(tmp_path / "log"))
    files.append_log(log, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).where("day = '2024-01-01'").count() == 2


def test_judges(spark):
    grades = spark.createDataFrame([("c", "x", g) for g in (3, 3, 2)] + [("c", "y", g) for g in (0, 3, 1)] + [("c", "z", g) for g in (1, 2)], "case_id string, citation string, grade int")
    assert {r.citation: (r.median, r.spread) for r in evaluation.consensus(grades).collect()} == {"x": (3, 1), "y": (1, 3), "z": (2, 1)}


def test_run_sources_end_to_end(spark):
    from siltstone.operators import run

    shape = "source_name string, path string, size_bytes long, content binary"

    def frame(rows):
        return spark.createDataFrame([(s, p, len(c), bytearray(c)) for s, p, c in rows], shape)

    rows = [("s", "a.md", b"---\ntitle: A\nlast-verified: 2026-05-01\n---\n# X\n\nyou are now warned\n\n## Y\n\ny"), ("s", "b.md", b"plain"), ("s", "c.md", b"\xff"), ("s", "d.txt", b"x"), ("big", "e.md", b"1"), ("big", "f.md", b"2"), ("off", "g.md", b"x"), ("s", "h.md", b"---\n: [\n---\n")]
    sources = spark.createDataFrame([("s", True, "active", "team", None, None), ("big", True, "active", None, None, None), ("off", False, None, None, None, None)], "source_name string, active boolean, default_status string, default_owner string, default_authority string, default_sensitivity string")
    embedder = providers.HashEmbedder(8)
    limits = run.Limits(max_files=3)
    files_ = frame([*rows, *[("big", f"{i}.md", b"x") for i in range(3)]])
    first = run.run_sources(files_, sources, run.empty(spark), embedder, limits)
    summary = {r.source_name: r for r in first.summary.collect()}
    assert set(summary) == {"s", "big"} and summary["big"].status == "failed" and summary["big"].cap == "max_files"
    s = summary["s"]
    assert (s.files_scanned, s.files_indexed, s.files_skipped, s.chunks_created, s.chunks_flagged, s.status) == (5, 2, 3, 3, 1, "partial")
    docs = {r.path: r for r in first.snapshot.documents.collect()}
    assert set(docs) == {"a.md", "b.md"} and docs["a.md"].title == "A" and docs["a.md"].owner == "team" and docs["b.md"].title == "b.md" and str(docs["a.md"].last_reviewed) == "2026-05-01"
    assert first.snapshot.embeddings.where("error is null").count() == 3
    kept = run.Snapshot(*(spark.createDataFrame(d.collect(), d.schema) for d in (first.snapshot.documents, first.snapshot.chunks, first.snapshot.embeddings)))
    again = run.run_sources(files_, sources, kept, embedder, limits)
    assert {r.change for r in again.changes.collect()} == {"unchanged"} and again.snapshot.chunks.count() == 3
    edited = [("s", "a.md", b"# X\n\nnew text"), ("s", "n.md", b"more")]
    third = run.run_sources(frame(edited), sources, kept, embedder, limits)
    assert sorted(r.change for r in third.changes.collect()) == ["changed", "new", "orphan"]
    assert third.snapshot.documents.count() == 3 and third.snapshot.chunks.count() == 3 and third.snapshot.embeddings.count() == 3
    counted = {r.source_name: (r.embeddings_created, r.embeddings_unchanged, r.embeddings_failed) for r in third.summary.collect()}
    assert counted == {"s": (2, 0, 0)} and {(r.embeddings_created, r.embeddings_unchanged) for r in again.summary.where("source_name = 's'").collect()} == {(0, 3)}
    assert run.run_sources(frame(edited), sources, kept, embedder, limits, prune_missing=True).snapshot.documents.count() == 2
    # What did not parse, is over a cap or belongs to another source is not missing.
    broken = frame([("s", "a.md", b"---\n: [\n---\n"), ("s", "b.md", b"plain"), ("big", "x.md", b"1")])
    pruned = run.run_sources(broken, sources, kept, embedder, limits, prune_missing=True).snapshot
    assert pruned.documents.count() == 3 and pruned.chunks.count() == 4
    over = run.run_sources(frame([("s", f"{i}.md", b"x") for i in range(9)]), sources, kept, embedder, limits, prune_missing=True).snapshot
    assert over.documents.count() == 2 and over.chunks.count() == 3 and over.embeddings.count() == 3
    gone = run.run_sources(frame([("s", "b.md", b"plain")]), sources, kept, embedder, limits, prune_missing=True).snapshot
    assert [r.path for r in gone.documents.collect()] == ["b.md"] and gone.chunks.count() == 1
    assert run.reembedded(kept.chunks, embedder, dry_run=True).first()[0] == 3 and run.reembedded(kept.chunks, embedder).count() == 3


def test_registered_run_reads_large_sources(spark, tmp_path):
    from siltstone.plans import corpus_queries

    small, long = "A few words.", "A long text of many words. " * 400
    # 11,000 files of one source: ids whose paths are taken in.
    ids = [i for i in range(3, 17 * 2000) if i % 17 > 2 and i % 7 > 2][: 11_000]
    rows = [(i, long if i == ids[0] else small, "en", "src0", 0) for i in ids]
    rows += [(3, long, "en", "src1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.source_name: r for r in corpus_queries.ingest_run(spark, str(tmp_path)).collect()}
    assert {k: (r.files_indexed, r.files_skipped, r.status, r.cap) for k, r in got.items()} == {"src0": (11_000, 0, "succeeded", None), "src1": (1, 0, "succeeded", None)}


def test_runs_into_a_store_count_once(spark, tmp_path, monkeypatch):
    """A run that dies between its tables leaves one version; the same batch then counts, once; later ones rewrite few buckets."""
    from siltstone.operators import run
    from siltstone.sources.snapshots import Change, Store

    shape = "source_name string, path string, size_bytes long, content binary"
    frame = lambda texts: spark.createDataFrame([("s", p, len(t), bytearray(t.encode())) for p, t in texts.items()], shape)
    sources = spark.createDataFrame([("s", True, "active", None, None, None)], "source_name string, active boolean, default_status string, default_owner string, default_authority string, default_sensitivity string")
    embedder = providers.HashEmbedder(4)
    store = Store(spark, str(tmp_path / "s"))
    texts = {f"{k}.md": f"# T{k}\n\nfirst {k}\n\n## U\n\nsecond {k}" for k in range(40)}
    assert run.run_into(store, frame(texts), sources, embedder, batch=0, n_buckets=256) == 1
    assert (store.read("documents").count(), store.read("chunks").count(), store.read("embeddings").count()) == (40, 80, 80)

    edited = texts | {"3.md": "# T3\n\nchanged"}
    real = Change.merge

    def dies(self, name, *args, **more):
        if name == "embeddings":
            raise RuntimeError("lost")
        return real(self, name, *args, **more)

    monkeypatch.setattr(Change, "merge", dies)
    with pytest.raises(RuntimeError, match="lost"):
        run.run_into(store, frame(edited), sources, embedder, batch=1)
    monkeypatch.undo()
    assert store.manifest()["version"] == 1 and store.read("chunks").count() == 80
    written = {}
    monkeypatch.setattr(Change, "commit", lambda self, real=Change.commit: (written.update(self.written), real(self))[1])
    assert run.run_into(store, frame(edited), sources, embedder, batch=1) == 2
    assert written.get("documents", 0) <= 1 and written["chunks"] == 1 and written["embeddings"] <= 2  # of 256
    assert store.read("chunks").count() == 79 and store.read("embeddings").count() == 79
    assert run.run_into(store, frame(edited), sources, embedder, batch=1) is None and store.manifest()["version"] == 2
    assert sorted((r.run, r.chunks_created, r.chunks_deleted) for r in store.read("runs").collect()) == [(1, 80, 0), (2, 1, 1)]
    assert run.run_into(store, frame({k: edited[k] for k in list(edited)[:39]}), sources, embedder, batch=2, prune_missing=True) == 3
    assert run.stored_snapshot(store).documents.count() == 39 and store.read("chunks").count() == store.read("embeddings").count() == 77
