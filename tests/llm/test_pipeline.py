
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from siltstone.llm import decontamination
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute as brute_groups


def test_each_stage_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    outs = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert k == 4 or docs.columns == columns
        outs.append(docs)
    tables = [{r.doc_id: r.text for r in o.collect()} for o in outs[:4]]
    before = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [i for i, y in labels.items() if y == 1]
    assert set(tables[0]) < set(before) and sum(i in tables[0] for i in good) > 0.97 * len(good)
    assert tables[1] == {i: t for i, (t, _) in brute_lines(sorted(tables[0].items())).items()}
    ids = sorted(tables[1])
    _, low = brute_groups([(i, tables[1][i]) for i in ids])
    assert tables[2] == {i: tables[1][i] for i, c in zip(ids, low, strict=True) if i == c}
    phrases = decontamination.Phrases([tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    assert set(tables[3]) == set(tables[2])
    hits = decontamination.search([tables[2][i] for i in tables[2]], phrases)
    assert any(s for _, s, _ in hits)
    for (i, t), (_, spans, _) in zip(tables[2].items(), hits, strict=True):
        assert tables[3][i] == (decontamination.cut(t, spans) if spans else t)
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = outs[4].collect()
    assert {r.doc_id for r in rows} == set(tables[3])
    for i, t in tables[3].items():
        assert sum(r.length for r in rows if r.doc_id == i) == len(model.encode(t, add_special_tokens=False).ids) + 1


def test_run_is_the_stages_in_turn(spark, sf):
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_edge_rows_go_through_every_stage(spark, sf):
    """Null ids and texts, empty texts, rows that share an id, repeated rows, columns with the operators' own names."""
    prose = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(4).collect()]
    shape = "doc_id long, text string, lang string, source string, n_chars long, c0 string, hash long, own_id string"
    rows = [(1, prose[0]), (1, prose[1]), (1, prose[0]), (2, prose[0]), (3, None), (4, ""), (None, prose[2]), (None, None)]
    docs = spark.createDataFrame([(i, t, None, "s", 0, "a", 7, "b") for i, t in rows], shape)
    counts = []
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        assert k == 4 or out.columns == docs.columns
        counts.append(out.count())
        assert stage(spark, docs.limit(0), sf).count() == 0
        if k == 0:
            assert {r.doc_id for r in out.collect()} <= {i for i, _ in rows}
        if k == 2:
            # Both texts of id 1, once each; one of the empty ones; both rows without an id.
            assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in out.collect()) == sorted([(False, 1, prose[0]), (False, 1, prose[1]), (False, 3, ""), (True, 0, prose[2]), (True, 0, "")])
    assert counts[1] == counts[3] == len(rows) and counts[4] >= len(rows)


def test_columns_with_the_stages_own_names_come_back(spark, sf):
    """A caller's ``score``, ``lines_removed``, ``words_cut`` and ``a.b`` are neither overwritten nor refused."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(40).selectExpr("*", "-5.0D - doc_id AS score", "doc_id * 10 AS lines_removed", "doc_id * 100 AS words_cut", "concat('x', doc_id) AS `a.b`")
    want = {r.doc_id: (r.score, r.lines_removed, r.words_cut, r["a.b"]) for r in docs.collect()}
    for _, stage in cp.STAGES[:4]:
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert out.columns == docs.columns and rows
        assert all((r.score, r.lines_removed, r.words_cut, r["a.b"]) == want[r.doc_id] for r in rows)
