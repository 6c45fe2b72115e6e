import zlib

import numpy as np

from siltstone.llm import quality as q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in q.op4_quality(spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in rows.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(rows[i].score, y) for i, y in labels.items() if rows[i].held_out]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.97 and np.mean([s >= 0.3 for s in good]) > 0.98


def test_votes_match_brute_force():
    rng = np.random.default_rng(4)
    model = q.Model(np.ones(q.TERMS, np.float32), rng.normal(size=(q.TERMS, q.RANK)).astype(np.float32), np.zeros((0, q.RANK)), rng.integers(0, 2, 60).astype(float), 0.4)
    model.vectors = model.project(rng.random((60, q.TERMS)).astype(np.float32))
    rows = rng.random((9, q.TERMS)).astype(np.float32)
    rows[3] = 0
    for row, got in zip(rows, model.scores(rows), strict=True):
        if not row.any():
            assert got == 0.4
            continue
        near = sorted(((float(model.project(row[None])[0] @ v), y) for v, y in zip(model.vectors, model.labels, strict=True)), reverse=True)[: q.NEIGHBOURS]
        w = [max(s, 0) ** q.SHARPNESS for s, _ in near]
        assert abs(got - sum(a * y for a, (_, y) in zip(w, near, strict=True)) / sum(w)) < 1e-5


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "word " * 200000, "x"), (3, "ok fine.", None)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(2, 0, 1), (2, 1, 1), (None, 1, 1), (3, None, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    model = q.fit(docs, labels)
    assert len(model.labels) <= 1
    assert q.scored(docs, model).count() == 5 and q.scored(docs.limit(0), model).count() == 0
    assert {r.score for r in q.scored(docs, q.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_tells_vocabularies_apart(spark):
    """Labels that follow the words alone: marks, capitals and repeats are alike."""
    rng = np.random.default_rng(47)
    names = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(400)]
    docs = []
    for i in range(400):
        own = names[:200] if i % 2 else names[200:]
        docs.append((i, ". ".join(" ".join(rng.choice(own, 9)) for _ in range(8)) + "."))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int")
    rows = q.scored(frame.withColumn("held_out", q.held_out(frame["doc_id"])), q.fit(frame, labels)).collect()
    good, bad = ([r.score for r in rows if r.held_out and r.doc_id % 2 == y] for y in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95
