import random
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from siltstone.llm import decontamination as dc
from siltstone.llm.fmindex import FMIndex, suffix_order


@pytest.mark.parametrize("top", [2, 5, 300])
def test_index_against_plain_search(top):
    rng = np.random.default_rng(top)
    text = rng.integers(1, top, 900)
    text[300:420] = text[100:220]
    whole = [*text.tolist(), 0]
    assert suffix_order(np.array(whole)).tolist() == sorted(range(901), key=lambda i: whole[i:])
    index = FMIndex(text)
    for size in (1, 3, 9):
        patterns = np.array([text[i : i + size] for i in (0, 5, 110, 890 - size)] + [rng.integers(1, top + 4, size) for _ in range(9)])
        for p, a, b in zip(patterns, *index.ranges(patterns), strict=True):
            want = [i for i in range(901 - size) if (text[i : i + size] == p).all()]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def brute(text, items, window=10):
    def split(t):
        t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    words, hit, found = split(text), set(), set()
    for item, bench in items:
        b = split(bench)
        for k in range(max(1, len(b) - window + 1) if b else 0):
            w = b[k : k + window]
            for i in range(len(words) - len(w) + 1):
                if words[i : i + len(w)] == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(item)
    return len(words), len(hit), sorted(map(str, found))


def cases():
    rng = random.Random(9)
    vocab = ["the", "of", "Été", "x1", "na", "to", "zz"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([4, 10, 11, 25])))) for i in range(12)] + [(40, None), (41, " .,"), (None, "the of"), (12, "zz, ZZ! zz")]
    docs = []
    for i in range(60):
        words = rng.choices(vocab + ["out"], k=rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(items[:12])[1].upper().split()
        docs.append((i, "; ".join(words)))
    docs += [(60, None), (61, ""), (62, items[3][1]), (63, items[3][1] * 900), (64, "zz zz zz zz zz")]
    return docs, items


@pytest.mark.parametrize("part_words", [10**6, 60])
def test_contamination_matches_brute_force(spark, part_words):
    docs, items = cases()
    frame = spark.createDataFrame([Row(doc_id=i, text=t, spans="clash", items=1) for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in dc.contamination(frame, bench, part_words=part_words).collect()}
    for i, t in docs:
        r = got[i]
        assert (r.n_words, r.n_hit, [str(x) for x in r["items"]]) == brute(t, [x for x in items if x[0] is not None]), i
        assert r.contaminated == (r.n_hit > 0) and all(a.end < b.begin for a, b in zip(r.spans, r.spans[1:], strict=False))


@pytest.mark.parametrize("part", [11, 64])
def test_long_texts_are_indexed_in_overlapping_parts(part):
    docs, items = cases()
    known = [x for x in items if x[0] is not None]
    found = dc.search([t for _, t in docs], dc.Phrases(known), part)
    for (_, t), (n, spans, names) in zip(docs, found, strict=True):
        assert (n, sum(b - a for a, b in spans), [str(x) for x in names]) == brute(t, known)


def test_the_index_holds_the_whole_shard(monkeypatch):
    """Also words that no phrase has."""
    seen = []
    monkeypatch.setattr(dc, "FMIndex", lambda code: seen.append(len(code)) or FMIndex(code))
    dc.search(["a b c " * 50, "d e f"], dc.Phrases([(1, "e f")]))
    assert seen == [150 + 3 + 2]


@pytest.mark.parametrize("kind", ["double", "string", "date"])
def test_items_of_any_type(spark, kind):
    bench = spark.createDataFrame([("2024-01-02", "x y"), ("2024-01-03", "z")], "item_id string, text string")
    bench = bench.withColumn("item_id", F.expr({"double": "1.5D * day(item_id)", "string": "item_id", "date": "date(item_id)"}[kind]))
    docs = spark.createDataFrame([(1, "a x y"), (2, "z x y")], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in dc.contamination(docs, bench).collect()}
    assert [len(got[1]), len(got[2])] == [1, 2] and dict(dc.contamination(docs, bench).dtypes)["items"] == f"array<{kind}>"


def test_query_and_empty_tables(spark, sf):
    rows = dc.op9_decontamination(spark, sf).collect()
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert any(r.contaminated for r in rows)
    for r in random.Random(1).sample(rows, 25) + [r for r in rows if r.contaminated][:10]:
        n, hit, found = brute(texts[r.doc_id], bench)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == (n, hit, len(found), dc.digest(found))
    empty = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.contaminated) for r in dc.contamination(docs, empty).collect()) == [(0, 1, False), (1, 2, False), (1, 2, False)]
    assert dc.contamination(docs.limit(0), empty).count() == 0


@pytest.mark.parametrize("part_words", [10**6, 60])
def test_cut_texts_are_clean(spark, part_words):
    docs, items = cases()
    frame = spark.createDataFrame([Row(doc_id=i, text=t, Words_Cut="clash", n=5, spans=6, __text=7) for i, t in docs])
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = {r.doc_id: r for r in dc.decontaminated(frame, bench, part_words=part_words).collect()}
    known = [x for x in items if x[0] is not None]
    for i, t in docs:
        n, hit, _ = brute(t, known)
        r = out[i]
        assert r.words_cut == hit and (r.n, r.spans, r["__text"]) == (5, 6, 7)
        if hit:
            assert len(dc.words_of(r.text)) == n - hit
        else:
            assert r.text == t
    assert dc.cut("A b, (c) d.", [(1, 3)]) == "A  ) d."
