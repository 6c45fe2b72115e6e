import hashlib
import random
import re
import time

import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from siltstone.llm import line_dedup as ld

real = F.xxhash64


def brute(rows, min_words=ld.MIN_WORDS, min_line_words=ld.MIN_LINE_WORDS):
    """By the definition, line by line; ids are unique."""
    lines = {i: t.split("\n") for i, t in rows if i is not None and t is not None}
    white = re.compile(r"[ \t\x0b\f\r]")

    def seeds(own):
        m = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in own]
        most = [len(white.findall(x)) + 1 if white.sub("", x) else 0 for x in own]
        start = 0
        for i in range(len(own)):
            if i + 1 == len(own) or sum(m[i - k] * 31**k for k in range(ld.WINDOW) if i >= k) % ld.DIVISOR == 0:
                if i > start and sum(most[start : i + 1]):
                    yield start, tuple(own[start : i + 1])
                start = i + 1
        yield from ((i, (x,)) for i, x in enumerate(own) if most[i] >= ld.ANCHOR_WORDS)

    at = {}
    for i, own in lines.items():
        for s, body in seeds(own):
            at.setdefault(body, []).append((i, s))
    gone = {i: set() for i in lines}
    for places in at.values():
        if len({i for i, _ in places}) < 2:
            continue
        i0, s0 = min(places)
        for i, s in places:
            if (i, s) == (i0, s0):
                continue
            a, b, d, own, first = s, s, s - s0, lines[i], lines[i0]
            while a > 0 and a - d > 0 and own[a - 1] == first[a - d - 1]:
                a -= 1
            while b < len(own) and b - d < len(first) and own[b] == first[b - d]:
                b += 1
            words = sum(len([w for w in white.split(x) if w]) for x in own[a:b])
            if words >= (min_words if sum(bool(white.sub("", x)) for x in own[a:b]) > 1 else min_line_words):
                gone[i] |= set(range(a, b))
    return {i: ("\n".join(x for k, x in enumerate(own) if k not in gone[i]), len(gone[i])) for i, own in lines.items()}


def cases():
    rng = random.Random(8)
    lines = [" ".join(rng.choices("abcdefgh", k=rng.choice([1, 2, 5, 9, 30]))) for _ in range(400)]
    passages = [rng.choices(lines, k=rng.randint(2, 9)) for _ in range(6)] + [[" ".join(rng.choices("xyz", k=55))]]
    docs = []
    for i in range(50):
        own = [f"{i} {x}" if rng.random() < 0.7 else x for x in rng.choices(lines, k=rng.randint(0, 25))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(own))
            own[at:at] = rng.choice(passages)
        docs.append((i, "\n".join(own)))
    return docs + [(50, docs[7][1]), (51, ""), (52, "\n\n"), (53, "\n".join(passages[0] * 400)), (54, None)]


def test_matches_brute_force_and_sql(spark):
    docs = cases()
    frame = spark.createDataFrame([Row(doc_id=i, text=t, LINES_removed="clash", h=1, id=2, __t=3, own_id=4, **{"a.b": 5}) for i, t in docs])
    out = ld.deduplicated(frame)
    assert out.columns == ["doc_id", "text", "h", "id", "__t", "own_id", "a.b", "lines_removed"]
    got = {r.doc_id: (r.text, r.lines_removed) for r in out.collect()}
    want = brute(docs)
    assert got == want | {54: (None, 0)}
    assert sum(n > 0 for _, n in want.values()) > 20
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", docs)
    assert {i: (t, n) for i, n, t in db.execute(ld.SQL.format(documents="documents") + "select doc_id, lines_removed, text from kept").fetchall()} == want


def test_edge_rows(spark):
    shape = "doc_id long, text string"
    assert ld.deduplicated(spark.createDataFrame([], shape)).collect() == []
    text = "\n".join(x * 19 for x in ("v ", "w ", "x "))
    rows = ld.deduplicated(spark.createDataFrame([(None, text), (None, text), (2, text), (2, text), (3, text)], shape)).collect()
    assert sorted((r.doc_id or 0, len(r.text)) for r in rows) == [(0, len(text)), (0, len(text)), (2, len(text)), (2, len(text)), (3, 0)]


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    plan = ld.deduplicated(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_passages_of_over_fifty_words(spark):
    rng = random.Random(76)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    docs, planted = [], []
    for sizes in ([7] * 8, [6] * 9, [5, 4, 12, 20, 6, 5], [52], [30, 24], [3, 49], [1, 1, 49, 1], [3] * 17) * 15:
        passage = [fresh(n) for n in sizes]
        own = [[fresh(rng.randint(2, 7)) for _ in range(6)] for _ in range(2)]
        docs += [(len(docs) + k, "\n".join(own[k][:3] + passage + own[k][3:])) for k in range(2)]
        planted.append("\n".join(own[1]))
    got = {r.doc_id: r.text for r in ld.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i] == t for i, t in docs[::2])
    whole = [got[2 * k + 1] == want for k, want in enumerate(planted)]
    want = brute(docs)
    assert got == {i: t for i, (t, _) in want.items()}
    # Lines of fewer than ANCHOR_WORDS words need a chunk that lies in the passage: here 15 boundaries are shared.
    assert all(w for k, w in enumerate(whole) if k % 8 < 7) and sum(whole[7::8]) >= 14


def test_boundaries_are_those_of_the_rolling_hash(spark):
    """Most seeds of several lines; a boundary depends on WINDOW lines, so it survives what is put before them."""
    rng = random.Random(3)
    lines = [f"w{rng.randrange(10**9)}" for _ in range(400)]
    docs = [(1, "\n".join(lines)), (2, "\n".join(["new", *lines[5:200], "newer", *lines[200:]]))]
    table = ld.line_table(spark.createDataFrame(docs, "id long, text string").selectExpr("id", "xxhash64(text) AS t", "text"))
    cuts = {r.id: r.cuts for r in table.collect()}
    assert 170 < len(cuts[1]) < 230
    shift = {c - 4 if c < 201 else c + (-3 if c > 200 else 0) for c in cuts[1] if c > 8}
    assert len(shift & set(cuts[2])) > 0.97 * len(shift)
    assert sum(b - a > 1 for a, b in zip(cuts[1], cuts[1][1:], strict=False)) > 70


def test_extended_copies(spark):
    head, body, tail = "a b c", " ".join("defgh" * 7), "i j k"
    blank = "\n" * 60
    docs = [
        (1, f"{head}\n{body}\n{tail}"),
        (2, f"x\n{head}\n{body}\n{tail}\ny"),
        (2, f"{body}\nother text of this id"),
        (3, f"{body}\nz"),
        (4, f"{blank}{body}"),
        (5, f"{blank}{body}"),
        (6, f"{head}\n{body}\n{tail}"),
        (None, f"{head}\n{body}\n{tail}"),
        (7, None),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = ld.deduplicated(frame).collect()
    # A line of 35 words alone, with or without blank lines, is no passage.
    want = [(1, docs[0][1], 0), (2, "x\ny", 3), (2, docs[2][1], 0), (3, docs[3][1], 0), (4, docs[4][1], 0), (5, docs[5][1], 0), (6, "", 3), (None, docs[7][1], 0), (7, None, 0)]
    assert sorted(map(str, map(tuple, ((r.doc_id, r.text, r.lines_removed) for r in got)))) == sorted(map(str, want))


def test_equal_hashes_are_not_enough(spark, monkeypatch):
    """With a hash that takes all lines for equal, only equal bytes are removed."""
    long = lambda c: "\n".join(" ".join([f"{c}{k}"] * 30) for k in range(3))
    docs = [(1, long("a")), (2, long("b")), (3, long("a"))]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(ld.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") if len(c) == 1 and str(c[0]).find("namedlambda") >= 0 else real(*c))
    got = {r.doc_id: r.text for r in ld.deduplicated(frame).collect()}
    assert got == {1: docs[0][1], 2: docs[1][1], 3: ""}


def test_repeated_rows_and_very_long_texts(spark):
    text = "\n".join(f"line {i} of a very long text with words" for i in range(30_000))
    docs = [(1, text), (1, text), (2, "new start\n" + text), (2, "new start\n" + text)]
    got = sorted((r.doc_id, len(r.text), r.lines_removed) for r in ld.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == [(1, len(text), 0)] * 2 + [(2, 9, 30_000)] * 2


def test_lines_that_repeat_within_a_text(spark):
    """Runs of one line, of two in turn, and of several, of unlike lengths, in texts that share them."""
    rng = random.Random(4)
    words = lambda n: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=n))
    x, y, z, long = words(6), words(5), words(7), words(45)
    parts = [[x], [y], [x, y], [x, y, z], [long], ["own"], [""]]
    docs = []
    for i in range(60):
        own = []
        for _ in range(rng.randint(1, 4)):
            own += rng.choice(parts) * rng.choice([1, 2, 3, 5, 8]) + ([f"only {i}"] if rng.random() < 0.4 else [])
        docs.append((i, "\n".join(own)))
    got = {r.doc_id: (r.text, r.lines_removed) for r in ld.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs)


def test_time_is_in_proportion_to_lines(spark):
    """A line, and two lines in turn, a hundred thousand times in two texts."""
    for lines in (["one two three four five six"], ["one two three four five six", "seven eight nine ten eleven"]):
        body = "\n".join((lines * 100_000)[:100_000])
        begun = time.time()
        got = {r.doc_id: r.lines_removed for r in ld.deduplicated(spark.createDataFrame([(1, "head\n" + body), (2, body + "\ntail")], "doc_id long, text string")).collect()}
        assert got == {1: 100_000 - 1 - (len(lines) - 1) if len(lines) == 1 else got[1], 2: 100_000}
        assert time.time() - begun < 120
