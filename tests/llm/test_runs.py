import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from siltstone.llm import runs
from siltstone.sources.storage import run


def brute(words):
    """Every stretch that no neighbour extends, period by period; a stretch of a smaller period is not taken again."""
    n, found = len(words), []
    for q in range(1, n // runs.EXPONENT + 1):
        k = 0
        while k + q < n:
            if words[k] != words[k + q]:
                k += 1
                continue
            start = k
            while k + q < n and words[k] == words[k + q]:
                k += 1
            size = k - start + q
            if size >= max(runs.LEAST, runs.EXPONENT * q) and all(words[start : start + size - p] != words[start + p : start + size] for p in range(1, q)):
                found.append((start, size, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def text(rng, n, kinds):
    out = []
    while len(out) < n:
        part = [rng.randrange(kinds) for _ in range(rng.randrange(1, 9))]
        out += part * rng.choice([1, 1, 1, 2, 3, 4, 5, 9])
    return [b"w%d" % w for w in out[:n]]


@pytest.mark.parametrize("seed", range(200))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    words = text(rng, rng.randrange(200), rng.choice([1, 2, 3, 5, 30]))
    assert runs.runs_of(words) == brute(words)


@pytest.mark.parametrize("seed", range(60))
def test_the_automaton_alone_finds_all(seed):
    """Without cutting texts first, so that the links and accesses meet all kinds of words."""
    rng = random.Random(seed)
    words = text(rng, rng.randrange(1, 150), rng.choice([2, 3, 9]))
    assert sorted(runs.runs_in(words), key=lambda r: (r[0], r[2])) == brute(words)


def test_distances_are_those_of_the_last_occurrences():
    rng = random.Random(1)
    for _ in range(50):
        words = [rng.randrange(2) for _ in range(rng.randrange(1, 40))]
        got = {}
        for i, d, size in runs.repeats(runs.Automaton(words)):
            got[i, d] = max(size, got.get((i, d), 0))
        for i in range(len(words)):
            for size in range(1, i + 1):
                last = max((e for e in range(size - 1, i) if words[e - size + 1 : e + 1] == words[i - size + 1 : i + 1]), default=None)
                if last is not None and i - last <= size:
                    assert got.get((i, i - last), 0) >= size


def test_stretches_hold_every_run_and_skip_prose():
    rng = random.Random(3)
    prose = [rng.randrange(4000) for _ in range(5000)]
    words = prose[:2000] + [1, 2, 3] * 5 + prose[2000:]
    assert all(any(a <= s and s + n <= b for a, b in runs.stretches(np.array(words))) for s, n, _ in brute(words))
    assert sum(b - a for a, b in runs.stretches(np.array(words))) < 100
    assert runs.stretches(np.zeros(0, np.int64)) == []


def test_very_long_runs():
    words = [b"a", b"b", b"a", b"c"] * 20_000
    assert runs.runs_of(words) == [(0, 80_000, 4)]
    assert runs.runs_of([b"x"] * 50_000) == [(0, 50_000, 1)]


def expected(doc_id, body):
    """The contract in Python for one row."""
    words = re.findall(rb"[^\x20\x09-\x0D]+", (body or "").encode())
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute(words)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None,) * 3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for k, w in enumerate(words) if k not in gone)))


def checked(spark, rows, folder):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", runs.F.lit(1)).write.parquet(f"{folder}/documents.parquet")
    with run(spark):
        got = [tuple(r) for r in runs.op11_runs(spark, str(folder)).collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w.decode() for w in text(rng, rng.randrange(80), rng.choice([2, 9, 40])))) for k in range(500)]
    checked(spark, rows, tmp_path)


def test_given_texts(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 3000").collect()
    checked(spark, [tuple(r) for r in docs], tmp_path)


def test_nulls_empty_repeated_and_clashing(spark, tmp_path):
    hit = [k for k in range(400) if zlib.crc32(str(k).encode()) % 10 == 0][:4]
    rows = [(None, "a a a a a a a"), (1, None), (2, ""), (3, " \n\t"), (4, "ä ä ä ä ä ä"), (4, "ä ä ä ä ä ä"), (5, "a b a b a b a"), (6, "a b a b a b a b"), (7, "no-break space " * 6), (hit[0], None), (hit[1], ""), (hit[2], "one"), (hit[3], " ".join(map(str, range(3000))))]
    checked(spark, rows, tmp_path)


def test_columns_and_an_empty_table(spark):
    own = spark.createDataFrame([("b b b b b b end", 7, "mine", 1)], "text string, collapsed int, found string, `a.b` int")
    out = runs.with_runs(own)
    assert out.columns == ["text", "found", "a.b", "runs", "collapsed"]
    row = out.first()
    assert row.found == "mine" and row.collapsed == "b end" and [tuple(r) for r in row.runs] == [(0, 6, 1)]
    assert runs.with_runs(own.limit(0)).count() == 0
