import random

import xxhash
from pyspark.sql import Row

from siltstone.llm import simhash


def brute(rows):
    fps = []
    for _, text in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0)
    return fps, joined([i for i, _ in rows], fps)


def joined(ids, fps):
    low = list(range(len(ids)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min(groups[find(i)]) for i in range(len(ids))]


def test_every_pair_within_the_radius_meets():
    masks = simhash.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(i + 1):
            assert any(not m & (1 << i | 1 << j) for m in masks)


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["Émile", "THE", "the"]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    rows = []
    for k, text in enumerate(base * 3):
        parts = text.split()
        if k >= 60 and len(parts) > 20:
            parts[rng.randrange(len(parts))] = "x"
        rows.append((k * 7 % 541, "  ".join(parts) + "\n"))
    rows += [(1000, None), (1001, ""), (1002, " \t\x0b"), (1003, "one"), (1004, "one two"), (1005, "y " * 30000)]
    fps, low = brute(rows)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, fp=1, component="c") for i, t in rows])
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {i: (f"{f:016x}", c) for (i, _), f, c in zip(rows, fps, low, strict=True)}


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(50)}
    for centre in list(fps)[:3]:
        ball = {centre}
        for _ in range(300):
            ball.add(rng.choice(sorted(ball)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        fps |= ball
    fps = sorted(fps)
    ids = [f - (1 << 64) if f >> 63 else f for f in fps]
    want = dict(zip(ids, joined(ids, fps), strict=True))
    found = simhash.links(spark.createDataFrame([(i,) for i in ids], "fp long"), small_bucket=4)
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 2 for a, b in found.collect())
    got = {r.node: r.component for r in simhash.components(found).collect()}
    assert {i: got.get(i, i) for i in ids} == want


def test_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).collect() == []
    twice = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (None, "a b c d"), (None, "q")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(twice).collect() if r.component_id) == [(0, 3), (3, 3), (3, 3)]
