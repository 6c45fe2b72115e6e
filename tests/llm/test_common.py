import os
import random

from siltstone.llm import common


def test_components_match_a_plain_search(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for n in sorted(near):
        todo = [n] if n not in want else []
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if near[n] != {n}}


def test_stored_tables_can_be_dropped(spark):
    out = common.stored(spark.range(5), "five")
    path = out.inputFiles()[0].removeprefix("file://")
    assert out.count() == 5 and os.path.exists(path)
    common.drop_stored(spark)
    assert not os.path.exists(path)
