import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from siltstone.llm import turns
from siltstone.sources.storage import run

SHAPE = "conv_id long, turn long, role string, text string"
ROLES = re.compile("(s?(ua)+)?")


def enumerated(messages):
    """The cheapest, then ASCII-least edits, by trying every sequence that costs no more than deleting all."""
    best, most = [(turns.DELETE * len(messages), "D" * len(messages))], turns.DELETE * len(messages)

    def go(i, cost, audit, roles):
        if (cost, audit) > best[0] and cost > best[0][0] or cost > most:
            return
        if i == len(messages) and ROLES.fullmatch(roles):
            best[0] = min(best[0], (cost, audit))
        for r in "ua":
            go(i, cost + 2, audit + "I", roles + r)
        if i < len(messages):
            initial, fault = messages[i]
            go(i + 1, cost + 3, audit + "D", roles)
            if fault in (turns.FINE, turns.CUT):
                extra = fault == turns.CUT
                go(i + 1, cost + extra, audit + "K", roles + initial)
                for r in "ua":
                    go(i + 1, cost + 2 + extra, audit + "R", roles + r)

    go(0, 0, "", "")
    return best[0]


def by_table(messages):
    """The same for long conversations: the cheapest rest from each node, from the last message on."""
    n = len(messages)
    rest = {}
    for i in range(n, -1, -1):
        found = {q: [(0, "")] if i == n and q in (0, 3) else [] for q in range(4)}
        if i < n:
            initial, fault = messages[i]
            for q in range(4):
                add = lambda c, label, to: found[q].append((rest[i + 1, to][0] + c, label + rest[i + 1, to][1]))  # noqa: B023, E731
                add(3, "D", q)
                if fault in (turns.FINE, turns.CUT):
                    to = turns.KEPT.get((initial, q))
                    if to is not None:
                        add(fault == turns.CUT, "K", to)
                    add(2 + (fault == turns.CUT), "R", turns.NEXT[q])
        now = {q: min(found[q], default=(10**9, "")) for q in range(4)}
        for _ in range(3):
            for q in range(4):
                c, a = now[turns.NEXT[q]]
                now[q] = min(now[q], (c + 2, "I" + a))
        rest |= {(i, q): now[q] for q in range(4)}
    return rest[0, 0]


def messages(rng, n, roles="suax"):
    return [(rng.choice(roles), rng.choices(range(4), [6, 1, 1, 3])[0]) for _ in range(n)]


@pytest.mark.parametrize("seed", range(60))
def test_auction_finds_the_least_of_the_cheapest(seed):
    rng = random.Random(seed)
    own = messages(rng, rng.randrange(5))
    (audit, _, cost), = turns.solved(own)
    assert (cost, audit) == enumerated(own)


@pytest.mark.parametrize("seed", range(40))
def test_long_conversations_against_a_table(seed):
    rng = random.Random(seed)
    own = messages(rng, rng.randrange(30, 90), rng.choice(["ua", "uuua", "suax", "aaax"]))
    (audit, _, cost), = turns.solved(own)
    assert (cost, audit) == by_table(own)


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(turns.WHITE)
        out.append(turns.BLANK if not bare else turns.DUPLICATE if (role, text) in seen else turns.CUT if bare[-1] not in ".!?" else turns.FINE)
        seen.add((role, text))
    return out


def brute(rows):
    """The whole contract in Python, by conversation."""
    told = lambda x: " " if x is None else str(x)
    convs = {}
    for c, t, role, text in rows:
        own = convs.setdefault(c, [])
        role, text = told(role), told(text)
        k = zlib.crc32(f"{told(c)}:{told(t)}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        own += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    out = []
    for c, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        found = faults([r[1:] for r in own])
        ts = {r[0] for r in own} - {None}
        initials = [r[1][:1] for r in own]
        cost, audit = by_table(list(zip(initials, found, strict=True)))
        lines, state, i = [], 0, 0
        for a in audit:
            if a == "I":
                lines.append(turns.ROLE[turns.NEXT[state]] + ":")
                state = turns.NEXT[state]
                continue
            if a != "D":
                role = own[i][1] if a == "K" else turns.ROLE[turns.NEXT[state]]
                state = turns.KEPT[role[:1], state] if a == "K" else turns.NEXT[state]
                lines.append(f"{role}:{own[i][2]}")
            i += 1
        assert ROLES.fullmatch("".join(x[0] for x in lines))
        wrong = sum(p not in turns.LEGAL for p in zip(initials, initials[1:], strict=False))
        counts = [found.count(k) for k in (turns.BLANK, turns.DUPLICATE, turns.CUT)]
        out.append((c, max(ts) - min(ts) + 1 - len(ts) if ts else 0, *counts, wrong, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def checked(spark, rows, tmp_path, parts=3):
    spark.createDataFrame(rows, SHAPE).withColumn("part", turns.F.lit("x")).repartition(parts).write.parquet(f"{tmp_path}/conversations.parquet")
    with run(spark):
        got = [tuple(r) for r in turns.op13_turns(spark, str(tmp_path)).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_query_equals_brute_force(spark, sf, tmp_path):
    checked(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], tmp_path)


def test_conversations_in_several_blocks(spark, tmp_path):
    """Long ones, and one with a third of all rows, are cut at blocks and at the ends of tasks."""
    rng = random.Random(5)
    texts = ["Fine.", "cut", "", " \t", "One more!", "another", "Yes?"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool"]) if t % 7 else "user", f"{rng.choice(texts)}{rng.randrange(400) if rng.random() < 0.5 else ''}") for c, n in ((1, 900), (2, 64), (3, 65), (4, 130), (5, 1), (6, 300)) for t in range(n)]
    rows += [(9, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(400)]
    checked(spark, rows, tmp_path)


def test_nulls_ties_repeats_and_lost_conversations(spark, tmp_path):
    gone = next(c for c in range(100, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Hello."), (None, None, None, None), (None, 3, "user", "Hi."), (7, None, "assistant", "B."), (7, None, "assistant", "A."), (7, 1, "user", "A."), (7, 1, "user", "A."), (7, 9, "", "x"), (8, 0, "user", "long " * 200_000 + ".")]
    checked(spark, rows, tmp_path)


def test_an_empty_table(spark, tmp_path):
    checked(spark, [], tmp_path)
