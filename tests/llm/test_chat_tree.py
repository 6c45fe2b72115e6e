import hashlib
from collections import defaultdict

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from siltstone.llm import chat_tree as ct

BITS = st.lists(st.sampled_from(["<", "\\", "s>", "/", "|", "[INST]", "[", "INST]", "</s>", "<<SYS>>", "<</SYS>>", "\n", "é", "x", "<|user|>\n", "%7C", "%"])).map("".join)


@given(st.lists(st.tuples(BITS, BITS), max_size=5))
def test_round_trip(turns):
    chat = "".join(ct.formatted(r, t) for r, t in turns)
    assert ct.parsed(chat) == turns
    for _, t in turns:
        assert not any(x in ct.escaped(t) for x in ("</s>", "<s>", "[INST]", "[/INST]", "<|"))


def check_tree(spark, rows, tokenizer=None):
    shape = "conv_id long, turn long, role string, text string, start string"
    nodes, chats = ct.prefix_tree(spark.createDataFrame([(*r, "clash") for r in rows], shape), tokenizer)
    nodes = {r.node: r for r in nodes.collect()}
    chats = chats.collect()
    want = defaultdict(list)
    for c, t, r, x in rows:
        want[c].append((t is not None, t or 0, r or "", x or ""))
    assert {c.conv_id for c in chats} == set(want)
    at, units = 0, {}
    for n in sorted(nodes.values(), key=lambda n: n.start):
        assert n.start == at and n.size == (len(n.ids) // 4 if tokenizer else len(n.text))
        units.update(dict.fromkeys(range(at, at + n.size), n.node))
        at += n.size
    used = set()
    for c in chats:
        path, position = [nodes[x] for x in c.path], 0
        turns = sorted(want[c.conv_id])
        assert ct.parsed("".join(n.text for n in path)) == [(r, x) for *_, r, x in turns]
        for k, n in enumerate(path):
            assert (n.depth, n.position, n.parent, n.root) == (k + 1, position, path[k - 1].node if k else None, path[0].node)
            offsets = [o for i in n.ancestors for o in range(i.begin, i.end)]
            assert offsets == sorted(offsets) and sorted(o for p in path[:k] for o in range(p.start, p.start + p.size)) == offsets
            assert all(a.end < b.begin for a, b in zip(n.ancestors, n.ancestors[1:], strict=False))
            assert (n.loss is not None) == (turns[k][2] == "assistant")
            if n.loss:
                assert ct.unescaped(n.text[n.loss.begin : n.loss.end]) == turns[k][3]
            position += n.size
            used.add(n.node)
    assert used == set(nodes)
    # Depth-first: a subtree is one stretch of the sequence.
    for n in nodes.values():
        below = [m for m in nodes.values() if n.start in {o for i in m.ancestors for o in range(i.begin, i.end)}]
        assert sum(m.size for m in below) + n.size == max([m.start + m.size for m in below], default=n.start + n.size) - n.start


def test_tree(spark):
    rows = []
    for c in range(40):
        texts = ["sys", f"q{c % 3}", f"a{c % 5}</s>", f"q{c % 2}", f"a|>\n{c}"][: 1 + c % 5] if c % 7 else ["other <|x|>", f"r{c}"]
        rows += [(c, k, ["system", "user", "assistant"][min(k, 1 + k % 2) if k else 0], t) for k, t in enumerate(texts)]
    rows += [(90, 0, None, None), (90, 1, "assistant", ""), (90, 1, "assistant", ""), (None, 0, "user", "q"), (91, None, "we|ird%", "x" * 50000)]
    rows += [(95, k, "user", "t") for k in range(300)]
    check_tree(spark, rows)
    check_tree(spark, rows[:60], public_tokenizers.path("word_bpe_49k.json"))


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", probe), (-7, 1, "assistant", probe)]
    want = defaultdict(list)
    for c, t, r, x in sorted(rows):
        want[c].append((r, x or ""))
    got = {r.conv_id: r for r in ct.op1_chat_tree(spark, sf).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        said, learnt = "".join(f"{r}\n{x}\n" for r, x in turns), "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == sum(len(ct.formatted(*t)) for t in turns)


def test_empty(spark):
    nodes, chats = ct.prefix_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == chats.count() == 0
