import random
import zlib
from array import array

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import Row
from tokenizers import Tokenizer

from siltstone.llm import packing, tokens

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", None, " ", "a  b", " lead and trail ", "tab\tnl\nnl\r\nx", "it's don't 'S we're x're.", "<|endoftext|> a<|startoftext|>b.", "</s>[INST] <s>",
    "naïve été, É́.", "x y z　w\x1cv", "İstanbul ΣΣΣ. ßß!", "a.,b,. 12.5%, $$$ ...!?", "́. …. ̀,", "你好,世界. \U0001f600!", "w " * 60000, "q" * 3000,
]


def sample(spark, sf):
    return [t for (t,) in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()] + ODD


def test_counts_equal_the_library(spark, sf):
    texts = sample(spark, sf) + ["  two  spaces " * 9000, "a " + " " * 70000 + "b c" * 9]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, n_tokens="clash") for i, t in enumerate(texts)])
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, PIECES, 4096).collect()}
    for i, t in enumerate(texts):
        n = len(model.encode(t or ""))
        assert got[i] == (len((t or "").encode()), n, n > 4096), repr(t)[:60]
    assert tokens.token_counts(docs.limit(0), PIECES, 9).count() == 0


#: What has gone wrong or could: added tokens and what lower-cases to them, composing and case-changing characters, marks.
FRAGMENTS = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "\u0130", ".", "'s", "'T", "'re", " ", "\n", "\t", "a", "H", "\u0331", "\u0301", "\u00e9", "\u00c9", "\u03a3", "\u03c2", "\u00df", "\u212a", "\ufb01", "\u2581", "1", "\u00bd", "\u00a0", "\u2003", "\x85", "\x1c", "\x0b", "\x00", "#", ":", ";", "!", "&", "*", "(", ")", '"', "\u4f60", "\u597d", "\U0001f600", "\uac00", "\u1100", "\u1161", "the", "Don't", "x", "$", "-", "_", "<", ">", "|", "=", "\u0338", "\u0958"]
SPACED = ["\u2581", " ", "  ", "a", "bab", "abb", "\n", "\u00e9", "<s>", "x y", "1", "\u3002", "\u00a0", "Zed", "the "]


def mixed(parts, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_word_ids_equal_the_library(spark, sf):
    model = Tokenizer.from_file(WORDS)
    assert tokens.splits_at_white_space(WORDS)
    texts = [t or "" for t in sample(spark, sf)] + mixed(FRAGMENTS, 100_000, 5)
    for t, got in zip(texts, tokens.encoder(WORDS)(texts), strict=True):
        assert list(array("I", got)) == model.encode(t, add_special_tokens=False).ids, repr(t)[:60]


def test_words_forgotten_are_learnt_again(monkeypatch):
    monkeypatch.setattr(tokens.WordIds, "LIMIT", 50)
    monkeypatch.setattr(tokens, "BATCH_BYTES", 40)
    model, texts = Tokenizer.from_file(WORDS), mixed(FRAGMENTS, 3000, 6)
    assert [list(array("I", x)) for x in tokens.encoder(WORDS)(texts)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_safe_pieces_count_like_the_whole_text():
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert tokens.can_split(model)
    for t in [*mixed(SPACED, 100_000, 7), "a\u2581 \u2581b" * 9]:
        assert sum(map(len, model.encode(tokens.safe_pieces(t, 3)))) == len(model.encode(t)), repr(t)
    t = "a\u2581 \u2581b" * 8000
    assert tokens.lengths(PIECES, [t]) == [len(model.encode(t))]


def test_batches_are_balanced_by_bytes():
    texts = ["\u4f60" * 40] * 50 + ["a" * 40] * 50
    sizes = [sum(len(t.encode()) for t in part) for part in tokens._balanced(texts, 1000)]
    assert all(1000 <= s < 1000 + 120 for s in sizes[:-1]) and sum(sizes) == 50 * 160


@pytest.mark.parametrize("capacity", [7, 64])
def test_first_fit_decreasing_matches_a_plain_loop(capacity):
    rng = random.Random(capacity)
    sizes = [rng.randint(1, capacity) for _ in range(700)]
    bins, offsets = packing.first_fit_decreasing(sizes, capacity)
    room, want = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if b == len(room):
            room.append(capacity)
        want[i] = (b, capacity - room[b])
        room[b] -= sizes[i]
    assert list(zip(bins, offsets, strict=True)) == want


def test_packing_holds_every_id_once(spark, sf):
    texts = sample(spark, sf)
    model = Tokenizer.from_file(WORDS)
    docs = spark.createDataFrame([Row(doc_id=i, text=t, length="clash", offset=0) for i, t in enumerate(texts)])
    rows = packing.packed(docs, WORDS, group_pieces=20, with_ids=True).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
    for i, t in enumerate(texts):
        parts = sorted(by_doc[i], key=lambda r: r.start)
        whole = b"".join(bytes(r.ids) for r in parts)
        assert list(array("I", whole)) == [*model.encode(t or "", add_special_tokens=False).ids, 1]
        assert [r.start for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert {r.doc_tokens for r in parts} == {len(whole) // 4}
    groups = {}
    for r in rows:
        groups.setdefault(r.doc_id, set()).add(r.sequence_id >> 32)
    assert all(len(g) == 1 for g in groups.values()) and len(set().union(*groups.values())) > 1
    for parts in by_seq.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == [sum(p.length for p in parts[:k]) for k in range(len(parts))]
        assert sum(r.length for r in parts) <= 2048


def test_packing_fills_its_sequences(spark):
    rows = packing.packed(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), WORDS).collect()
    assert sum(r.length for r in rows) / (2048 * len({r.sequence_id for r in rows})) > 0.99


def test_packing_edge_rows(spark):
    shape = "doc_id long, text string"
    assert packing.packed(spark.createDataFrame([], shape), WORDS).count() == 0
    rows = packing.packed(spark.createDataFrame([(None, "a b"), (4, None), (4, None)], shape), WORDS).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.length, r.doc_tokens) for r in rows) == [(-1, 3, 3), (4, 1, 1), (4, 1, 1)]
    assert len({r.sequence_id for r in rows}) == 1


def test_packing_of_long_texts_is_first_fit_decreasing(spark):
    """Pieces that fill a sequence are numbered as they pass; what comes out is what the plain method gives."""
    texts = ["a " * 30_000, "b " * 9_000, *("c " * (37 * k % 2500) for k in range(300))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for group_pieces in (10_000, 50):
        rows = packing.packed(docs, WORDS, group_pieces=group_pieces).collect()
        groups = {}
        for r in rows:
            groups.setdefault(r.sequence_id >> 32, []).append(r)
        assert (len(groups) == 1) == (group_pieces == 10_000)
        for group in groups.values():
            held = {}
            for r in group:
                held.setdefault(r.sequence_id, []).append(r.length)
            sizes = [r.length for r in group]
            bins, _ = packing.first_fit_decreasing(sizes, 2048)
            want = {}
            for b, n in zip(bins, sizes, strict=True):
                want.setdefault(b, []).append(n)
            assert sorted(sorted(x) for x in held.values()) == sorted(sorted(x) for x in want.values())
            assert all(len(x) == 1 for x in held.values() if 2048 in x)
            base = min(held)
            assert {k - base for k in held} == set(range(len(held)))
