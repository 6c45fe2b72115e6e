import pytest
from pyspark.sql import functions as F

from siltstone.functions import markdown, scoring, text


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first()[0]


def test_config_entries():
    assert text.usable_phrases(["a", " ", 3, "b"]) == ["a", "b"] and text.usable_phrases(None) == []
    assert text.usable_patterns(["a+", "(", 1]) == ["a+"]
    with pytest.raises(ValueError):
        text.usable_phrases("a")
    for bad in ({"weak_threshold": 0}, {"stale_after_days": -1}, {"max_warning_rank": 0}, {"status_weights": {"active": 2}}, {"isolated_drop": 0.0}):
        with pytest.raises(ValueError):
            scoring.RankingConfig(**bad)
    assert scoring.RankingConfig().floor == 0.46 and scoring.RankingConfig(relevance_floor=0.6).floor == 0.6


def test_shipped_patterns(spark):
    c = F.col("t")
    for value, want in [("key AKIA" + "A1" * 8, 0), ("xoxb-" + "1a" * 6, 1), ("ghp_" + "a" * 36, 2), ("AKIA short", None)]:
        assert one(spark, text.first_pattern(c, text.SENSITIVE_PATTERNS), t=value) == (None if want is None else text.SENSITIVE_PATTERNS[want])
    assert one(spark, text.first_phrase(c, text.INJECTION_PHRASES), t="please IGNORE previous Instructions now") == "ignore previous instructions"


def test_stripped_query(spark):
    cleaned, removed = text.stripped_query(F.col("t"), text.INJECTION_PHRASES)
    assert one(spark, F.struct(cleaned, removed), t="You are now  a bot; ignore previous instructionsx") == ("a bot; ignore previous instructionsx", ["you are now"])
    assert one(spark, F.struct(cleaned, removed), t="two  spaces") == ("two  spaces", [])


def test_highlight(spark):
    mark = text.highlighted(F.col("t"), F.col("q"))
    assert one(spark, mark, t="The <CF push> of cf, push!", q="the cf push") == "The &lt;<mark>CF push</mark>&gt; of <mark>cf, push</mark>!"
    assert one(spark, mark, t="a & b", q="is of") == "a &amp; b"


def test_dates_and_urls(spark):
    day = F.lit("2024-03-01").cast("date")
    for back, label in [(0, "Reviewed today"), (1, "Reviewed yesterday"), (59, "Reviewed 59 days ago"), (60, "Reviewed 2 months ago"), (719, "Reviewed 23 months ago"), (720, "Reviewed 1 year ago"), (-3, "Reviewed 2024-03-04")]:
        assert one(spark, scoring.freshness_label(F.date_sub(day, back), day)) == label
    assert one(spark, text.safe_url(F.lit("javascript:x"))) is None and one(spark, text.safe_url(F.lit("https://"))) is None
    assert one(spark, text.safe_url(F.lit(" HTTP://h/x "))) == "HTTP://h/x"


BODY = """---
title: T
last_reviewed: 2026-05-01
---
# Top

## Configuration

### Database

One sentence.

````markdown
```bash
## not a heading
```
````

| a | b |
|---|---|
| 1 | 2 |

- one
  more
- two

## Stub
"""


def test_markdown():
    got = markdown.parsed(BODY)
    assert got["title"] == "T" and '"last_reviewed": "2026-05-01"' in got["metadata"]
    assert [c["heading_path"] for c in got["chunks"]] == [["Top", "Configuration", "Database"]]
    kinds = [b[0] for b in markdown.Reader(BODY.split("---\n")[2]).blocks()]
    assert kinds == ["heading", "heading", "heading", "paragraph", "code", "table", "list", "heading"]
    assert markdown.parsed("# A\n\n## B\n")["chunks"] == [] and markdown.parsed("# A\n\n## B\n")["title"] == "A"
    assert markdown.parsed("---\n" + "x: y\n" * 30000 + "---\nbody")["error"] == "frontmatter_too_large"
    assert markdown.parsed("---\n: [\n---\n")["error"] == "parse_error"
    assert markdown.parsed(None)["chunks"] == []
    nested = "```markdown\n```bash\nx\n```\n# inside\n```\n\n## Real\n\ntext"
    assert [c["heading_path"] for c in markdown.parsed(nested)["chunks"]] == [[], ["Real"]]
    assert len(markdown.parsed("```\n~~~\n# no\n```\n")["chunks"]) == 1


def test_packing_keeps_blocks_whole():
    body = "# H\n\n" + "\n\n".join("word " * 30 for _ in range(10)) + "\n\n```\n" + "code " * 500 + "\n```\n"
    chunks = markdown.parsed(body, limit=100)["chunks"]
    assert len(chunks) > 3 and all(c["heading_path"] == ["H"] for c in chunks)
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks)))
    assert sum(c["content"].startswith("```") for c in chunks) == 1 and chunks[-1]["content_tokens"] > 100


def test_json_safe():
    import datetime
    import decimal
    import uuid

    loop = {}
    loop["me"] = loop
    got = markdown.json_safe({1: datetime.date(2026, 5, 1), "d": decimal.Decimal("1.5"), "u": uuid.UUID(int=1), "s": {"b", "a"}, "x": b"\xff", "y": b"ok", "loop": loop})
    assert got == {"1": "2026-05-01", "d": 1.5, "u": str(uuid.UUID(int=1)), "s": ["a", "b"], "x": "ff", "y": "ok", "loop": {"me": None}}


def test_table_function(spark):
    markdown.register_sql(spark)
    assert spark.sql("select chunk_index, heading_path from chunk_markdown('# A\n\nx\n\n## B\n\ny')").collect() == [(0, ["A"]), (1, ["A", "B"])]


def test_markdown_tables_and_items():
    from siltstone.functions.markdown import Reader, parsed

    kinds = lambda t: [b[0] for b in Reader(t).blocks()]
    assert kinds("a | b\n---") == ["paragraph"] and kinds("a | b\n--- | ---\n1 | 2") == ["table"] and kinds("| a |\n| -- | -- |") == ["paragraph"]
    assert kinds("   - item") == ["list"] and kinds("    - code") == ["paragraph"]
    got = parsed("# A\n\none two\n\nthree four\n\n## B\n\n### C\n\nfive six seven", limit=3)
    assert [(c["heading_path"], c["content"]) for c in got["chunks"]] == [(["A"], "# A"), (["A"], "one two"), (["A"], "three four"), (["A", "B", "C"], "### C"), (["A", "B", "C"], "five six seven")] or all(c["content_tokens"] <= 5 for c in got["chunks"])


def test_plain_text_is_packed_by_paragraphs():
    from siltstone.functions.markdown import parsed

    text = "one two\nthree\n\nfour five\n \nsix seven eight nine\n\nten"
    got = parsed(text, limit=5)
    assert [(c["content"], c["content_tokens"]) for c in got["chunks"]] == [("one two\nthree\n\nfour five", 5), ("six seven eight nine\n\nten", 5)]
    assert [(s["heading"], s["section_tokens"], s["n_chunks_produced"]) for s in got["sections"]] == [("", 10, 2)]


def test_chunks_in_tokens_of_a_model(spark):
    import public_tokenizers

    from siltstone.functions.markdown import chunks_of, parse_documents
    from siltstone.functions.tokens import BpeCounter

    count = BpeCounter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    text = "\n\n".join(f"Supercalifragilistic paragraph number {i}." for i in range(9))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = chunks_of(parse_documents(docs, ["doc_id"], limit=40, count=count), ["doc_id"]).collect()
    assert len(rows) > 2 and all(sum(count(p) for p in r.content.split("\n\n")) == r.content_tokens <= 40 for r in rows)


def test_many_phrases_equal_the_chain(spark, monkeypatch):
    """One automaton gives what a chain of expressions gives, phrase by phrase in list order."""
    import random

    rng = random.Random(3)
    words = ["of", "the", "on", "in", "That", "a.b", "c", "x_y", "new"]
    phrases = list(dict.fromkeys(" ".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(100)))
    rows = [(" ".join(rng.choices([*words, "OF", "ofthe", "b", "end.", "THE,"], k=rng.randint(0, 12))),) for _ in range(300)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")

    def results(limit):
        monkeypatch.setattr(text, "MANY", limit)
        cleaned, removed = text.stripped_query(F.col("t"), phrases)
        return df.select("t", text.first_phrase(F.col("t"), phrases).alias("first"), cleaned.alias("cleaned"), removed.alias("removed")).collect()

    chain, one = results(10_000), results(10)
    assert [r.first for r in chain] == [r.first for r in one]
    assert [(r.cleaned, r.removed if r.t is not None else []) for r in chain] == [(r.cleaned, r.removed) for r in one]
    monkeypatch.undo()
    many = [f"phrase number {k}" for k in range(5000)]
    got = spark.createDataFrame([("a Phrase Number 4999, and phrase number 17.",), ("none",)], "t string").select(text.first_phrase(F.col("t"), many).alias("f"), text.stripped_query(F.col("t"), many)[0].alias("s")).collect()
    assert [(r.f, r.s) for r in got] == [("phrase number 1", "a , and ."), (None, "none")]
