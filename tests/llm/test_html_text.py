import html
import random
import re

import pytest

from siltstone.llm import html_text as ht

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>if (a</p>b) {}</script></head><body>
<header><h1>Site</h1></header><nav class="top"><ul><li><a href="/">Home</a><li><a href="/x">About us</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><!-- <p>no</p> --><div id="sidebar"><p>Links we like a lot and a long text about them.</p></div>
%s
<div class="ad">Buy now, it is very cheap today and only today.</div><section id="comments"><p>First! A reader says a great many things here.</p></section>
<form><label>Mail</label><input><button>Go</button></form><footer>&copy; 2020</footer></body></html>"""
BODY = """<h1>A &amp; B&#8217;s  title</h1><p><b>First
 part <i>of</i> it.<br><p>Second &lt;tag&gt; part,<br>with a <a href="#">link</a>.</p><ul><li>one<li>two&nbsp;x</ul><p>End.</p>"""
WANT = ["A & B’s title", "First part of it.", "Second <tag> part, with a link.", "one", "two x", "End."]


def test_article():
    assert ht.blocks_of(PAGE % f"<article><header>{BODY}</header></article>") == WANT
    assert ht.blocks_of(PAGE % f'<article class="post">{BODY}<div class="share">Share it</div></article>') == WANT
    assert ht.blocks_of(PAGE % f'<div class="content">{BODY}<p>{"A long paragraph of prose. " * 9}</p></div>')[:3] == WANT[:3]
    assert ht.blocks_of((PAGE % f"<article>{BODY}").split("<div class=\"ad\"")[0]) == WANT


def test_page_without_article():
    long = "A long paragraph of prose that goes on. " * 8
    body = f'<div class="page-header"><p>Site name</p></div><div id="wrap"><div class="title"><h1>Head</h1></div><div class="row"><p>{long}</p></div><div class="row"><p>Short.</p></div><div class="row"><p>{long}</p></div></div>'
    assert ht.blocks_of(PAGE % body) == ["Head", long.strip(), "Short.", long.strip()]
    assert ht.blocks_of(PAGE % f'<main><div class="x"><h2>Head</h2></div><div><p>Short.</p></div><aside>no</aside><div role="alert">no</div></main>') == ["Head", "Short."]


def test_ratios_choose_the_region(monkeypatch, spark, sf):
    """Two unnamed containers: the dense one is the content, wherever it stands and with or without an article element."""
    links = '<div class="x1">' + "".join(f'<p><a href="/{k}">A place to go {k}</a> now</p>' for k in range(9)) + "</div>"
    texts = [f"Paragraph {k} of some length, with a good many words in it, so that it is dense." for k in range(6)]
    dense = '<div class="x2">' + "".join(f"<p>{t}</p>" for t in texts) + "</div>"
    for page in (links + dense, dense + links, f"<div>{links}</div><div><div>{dense}</div></div>", links + f"<article>{dense}</article>", f"<article>{links}</article>" + dense):
        assert ht.blocks_of(f"<html><body>{page}</body></html>") == texts
    pages = [r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    want = [ht.blocks_of(p) for p in pages]
    # The lists stay in force: they don't name menus, so without ratios those are taken for content.
    monkeypatch.setattr(ht, "ratio", lambda line: 1.0)
    assert sum(ht.blocks_of(p) != w for p, w in zip(pages, want, strict=True)) > 0.9 * len(pages)


def test_smoothing_carries_short_lines():
    """Short lines among long ones are dense, so that they count for the region; alone they are not."""
    page = ht.parsed("<div>" + "<p>word</p><p>" + "A long line of text. " * 9 + "</p>" * 1 + "</div>" + "<p>x</p>" * 9)
    plain = [ht.ratio(line) for line in page.lines]
    smooth = ht.smoothed(plain)
    assert smooth[0] > 10 * plain[0] and smooth[-1] <= 2 * plain[-1]
    dense = ht.clustered(page.lines)
    assert dense[:2] == [True, True] and not any(dense[4:])
    assert abs(sum(ht.smoothed([0, 0, 0, 0, 1, 0, 0, 0, 0])) - 1) < 1e-9 and ht.smoothed([2.0] * 4) == [2.0] * 4


@pytest.mark.parametrize("share", [0.05, 0.2, 0.4])
def test_no_section_is_too_small(share):
    """Sections outside any article, one of which holds a small part of the text, are all returned, in any order."""
    texts = [f"Sentence number {k} is here to be read, and it has some words. " * 3 for k in range(40)]
    n = round(share * len(texts))
    sections = [[t.strip() for t in texts[:n]], [t.strip() for t in texts[n:]]]
    for a, b in (sections, sections[::-1]):
        body = "".join('<section class="part">' + "".join(f"<p>{t}</p>" for t in x) + "</section>" for x in (a, b))
        assert ht.blocks_of(PAGE % body) == a + b
        assert ht.blocks_of(PAGE % f"<div><div>{body}</div></div>") == a + b


def test_headings_at_any_depth():
    text = "A paragraph of prose that goes on for a while. " * 4
    for depth in (1, 4, 10, 30):
        head = "<h1>" + "<span><b>" * depth + "The heading" + "</b></span>" * depth + "</h1>"
        assert ht.blocks_of(PAGE % f"<div>{head}</div><div><h2>Next</h2></div><div><p>{text}</p><p>{text}</p></div>") == ["The heading", "Next", text.strip(), text.strip()]


def test_furniture_that_is_dense_is_taken_out():
    """Long comments and adverts don't make a short text sparse, nor do they come with it."""
    long = "A reader has very much to say about this and says it. " * 20
    page = f'<body><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul><div class="t"><h1>Title</h1><p>One short sentence.</p><p>Another.</p></div><div class="comments"><p>{long}</p><p>{long}</p></div><div class="ad">{long}</div></body>'
    assert ht.blocks_of(page)[-3:] == ["Title", "One short sentence.", "Another."]


def test_no_markup_stops_the_parser():
    rng = random.Random(2)
    parts = ["<![", "<!", "<!--", "-->", "]]>", "<?", "<", ">", "CDATA[", "foo", "if IE", "&", "&#x", "<p>", "</p>", "<div class=", '"', "'", "<script>", "</", "]", "doctype", " ", "a", "%", "-"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 12)))
        page = ht.Lines()
        page.feed(text)
        page.close()


def test_odd_input():
    assert ht.blocks_of(None) == ht.blocks_of("") == ht.blocks_of("<p> </p>") == []
    assert ht.blocks_of("<article><p>x</p><p>y</p></article>") == ["x", "y"]
    assert ht.blocks_of("just text") == ["just text"]
    assert ht.blocks_of("<article>cut <b") in (["cut"], ["cut <b"])
    assert isinstance(ht.blocks_of("<![ x <p>a</p> <!-- y </div></div><td>b"), list)
    assert ht.blocks_of("<article>" + "<p>a b</p>" * 20000 + "</article>") == ["a b"] * 20000


def test_unknown_marks():
    assert ht.blocks_of("<article><p>before</p><p>x <![foo]> y</p><p>after</p></article>") == ["before", "x y", "after"]
    assert ht.blocks_of("<article><p>one two three four</p><![foo[x]]><p>second paragraph</p></article>") == ["one two three four", "second paragraph"]
    assert ht.blocks_of("<article><p>before</p><![ x]><p>after</p><![%y;[ z ]]></article>")[:2] == ["before", "after"]


def test_table_pages(spark, sf):
    rows = ht.op2_html_text(spark, sf).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages)
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", pages[r.page_id], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:h1|p)>", body)]
        assert r.text == "\n\n".join(x for x in parts if x) and r.n_chars == len(r.text)


def test_edge_rows(spark):
    pages = spark.createDataFrame([(1, None, "x"), (1, "<p>a</p>", "x"), (None, "<p>b</p>", None)], "page_id long, html string, text string")
    assert sorted(r.text for r in ht.extracted(pages).collect()) == ["", "a", "b"]
    assert ht.extracted(pages.limit(0)).count() == 0
