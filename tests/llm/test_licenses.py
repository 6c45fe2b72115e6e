import re
from collections import Counter

import duckdb

from siltstone.llm import licenses as lic


def brute(text):
    def words(t):
        return "".join(c.lower() if c.isascii() and c.isalnum() or not c.isascii() else " " for c in t).split()

    def grams(w):
        return Counter(zip(w, w[1:], strict=False))

    def best(found):
        found = [x for x in found if x[0] >= 0.8]
        return min((name, d) for d, name in found if d == max(found)[0]) if found else None

    dice = lambda x, y: 2.0 * (x & y).total() / (x.total() + y.total()) if x and y else 0.0
    parts = [(name, words(part)) for name, part in lic.parts_of(lic.TEMPLATES)]
    blocks = [text or "", *re.split(r"\n[ \t\r]*\n", text or ""), *(text or "").split("\n")]
    hits = [best([(dice(grams(p), grams(words(b))), name) for name, p in parts]) for b in blocks]
    w = words(text or "")
    for k in range(len(w)):
        hits.append(best([(dice(grams(p), grams(w[k : k + len(p)])), name) for name, p in parts if len(p) > 1 and w[k : k + 2] == p[:2] and k + len(p) <= len(w)]))
    out = {}
    for hit in hits:
        if hit:
            out[hit[0]] = max(out.get(hit[0], 0.0), hit[1])
    return sorted(out.items())


def names(text):
    return [n for n, _ in lic.scan(text, lic.Templates())]


def test_licences_are_told_apart():
    by = dict.fromkeys(n for n, _ in lic.TEMPLATES)
    for name, text in lic.TEMPLATES:
        by[name] = text
        assert name in names(text) and name in names("def f(x):\n  # Some file\n\n" + text.replace("\n", "\n# ") + "\nreturn x"), name
    for name, text in lic.TEMPLATES:
        if len(text) < 1200:
            assert names(text) == [name], (name, names(text))
    full = lic._BSD_TERMS + "\n" + lic._BSD_DISCLAIMER
    assert names(full.replace("\n\n", "\n")) == ["BSD-2-Clause"]
    assert names("Foo is free. Released under the MIT License. See the docs.") == ["MIT"]
    assert names("Licensed under the GNU General Public License, version 2.") == ["GPL-2.0"]
    assert names("It said nothing of licences, and all rights were left.") == []


def test_scan_matches_brute_force(spark):
    mit = lic._MIT.replace("Software", "Program", 2)
    texts = [None, "", "x", "all rights", "ALL RIGHTS -- RESERVED", "Some prose.\nLicensed under CC BY-NC 4.0.\nMore.", mit, f"Intro words here\n\n{lic._gnu('General Public License', '3')}\n\nend", "license " * 500, "gnu general " * 40000, "prose " * 9 + lic._ISC, "Licensed under the GNU General Public License, version 2. Licensed under the"]
    docs = spark.createDataFrame([(i % 9, t, "x") for i, t in enumerate(texts)] + [(None, texts[4], "x")], "doc_id long, text string, licenses string")
    got = Counter((r.doc_id, tuple((x.name, x.dice) for x in r.licenses)) for r in lic.licenses(docs).collect())
    assert got == Counter([(i % 9, tuple(brute(t) if len(t or "") < 100000 else ())) for i, t in enumerate(texts)] + [(None, (("all-rights-reserved", 1.0),))])
    assert lic.licenses(docs.limit(0)).count() == 0


def test_sql_agrees(spark, sf):
    want = duckdb.sql(f"create or replace view documents as select * from '{sf}/documents.parquet'") or duckdb.sql(lic.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in lic.op7_licenses(spark, sf).collect()]
    assert sorted(got) == sorted(want) and any(r[1] for r in got)
