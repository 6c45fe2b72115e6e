"""Line dedup over content-defined chunks of lines, in DataFrame functions only.

A text's lines are cut into chunks: a chunk ends after a line where a rolling hash
over the hashes of this and the ``WINDOW - 1`` lines before is a multiple of
``DIVISOR``. Inside a passage the boundaries thus depend on the passage alone,
wherever it stands and whatever came or went before it. Chunks of several lines
are seeds. A passage of one or two lines holds no whole chunk that its copies
share, so a line of at least ``ANCHOR_WORDS`` words is a seed by itself as well.

A seed that stands in two documents or more is repeated; its first occurrence is
the one of the smallest id, then the smallest line. A later copy is extended line
by line to both sides while the lines equal those beside the first occurrence.
What results is a passage, and it is removed if it equals the first occurrence
byte by byte and has at least ``min_words`` words in two or more lines that are not
blank, or ``min_line_words`` words in all: a lone short line that happens to repeat
is no passage.

Everything up to the byte comparison works on hashes: one narrow table has each
text's line hashes, seeds are rows of a few numbers, and most repeated seeds go
at once, as both their neighbours differ and they are too small by themselves.
Texts move twice: to fetch the bytes of what is left, and to write the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import by_position, drop_stored, so_far, stored, table

WINDOW = 3
DIVISOR = 2
#: The rolling hash is the sum of a line's hash and MULTIPLIER ** k times that of the k-th line before it.
MULTIPLIER = 31
ANCHOR_WORDS = 4
MIN_WORDS = 20
MIN_LINE_WORDS = 40

#: White space within a line.
_WHITE = " \t\x0b\f\r"


def line_table(source: DataFrame) -> DataFrame:
    """``id, t, hs, ns, ws, cuts`` of ``source(id, t, text)``: line hashes, most words a line can have (0 if blank), words, ends of chunks.

    Each step is a column of its own: a lambda that looks at neighbours must read
    a finished array, not an expression made anew for every element.
    """
    out = source.withColumn("ls", F.split("text", "\n", -1))
    out = out.withColumn("bare", F.transform("ls", lambda x: F.length(F.translate(x, _WHITE, ""))))
    out = out.withColumn("ms", F.transform("ls", lambda x: F.conv(F.substring(F.md5(x), 1, 7), 16, 10).cast("long")))
    ns = F.transform("ls", lambda x, i: F.when(F.get("bare", i) == 0, 0).otherwise(F.length(x) - F.get("bare", i) + 1))

    def end(m: Column, i: Column) -> Column:
        rolled = sum((F.coalesce(F.get("ms", i - k), F.lit(0)) * MULTIPLIER**k for k in range(1, WINDOW)), m)
        return F.when((rolled % DIVISOR == 0) | (i + 1 == F.size("ms")), i + 1)

    ws = F.transform("ls", lambda x: F.regexp_count(x, F.lit(r"[^ \t\x0b\f\r]+")))
    return out.select("id", "t", F.transform("ls", lambda x: F.xxhash64(x)).alias("hs"), ns.alias("ns"), ws.alias("ws"), F.array_compact(F.transform("ms", end)).alias("cuts"))


def seeds(lines: DataFrame) -> DataFrame:
    """``id, t, s, e, h, n, p, q``: seeds as ranges of lines, their hash, words at most, and the hashes of the lines beside them."""
    several = F.filter(F.transform("cuts", lambda c, k: F.struct(F.coalesce(F.get("cuts", k - 1), F.lit(0)).alias("s"), c.alias("e"))), lambda x: x["e"] - x["s"] > 1)
    single = F.array_compact(F.transform("ns", lambda n, i: F.when(n >= ANCHOR_WORDS, F.struct(i.alias("s"), (i + 1).alias("e")))))
    out = lines.select("id", "t", "hs", "ns", F.concat(several, single).alias("spans"))
    own = lambda c, x: F.slice(c, x["s"] + 1, x["e"] - x["s"])
    facts = F.transform(
        "spans",
        lambda x: F.struct(
            x["s"].alias("s"),
            x["e"].alias("e"),
            F.xxhash64(own("hs", x)).alias("h"),
            F.aggregate(own("ns", x), F.lit(0), lambda a, b: a + b).alias("n"),
            F.get("hs", x["s"] - 1).alias("p"),
            F.get("hs", x["e"]).alias("q"),
        ),
    )
    # The outer form: the plain one adds a filter that would build the array twice.
    return out.select("id", "t", F.explode_outer(facts).alias("x")).where("x.n > 0").select("id", "t", "x.*")


def later_copies(lines: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    """``id, t, id0, t0, at``: the texts whose seeds repeat those of an earlier one, and where: ``(d, s)``, the distance between their lines and the line."""
    found = seeds(lines)
    # Stored before it is joined: a join with a finished table can be split where a hash is hot.
    first = stored(found.groupBy("h").agg(F.min(F.struct("id", "s", "t", "p", "q")).alias("f"), F.max("id").alias("last")).where("f.id < last").select("h", "f"), "firsts")
    met = found.join(first, "h")
    grows = F.coalesce(F.col("p") == F.col("f.p"), F.lit(False)) | F.coalesce(F.col("q") == F.col("f.q"), F.lit(False))
    enough = F.col("n") >= F.when(F.col("e") - F.col("s") > 1, min_words).otherwise(min_line_words)
    # Rows with one id are one document, whose texts repeat nothing in each other.
    met = met.where((grows | enough) & ((F.col("id") != F.col("f.id")) | ((F.col("t") == F.col("f.t")) & (F.col("s") != F.col("f.s")))))
    met = met.select("id", "t", F.col("f.id").alias("id0"), F.col("f.t").alias("t0"), F.struct((F.col("s") - F.col("f.s")).alias("d"), "s").alias("x"))
    out = met.groupBy("id", "t", "id0", "t0").agg(F.sort_array(F.collect_set("x")).alias("xs"))
    # A seed next to one of the same distance lies in the same stretch.
    new = F.filter("xs", lambda x, i: ~F.coalesce((F.get("xs", i - 1)["d"] == x["d"]) & (F.get("xs", i - 1)["s"] + 1 == x["s"]), F.lit(False)))
    return out.select("id", "t", "id0", "t0", new.alias("at"))


def _power(j: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), j)


def _blocks(values: str, join) -> Column:
    """Arrays by level ``j``: ``join`` over the ``2 ** j`` values from each place on, null where there are not as many."""
    top = F.floor(F.log2(F.size(values))).cast("int")
    last = lambda acc: F.element_at(acc, -1)
    half = lambda j: _power(j - 1)
    return F.aggregate(
        F.when(top > 0, F.sequence(F.lit(1), top)).otherwise(F.array().cast("array<int>")),
        F.array(values),
        lambda acc, j: F.concat(acc, F.array(F.transform(last(acc), lambda x, i: F.when(F.get(last(acc), i + half(j)).isNotNull(), join(x, F.get(last(acc), i + half(j))))))),
    )


def candidates(lines: DataFrame, pairs: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    """``id, t, a, b, id0, t0, a0``: stretches of lines with equal hashes that hold a seed and are large enough.

    Both texts of a pair meet once, whatever the number of seeds. Hashes of all blocks
    of two, four, eight ... lines tell in a few steps how far a seed extends to both
    sides, and sums over such blocks how many words that is, so a text of lines that
    repeat over and over costs its lines times their logarithm. Of a pair's stretches
    that overlap each keeps what is new in it: no line is compared twice.
    """
    ids = pairs.select("id", "t").union(pairs.select("id0", "t0")).distinct()
    own = lines.join(ids, ["id", "t"], "left_semi").dropDuplicates(["id", "t"])
    # A text's words in lines, and how many lines have one, in a number: sums of both are sums of it.
    sizes = F.transform("ws", lambda w, i: F.shiftleft(w.cast("long"), 32) + F.when(F.get("ns", i) > 0, 1).otherwise(0))
    own = own.select("id", "t", "hs", sizes.alias("sizes"))
    own = stored(own.select("id", "t", _blocks("hs", lambda x, y: F.xxhash64(x, y)).alias("hashes"), _blocks("sizes", lambda x, y: x + y).alias("sums")), "lines")
    both = pairs.join(own, ["id", "t"]).join(own.select(F.col("id").alias("id0"), F.col("t").alias("t0"), F.col("hashes").alias("hashes0")), ["id0", "t0"])
    levels = F.sequence(F.size("hashes") - 1, F.lit(0), F.lit(-1))
    size = _power
    # Array positions below 0 have no value, as those beyond the end.
    same = lambda j, i, d: F.coalesce(F.get(F.get("hashes", j), i) == F.get(F.get("hashes0", j), i - d), F.lit(False))

    def stretch(x: Column) -> Column:
        after = F.aggregate(levels, F.lit(0), lambda k, j: F.when(same(j, x["s"] + k, x["d"]), k + size(j)).otherwise(k))
        before = F.aggregate(levels, F.lit(0), lambda k, j: F.when(same(j, x["s"] - k - size(j), x["d"]), k + size(j)).otherwise(k))
        return F.struct((x["s"] - before).alias("a"), (x["s"] + after).alias("b"), x["d"].alias("d"), after.alias("n"))

    both = both.select("id", "t", "id0", "t0", "sums", F.filter(F.transform("at", stretch), lambda x: x["n"] > 0).alias("found"))

    def held(x: Column) -> Column:
        start = F.struct(x["a"].alias("i"), F.lit(0).cast("long").alias("n"))
        fits = lambda acc, j: acc["i"] + size(j) <= x["b"]
        step = lambda acc, j: F.when(fits(acc, j), F.struct((acc["i"] + size(j)).alias("i"), (acc["n"] + F.get(F.get("sums", j), acc["i"])).alias("n"))).otherwise(acc)
        return F.aggregate(F.sequence(F.size("sums") - 1, F.lit(0), F.lit(-1)), start, step, lambda acc: acc["n"])

    both = both.select("id", "t", "id0", "t0", F.explode_outer(F.transform("found", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["d"].alias("d"), held(x).alias("n")))).alias("r"))
    out = both.where("r is not null").select("id", "t", "id0", "t0", "r.*")
    several = F.col("n").bitwiseAND(F.lit((1 << 32) - 1)) > 1
    # Stored, so that the joins before may be split where many texts repeat one.
    out = stored(out.where(F.shiftright("n", 32) >= F.when(several, min_words).otherwise(min_line_words)), "stretches")
    reached = F.max("b").over(Window.partitionBy("id", "t", "id0", "t0").orderBy("a", F.desc("b"), "d").rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("reached", F.coalesce(reached, F.lit(0))).where("b > reached").withColumn("a", F.greatest("a", "reached"))
    return out.select("id", "t", "a", "b", "id0", "t0", (F.col("a") - F.col("d")).alias("a0"))


def repeated_passages(source: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """``id, t, gone`` of ``source(id, t, text)``: the ranges of lines of each text that repeat earlier ones, compared byte by byte; ranges are in order and apart."""
    lines = stored(line_table(source), "line-hashes")
    pairs = stored(later_copies(lines, min_words, min_line_words), "pairs")
    found = stored(candidates(lines, pairs, min_words, min_line_words), "candidates")
    n = F.col("b") - F.col("a")
    takes = found.select("id", "t", F.struct("a", "b", "id0", "t0", "a0").alias("take"), F.lit(None).cast("struct<a: int, b: int>").alias("give"))
    gives = found.select(F.col("id0").alias("id"), F.col("t0").alias("t"), F.lit(None).cast(takes.schema["take"].dataType).alias("take"), F.struct(F.col("a0").alias("a"), (F.col("a0") + n).alias("b")).alias("give"))
    need = takes.union(gives).groupBy("id", "t").agg(F.collect_set("take").alias("takes"), F.collect_set("give").alias("gives"))
    # Neither side of the joins with texts has a bound, so none is ever broadcast.
    texts = source.join(need.hint("merge"), ["id", "t"]).dropDuplicates(["id", "t"])
    texts = stored(texts.select("id", "t", F.split("text", "\n", -1).alias("ls"), "takes", "gives"), "texts")
    body = lambda x: F.array_join(F.slice("ls", x["a"] + 1, x["b"] - x["a"]), "\n")
    taken = texts.select("id", "t", F.explode_outer(F.transform("takes", lambda x: F.struct(x.alias("x"), body(x).alias("body")))).alias("y")).where("y is not null")
    taken = taken.select("id", "t", "y.x.*", F.col("y.body").alias("body")).withColumn("n", n)
    given = texts.select("id", "t", F.explode_outer(F.transform("gives", lambda x: F.struct(x.alias("x"), body(x).alias("body")))).alias("y")).where("y is not null")
    given = given.select(F.col("id").alias("id0"), F.col("t").alias("t0"), F.col("y.x.a").alias("a0"), (F.col("y.x.b") - F.col("y.x.a")).alias("n"), F.col("y.body").alias("body0"))
    equal = taken.join(given, ["id0", "t0", "a0", "n"]).where("body = body0").select("id", "t", "a", "b").distinct()
    # Ranges that overlap or touch become one.
    order = Window.partitionBy("id", "t").orderBy("a", "b")
    reached = F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    islands = equal.withColumn("new", F.when(F.col("a") > reached, 1).otherwise(0)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("id", "t", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return islands.groupBy("id", "t").agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gone"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS, count_col: str = "lines_removed") -> DataFrame:
    """``docs`` with the repeated passages taken out of ``text_col``, and how many lines that were (``count_col``).

    Every row and every other column stays, whatever its name (``count_col``
    replaces a column of that name). A text without repeats is returned as it is; one
    that is all repeats becomes empty. Rows with a null id or text are left alone
    and count for nothing. Rows with one id are one document: they repeat nothing
    in each other, and what is removed from one is removed from those of the same
    text. Among equal passages the one of the smallest id, then of the smallest line,
    stays. Very long texts are read whole: a text of a million lines is one row of
    hashes. An empty table gives an empty one.
    """
    own, names = by_position(docs, count_col.lower())
    i, x = (F.col(own.columns[names.index(c)]) for c in (id_col, text_col))
    keyed = own.withColumn("t", F.xxhash64(x))
    begin = so_far()
    runs = repeated_passages(keyed.select(i.alias("id"), "t", x.alias("text")).where("id is not null and text is not null"), min_words, min_line_words)
    runs = stored(runs.select(F.col("id").alias("own_id"), F.col("t").alias("own_t"), "gone"), "runs")
    drop_stored(docs.sparkSession, begin, 1)
    out = keyed.join(runs.hint("merge"), (i == F.col("own_id")) & (F.col("t") == F.col("own_t")), "left")
    out = out.withColumn("ls", F.when(F.col("gone").isNotNull(), F.split(x, "\n", -1)))
    kept = F.transform(F.concat(F.array(F.lit(0)), F.col("gone.b")), lambda a, k: F.slice("ls", a + 1, F.coalesce(F.get("gone.a", k), F.size("ls")) - a))
    text = F.when(F.col("gone").isNotNull(), F.array_join(F.flatten(kept), "\n")).otherwise(x)
    lost = F.aggregate("gone", F.lit(0), lambda n, r: n + r["b"] - r["a"])
    columns = [text if name == text_col else F.col(c) for c, name in zip(own.columns, names, strict=True)]
    return out.select(*[c.alias(name) for c, name in zip(columns, names, strict=True)], F.coalesce(lost, F.lit(0)).cast("long").alias(count_col))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "lines_removed", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


#: ``{documents}`` is the table or subquery to read, with one row for an id; ``kept`` has the operator's columns.
SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM {{documents}} WHERE doc_id IS NOT NULL AND text IS NOT NULL
), facts AS (
  SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS m, length(regexp_replace(line, '[ \\t\\x0b\\f\\r]', '', 'g')) AS bare,
    len(regexp_extract_all(line, '[^ \\t\\x0b\\f\\r]+')) AS words FROM lines
), ends AS (
  SELECT *, CASE WHEN bare = 0 THEN 0 ELSE length(line) - bare + 1 END AS n,
    lead(i) OVER w IS NULL OR ({" + ".join(["m", *(f"{MULTIPLIER**k} * coalesce(lag(m, {k}) OVER w, 0)" for k in range(1, WINDOW))])}) % {DIVISOR} = 0 AS done
  FROM facts WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), numbered AS (
  SELECT *, coalesce(sum(done::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM ends
), seeds AS (
  SELECT doc_id, min(i) AS s, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, k HAVING count(*) > 1 AND sum(n) > 0
  UNION ALL SELECT doc_id, i, line FROM ends WHERE n >= {ANCHOR_WORDS}
), firsts AS (
  SELECT body, min((doc_id, s)) AS first FROM seeds GROUP BY body HAVING min(doc_id) < max(doc_id)
), later AS (
  SELECT doc_id, s, first[1] AS id0, s - first[2] AS d FROM seeds JOIN firsts USING (body) WHERE (doc_id, s) <> first
), pairs AS (
  SELECT DISTINCT doc_id, id0, d FROM later
), equal AS (
  SELECT p.doc_id, p.id0, p.d, a.i, a.words, a.bare, a.i - row_number() OVER (PARTITION BY p.doc_id, p.id0, p.d ORDER BY a.i) AS g
  FROM pairs p JOIN facts a ON a.doc_id = p.doc_id JOIN facts b ON b.doc_id = p.id0 AND b.i = a.i - p.d WHERE a.line = b.line
), stretches AS (
  SELECT doc_id, id0, d, min(i) AS a, max(i) AS b FROM equal GROUP BY doc_id, id0, d, g
  HAVING sum(words) >= CASE WHEN count(*) FILTER (bare > 0) > 1 THEN {MIN_WORDS} ELSE {MIN_LINE_WORDS} END
), passages AS (
  SELECT DISTINCT doc_id, a, b FROM stretches x WHERE EXISTS (SELECT 1 FROM later y WHERE y.doc_id = x.doc_id AND y.id0 = x.id0 AND y.d = x.d AND y.s BETWEEN x.a AND x.b)
), gone AS (
  SELECT DISTINCT l.doc_id, l.i FROM lines l JOIN passages p ON p.doc_id = l.doc_id AND l.i BETWEEN p.a AND p.b
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS text, count(g.i) AS lines_removed
  FROM lines l LEFT JOIN gone g USING (doc_id, i) GROUP BY l.doc_id
)
"""

ORACLE_SQL = SQL.format(documents="documents") + "SELECT doc_id, lines_removed, length(text)::BIGINT AS n_chars_kept, sha256(text) AS text_sha256 FROM kept"
