"""Retrieval quality over whole result tables: recall, reciprocal rank, percentiles, judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.sources.storage import stored


def golden_errors(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """``case_id, error`` for each rule that a golden set breaks."""
    twice = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicate_case_id").alias("error"))
    blank = cases.where(F.coalesce(F.trim("query"), F.lit("")) == "").select("case_id", F.lit("missing_query").alias("error"))
    bad_k = hits.where(F.coalesce(F.col("must_appear_within_k"), F.lit(0)) <= 0).select("case_id", F.lit("k_not_positive").alias("error"))
    no_path = hits.where((F.coalesce("repo", F.lit("")) == "") | (F.coalesce("path", F.lit("")) == "")).select("case_id", F.lit("missing_path").alias("error"))
    empty = cases.join(hits, "case_id", "left_anti").select("case_id", F.lit("no_expected_hits").alias("error"))
    return twice.union(blank).union(bad_k).union(no_path).union(empty).distinct()


def review_errors(cases: DataFrame) -> DataFrame:
    """``case_id, error``: grades outside 0 to 3."""
    grades = cases.select("case_id", F.explode("relevance").alias("citation", "grade"))
    return grades.where(~F.col("grade").between(0, 3)).select("case_id", F.lit("grade_out_of_range").alias("error")).distinct()


def matched_ranks(hits: DataFrame, results: DataFrame) -> DataFrame:
    """Each expected hit with ``rank``, the first place from 0 where it was found, else null.

    Found: same repository and path, and the same headings or none asked for.
    """
    found = results.select(F.col("query_id").alias("case_id"), "repo", "path", F.col("heading_path").alias("_at"), (F.col("rn") - 1).alias("rank"))
    both = hits.join(found, ["case_id", "repo", "path"], "left")
    fits = (F.size("heading_path") == 0) | (F.col("heading_path") == F.col("_at"))
    keys = ["case_id", "hit_idx", "repo", "path", "must_appear_within_k"]
    return both.groupBy(*keys).agg(F.min(F.when(fits, F.col("rank"))).alias("rank"))


def case_scores(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """One row per case: recall at each k, reciprocal rank, first missed hit, whether all are in bounds."""
    within = lambda k: F.coalesce((F.col("rank") < k).cast("int"), F.lit(0))
    return ranks.groupBy("case_id").agg(
        *[F.avg(within(k)).alias(f"recall_at_{k}") for k in ks],
        F.coalesce(F.lit(1.0) / (F.min("rank") + 1), F.lit(0.0)).alias("reciprocal_rank"),
        F.min_by(F.when(F.col("rank").isNull(), F.col("path")), F.when(F.col("rank").isNull(), F.col("hit_idx"))).alias("first_missed"),
        F.bool_and(F.coalesce(F.col("rank") < F.col("must_appear_within_k"), F.lit(False))).alias("passed"),
    )


def overall(scores: DataFrame, ks: list[int]) -> DataFrame:
    """Means over all cases; zeros for none."""
    return scores.agg(
        F.count("*").alias("n_cases"),
        F.round(F.coalesce(F.avg("reciprocal_rank"), F.lit(0.0)), 4).alias("mrr"),
        *[F.round(F.coalesce(F.avg(f"recall_at_{k}"), F.lit(0.0)), 4).alias(f"recall_at_{k}") for k in ks],
        F.count_if("passed").alias("n_passed"),
    )


def latencies(durations: DataFrame) -> DataFrame:
    """Nearest-rank p50, p95 and p99 of ``seconds``; zeros for no rows.

    The value of rank ``ceil(n * p)`` is that at place ``(n * p - 1) // 100`` from 0.
    Values are counted and summed over ranges (see ``floor_percentiles``): no task
    holds them all.
    """
    own = durations.select(F.lit(0).alias("all"), "seconds")
    counts = durations.agg(F.count("*").alias("n"), F.count("seconds").alias("told")).withColumn("all", F.lit(0))
    out = counts
    for name, p in (("p50", 50), ("p95", 95), ("p99", 99)):
        out = out.join(floor_percentiles(own, "all", "seconds", p, 100, name, less=1), "all", "left")
    return out.select("n", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("p50", "p95", "p99")])


def floor_percentiles(rows: DataFrame, by: str, value: str, numerator: int, denominator: int, name: str = "value", less: int = 0) -> DataFrame:
    """``by, name``: for each group the value at place ``(n * numerator - less) // denominator`` of its sorted values, from 0.

    Values are counted first, so a group is as many rows as it has distinct values, and
    these are summed over ranges: parts of the sorted counts, each within one task, and
    the sums of the parts before it. No group is ever held in one place.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    ranged = stored(counts.repartitionByRange(by, value).sortWithinPartitions(by, value).withColumn("_at", F.monotonically_increasing_id()), "counts")
    ranged = ranged.withColumn("_part", F.shiftright("_at", 33))
    parts = ranged.groupBy(by, "_part").agg(F.sum("n").alias("_n"))
    own = Window.partitionBy(by).orderBy("_part")
    parts = parts.select(by, "_part", (F.sum("_n").over(own) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(by)).alias("_all"))
    inside = F.sum("n").over(Window.partitionBy("_part", by).orderBy("_at"))
    upto = ranged.withColumn("_inside", inside).join(parts, [by, "_part"]).withColumn("_upto", F.col("_before") + F.col("_inside"))
    wanted = F.floor((F.col("_all") * numerator - less) / denominator)
    return upto.where((F.col("_upto") > wanted) & (F.col("_upto") - F.col("n") <= wanted)).select(by, F.col(value).alias(name))


def chunking_summary(sections: DataFrame) -> DataFrame:
    """Per repository: sections, how many were split, token and chunk figures."""
    cut = lambda p: F.percentile("section_tokens", F.lit(p)).cast("int")
    return sections.groupBy("repo").agg(
        F.count("*").alias("n_sections"),
        F.count_if("was_split").alias("n_split"),
        F.round(F.avg(F.col("was_split").cast("int")), 4).alias("split_fraction"),
        cut(0.5).alias("p50_tokens"),
        cut(0.95).alias("p95_tokens"),
        F.max("section_tokens").alias("max_tokens"),
        F.round(F.avg("n_chunks_produced"), 4).alias("mean_chunks"),
        F.max("n_chunks_produced").alias("max_chunks"),
    )


def document_sections(sections: DataFrame, long_tokens: int = 800) -> DataFrame:
    """Per document: sections, long ones, the heading of the longest (the first of equals)."""
    return sections.groupBy("repo", "path").agg(F.count("*").alias("n_sections"), F.count_if(F.col("section_tokens") > long_tokens).alias("n_long"), F.max_by("heading", F.struct("section_tokens", -F.col("section_idx"))).alias("longest_heading"))


def longest_sections(sections: DataFrame, n: int = 20) -> DataFrame:
    order = Window.partitionBy("repo").orderBy(F.desc("section_tokens"), "path", "section_idx")
    return sections.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def path_matches(expected: DataFrame, docs: DataFrame) -> DataFrame:
    """Expected names that end a document's path, with or without ``.md``.

    Both sides meet on the last path segment without its suffix; the whole suffix is checked after.
    """
    stem = lambda c: F.regexp_replace(c, r"\.md$", "")
    last = lambda c: F.regexp_extract(stem(c), "([^/]+)$", 1)
    a = expected.withColumn("_last", last(F.col("expected")))
    b = docs.withColumn("_last", last(F.col("path")))
    e, p = stem(F.col("expected")), stem(F.col("path"))
    return a.join(b, "_last").where((p == e) | p.endswith(F.concat(F.lit("/"), e))).drop("_last")


def long_document_misses(misses: DataFrame, stats: DataFrame) -> DataFrame:
    """Whether each missed query points at a document with a long section, and the share of those that do."""
    per = misses.join(stats, ["repo", "path"], "left").groupBy("qid").agg(F.bool_or(F.coalesce(F.col("n_long") > 0, F.lit(False))).alias("in_long"))
    return per.agg(F.count("*").alias("n_misses"), F.count_if("in_long").alias("n_in_long"), F.round(F.coalesce(F.avg(F.col("in_long").cast("int")), F.lit(0.0)), 4).alias("share"))


def consensus(grades: DataFrame) -> DataFrame:
    """Per case and citation: grades in order, median rounded half to even, spread."""
    return grades.groupBy("case_id", "citation").agg(F.array_sort(F.collect_list("grade")).alias("grades"), F.bround(F.percentile("grade", F.lit(0.5)), 0).cast("int").alias("median"), (F.max("grade") - F.min("grade")).alias("spread"))


def consensus_health(agreed: DataFrame) -> DataFrame:
    return agreed.agg(F.count("*").alias("n"), F.count_if(F.col("spread") == 0).alias("unanimous"), F.count_if(F.col("spread") >= 2).alias("spread_2"))


def bucket_precision(verdicts: DataFrame, tops: DataFrame, grades: DataFrame) -> DataFrame:
    """Per confidence: the share that is right, a top citation of grade 2 or more, or a result sent to review."""
    rows = verdicts.join(tops, "query_id", "left").join(grades, ["query_id", "citation"], "left")
    right = F.col("requires_human_review") | F.coalesce(F.col("grade") >= 2, F.lit(False))
    return rows.groupBy("confidence").agg(F.count("*").alias("n"), F.round(F.avg(right.cast("int")), 4).alias("precision"))


def verdict_precision(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """``n, n_right, precision`` of verdicts against labels of ``case_id, requires_human_review``; a case without a verdict is wrong."""
    both = labels.select("case_id", F.col("requires_human_review").alias("_wanted")).join(verdicts.select(F.col("query_id").alias("case_id"), "requires_human_review"), "case_id", "left")
    right = F.coalesce(F.col("requires_human_review") == F.col("_wanted"), F.lit(False))
    return both.agg(F.count("*").alias("n"), F.count_if(right).alias("n_right"), F.round(F.coalesce(F.avg(right.cast("int")), F.lit(0.0)), 4).alias("precision"))


def calibration(cases: DataFrame, results: DataFrame, verdicts: DataFrame, k: int = 5) -> DataFrame:
    """Positives found among the first k results, and negatives that are flagged.

    ``cases(query_id, expected)``: a name that is part of a path, or null for a
    query that nothing answers. A negative is flagged if it goes to review or has no result.
    """
    found = expected_in_top(cases.where("expected is not null"), results, k).withColumnRenamed("found", "_found")
    rows = cases.groupBy("query_id").agg(F.bool_or(F.col("expected").isNotNull()).alias("_positive")).join(found, "query_id", "left")
    rows = rows.join(verdicts.select("query_id", "requires_human_review"), "query_id", "left")
    flagged = ~F.col("_positive") & F.coalesce("requires_human_review", F.lit(True))
    return rows.agg(F.count_if("_positive").alias("n_positive"), F.count_if(F.col("_positive") & F.coalesce("_found", F.lit(False))).alias("n_found"), F.count_if(~F.col("_positive")).alias("n_negative"), F.count_if(flagged).alias("n_flagged"))


def contract_checks(packs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per pack: citations present, budget respected, notice present, nothing sensitive inside."""
    own = evidence.groupBy("query_id").agg(F.avg(((F.coalesce("repo", F.lit("")) != "") & (F.coalesce("path", F.lit("")) != "")).cast("int")).alias("citation_rate"), F.sum("content_tokens").alias("used"), F.count("*").alias("n"), F.count_if("has_sensitive_content").alias("n_sensitive"))
    rows = packs.join(own, "query_id", "left")
    return rows.select(
        "query_id",
        F.coalesce("citation_rate", F.lit(1.0)).alias("citation_rate"),
        F.coalesce((F.col("used") <= F.col("token_budget")) | (F.col("n") == 1), F.lit(True)).alias("budget_respected"),
        (F.coalesce("notice", F.lit("")) != "").alias("notice_present"),
        (F.coalesce("n_sensitive", F.lit(0)) == 0).alias("sensitive_excluded"),
    )


def score_distribution(results: DataFrame) -> DataFrame:
    """Spread of the best score of each query."""
    tops = results.where("rn = 1")
    cut = lambda p, n: F.round(F.percentile("score", F.lit(p)), 9).alias(n)
    return tops.agg(F.count("*").alias("n"), F.min("score").alias("low"), cut(0.25, "p25"), cut(0.5, "median"), F.round(F.avg("score"), 9).alias("mean"), cut(0.75, "p75"), F.max("score").alias("high"))


def expected_in_top(expected: DataFrame, results: DataFrame, k: int = 5) -> DataFrame:
    """Per query: whether one of the expected names is part of a path among the first k."""
    both = expected.join(results.where(F.col("rn") <= k).select("query_id", "path"), "query_id", "left")
    return both.groupBy("query_id").agg(F.bool_or(F.coalesce(F.col("path").contains(F.col("expected")), F.lit(False))).alias("found"))


def worksheet(evidence: DataFrame, n: int = 3, chars: int = 600) -> DataFrame:
    """Per case: the first n citations with an excerpt to grade."""
    item = F.struct("rn", "citation", F.substring("content", 1, chars).alias("excerpt"))
    return evidence.where(F.col("rn") <= n).groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))


def warning_kinds(queries: DataFrame, warnings: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: the kinds of warnings it got, and whether those ``expected(query_id, type)`` are among them."""
    got = warnings.groupBy("query_id").agg(F.array_sort(F.collect_set("type")).alias("kinds"))
    want = expected.groupBy("query_id").agg(F.collect_set("type").alias("wanted"))
    none = F.array().cast("array<string>")
    rows = queries.select("query_id").join(got, "query_id", "left").join(want, "query_id", "left")
    return rows.select("query_id", F.coalesce("kinds", none).alias("kinds"), (F.size(F.array_except(F.coalesce("wanted", none), F.coalesce("kinds", none))) == 0).alias("all_emitted"))
