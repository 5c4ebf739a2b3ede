"""Measures of retrieval and generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_hit(name: Column, expected: Column) -> Column:
    """Whether an expected name contains the name or stands in it; nothing expected is a hit.
    Empty names hit nothing."""
    related = F.exists(F.coalesce(expected, F.array().cast("array<string>")), lambda e: (e != "") & (name != "") & (F.contains(name, e) | F.contains(e, name)))
    return (F.size(F.coalesce(expected, F.array().cast("array<string>"))) == 0) | F.coalesce(related, F.lit(False))


def first_hit(results: DataFrame, key: str, name: str, expected: str, rank: str = "rank") -> DataFrame:
    """``key, first_hit_rank``: 0 for a miss."""
    return results.groupBy(key).agg(F.coalesce(F.min(F.when(is_hit(F.col(name), F.col(expected)), F.col(rank))), F.lit(0)).alias("first_hit_rank"))


def hit_at(rank: Column, k: int) -> Column:
    return F.avg(F.when(rank.between(1, k), 1.0).otherwise(0.0))


def mrr(rank: Column) -> Column:
    return F.avg(F.when(rank > 0, 1.0 / rank).otherwise(0.0))


def nearest_percentiles(rows: DataFrame, value: str, by: list[str], percents: list[int], accuracy: int = 10_000) -> DataFrame:
    """``by, p<percent>…``: the element at index ``floor(n * p / 100)`` of the sorted values,
    at most the last; exact, without sorting or collecting a group.

    Approximate percentiles a little below and above each wanted one bracket its rank; the
    values below the bracket are only counted, and the few distinct values inside are counted
    and summed up in order until the rank is reached.
    """
    values = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    margin = 3.0 / accuracy
    ends = [e for p in percents for e in (max(0.0, p / 100 - margin), min(1.0, p / 100 + margin))]
    bounds = values.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, accuracy).alias("_e"), F.max("_v").alias("_max"), F.min("_v").alias("_min"))

    def bracket(i: int, p: int) -> Column:
        low = F.col("_min") if p / 100 - margin <= 0 else F.col("_e")[2 * i]
        high = F.col("_max") if p / 100 + margin >= 1 else F.col("_e")[2 * i + 1]
        index = F.least(F.floor(F.col("_n") * p / 100), F.col("_n") - 1)
        return F.struct(F.lit(p).alias("p"), low.alias("low"), high.alias("high"), index.alias("index"))

    wanted = bounds.select(*by, F.explode(F.array(*[bracket(i, p) for i, p in enumerate(percents)])).alias("w")).select(*by, "w.*")
    joined = values.join(F.broadcast(wanted), by) if by else values.crossJoin(F.broadcast(wanted))  # a row per group and percent
    counted = joined.filter("_v <= high").groupBy(*by, "p", "index", F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    order = Window.partitionBy(*by, "p").orderBy(F.col("_v").asc_nulls_first())
    reached = counted.withColumn("_s", F.sum("_c").over(order)).filter((F.col("_s") > F.col("index")) & F.col("_v").isNotNull())
    picked = reached.groupBy(*by, "p").agg(F.min("_v").alias("_v"))
    return picked.groupBy(*by).agg(*[F.max(F.when(F.col("p") == p, F.col("_v"))).alias(f"p{p}") for p in percents])


def retrieval_report(ranks: DataFrame, by: list[str]) -> DataFrame:
    """Hit rates, reciprocal rank and latency percentiles, overall or by group."""
    r = F.col("first_hit_rank")
    rates = ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.round(hit_at(r, k), 6).alias(f"hit_at_{k}") for k in (1, 3, 5)], F.round(mrr(r), 6).alias("mrr"))
    times = nearest_percentiles(ranks, "latency", by, [50, 95])
    joined = rates.join(F.broadcast(times), by, "left") if by else rates.crossJoin(times)  # one row each
    return joined.withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


def keyword_coverage(answer: Column, keywords: Column) -> Column:
    """Share of keywords in the answer, without regard to case; 1 if there are none."""
    found = F.size(F.filter(keywords, lambda k: F.contains(F.lower(answer), F.lower(k))))
    return F.when(F.size(keywords) > 0, found / F.size(keywords)).otherwise(1.0)


def scored_disclaimer(answer: Column) -> Column:
    return F.contains(answer, F.lit("遵医嘱")) | F.contains(answer, F.lit("具体用药"))


def generation_report(cases: DataFrame, by: list[str]) -> DataFrame:
    """Mean coverage, rates of citations, issues and disclaimers, mean latencies; the mean of
    retrieval latencies leaves out zeros."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("keyword_coverage"), 6).alias("coverage"), rate("has_citations").alias("citation_rate"), rate("has_consistency_issues").alias("issue_rate"), rate("has_medical_disclaimer").alias("disclaimer_rate"),
        F.round(F.avg("generation_latency"), 6).alias("generation_latency"), F.round(F.avg(F.when(F.col("retrieval_latency") > 0, F.col("retrieval_latency"))), 6).alias("retrieval_latency"),
    )


def delta(before: DataFrame, after: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """Differences of two reports, a metric per row; a metric of one report only has NULL."""
    a, b = before.select(metric, F.col(value).alias("before")), after.select(metric, F.col(value).alias("after"))
    return a.join(b, metric, "full").withColumn("change", F.round(F.col("after") - F.col("before"), 6))


def type_view(report: DataFrame) -> DataFrame:
    """A breakdown by type, the largest first, with its place."""
    return report.withColumn("place", F.row_number().over(Window.orderBy(F.col("n").desc(), "query_type")))  # a few types


def first_rows(cases: DataFrame, flag: Column, order: str, k: int) -> DataFrame:
    """The first ``k`` flagged cases, each with the number of all of them."""
    rows = cases.filter(flag)
    return rows.orderBy(order).limit(k).crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_all"))))  # one row
