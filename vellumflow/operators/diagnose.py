"""Audits and breakdowns of data and evaluation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .matching import contained_names, related_names


def missing_names(expected: DataFrame, catalog: DataFrame, name_col: str, suffix: str = "-饮片") -> DataFrame:
    """Expected names that the catalog lacks, also without their suffix, each with the
    shortest related name of the catalog as a suggestion."""
    have = catalog.select(F.col(name_col).alias("have")).distinct()
    asked = expected.select(F.col("name")).distinct()
    base = F.regexp_replace(F.col("name"), F.lit("\\Q" + suffix + "\\E$"), F.lit(""))
    missing = asked.join(have, F.col("name") == F.col("have"), "left_anti").withColumn("base", base).join(have, F.col("base") == F.col("have"), "left_anti")
    related = related_names(missing.select("name", F.col("name").alias("asked")).withColumnRenamed("name", "missing"), catalog, "missing", "asked", name_col)
    best = related.groupBy("missing").agg(F.min(F.struct(F.length("name"), "name"))["name"].alias("suggestion"))
    return missing.select("name").join(best, F.col("name") == F.col("missing"), "left").select("name", "suggestion")


def membership(names: DataFrame, catalog: DataFrame, name_col: str) -> DataFrame:
    """``name, found``: ``exact``, ``contained`` in a longer name, or ``absent``."""
    have = catalog.select(F.col(name_col).alias("have")).distinct()
    exact = names.select("name").distinct().join(have, F.col("name") == F.col("have"), "left")
    related = related_names(names.select(F.col("name").alias("asked"), "name").withColumnRenamed("name", "n"), catalog, "n", "asked", name_col)
    longer = related.filter(F.contains("name", F.col("n")) & (F.col("name") != F.col("n"))).select(F.col("n")).distinct()
    return exact.join(longer, F.col("name") == F.col("n"), "left").select("name", F.when(F.col("have").isNotNull(), "exact").when(F.col("n").isNotNull(), "contained").otherwise("absent").alias("found"))


def with_prefix(catalog: DataFrame, name_col: str, prefixes: Sequence[str]) -> DataFrame:
    """Distinct names that begin with one of the prefixes; a pushed-down filter."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | F.startswith(F.col(name_col), F.lit(p))
    return catalog.select(name_col).filter(hit).distinct()


def neighbours(blocks: DataFrame, suspect: Column, reach: int = 1) -> DataFrame:
    """Suspect blocks with the texts of ``reach`` blocks before and after."""
    order = Window.partitionBy("doc_id").orderBy("block_idx")
    around = [F.lag("text", k).over(order).alias(f"before_{k}") for k in range(reach, 0, -1)] + [F.lead("text", k).over(order).alias(f"after_{k}") for k in range(1, reach + 1)]
    return blocks.select("doc_id", "block_idx", "text", suspect.alias("_s"), *around).filter("_s").drop("_s")


def term_scan(texts: DataFrame, id_col: str, text_col: str, terms: DataFrame, longest: int | None = None) -> DataFrame:
    """``id_col, term, n``: occurrences of each term, found by an equi-join on n-grams;
    ``longest`` restricts to short texts."""
    rows = texts.filter(F.length(text_col) < longest) if longest else texts
    rows = rows.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).distinct().select(F.struct("_id", "_text").alias("at"), "_text")
    found = contained_names(rows, terms, "at", "_text", "term").select("at.*", F.col("name").alias("term"))
    n = (F.length("_text") - F.length(F.replace(F.col("_text"), F.col("term"), F.lit("")))) / F.length("term")
    return found.select(F.col("_id").alias(id_col), "term", n.cast("bigint").alias("n"))


def top_groups(table: DataFrame, by: str, k: int = 10) -> DataFrame:
    """The largest groups; ties by name."""
    return table.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), by).limit(k)


def failure_classes(cases: DataFrame, catalog: DataFrame, name_col: str) -> DataFrame:
    """``failure, n, percent``: misses by cause (names missing from the data, not retrieved,
    other section). ``cases`` has ``key, hit, expected, retrieved``."""
    known = catalog.select(F.col(name_col).alias("have")).distinct()
    misses = cases.filter("NOT hit").select("key", "retrieved", F.explode_outer("expected").alias("name"))
    joined = misses.join(known, F.col("name") == F.col("have"), "left")
    per_case = joined.groupBy("key").agg(F.max(F.col("have").isNotNull()).alias("in_data"), F.max(F.coalesce(F.array_contains("retrieved", F.col("name")), F.lit(False))).alias("got"))
    cause = F.when(~F.col("in_data"), "missing_from_data").when(~F.col("got"), "not_retrieved").otherwise("section_mismatch")
    counted = per_case.groupBy(cause.alias("failure")).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("percent", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def latency_tier(ms: Column) -> Column:
    return F.when(ms < 1000, "fast").when(ms < 3000, "usual").otherwise("slow")


def score_bar(score: Column) -> Column:
    return F.least(F.greatest(F.round(score * 100), F.lit(5)), F.lit(100)).cast("int")
