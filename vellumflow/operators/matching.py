"""Substring joins without a nested loop.

A name stands in a text if one of the text's n-grams is the name's first n characters and
the text goes on with the rest. So names and texts meet in an equi-join on n-grams, which
shuffles or broadcasts like any other, and the containment test runs on the few candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumflow.session import broadcast_checked

GRAM = 2


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct n-grams of a text."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))))


def contained_names(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, name_col: str, n: int = GRAM) -> DataFrame:
    """``id_col, name`` for every name inside a text; empty names stand in none.

    Few names are broadcast, so that the texts are not shuffled; many are joined by gram.
    Names shorter than ``n`` characters are grams themselves and have a join of their own, if
    there are any.
    """
    keyed = names.select(F.col(name_col).alias("name")).filter("name <> ''").distinct().withColumn("gram", F.substring("name", 1, n))
    rows = texts.select(F.col(id_col), F.col(text_col).alias("_inside"))

    def found(length: int, some: DataFrame) -> DataFrame:
        asked = rows.select(id_col, "_inside", F.explode(grams(F.col("_inside"), length)).alias("gram"))
        return asked.join(broadcast_checked(some), "gram").filter(F.contains("_inside", F.col("name"))).select(id_col, "name")

    out = found(n, keyed.filter(F.length("name") >= n))
    for length in range(1, n):
        short = keyed.filter(F.length("name") == length)
        if not short.isEmpty():
            out = out.unionByName(found(length, short))
    return out.distinct()


def longest_names(found: DataFrame, id_col: str) -> DataFrame:
    """Names that no other found name of the same text contains."""
    longer = found.select(F.col(id_col).alias("_id"), F.col("name").alias("_longer"))
    inside = (F.col(id_col) == F.col("_id")) & (F.length("_longer") > F.length("name")) & F.contains("_longer", F.col("name"))
    return found.join(longer, inside, "left_anti")


def related_names(asked: DataFrame, names: DataFrame, id_col: str, asked_col: str, name_col: str) -> DataFrame:
    """``id_col, name`` of all names that contain an asked name or stand in one; empty names
    are related to nothing."""
    wanted = asked.select(id_col, F.col(asked_col).alias("a")).filter("a <> ''").distinct()
    pool = names.select(F.col(name_col).alias("name")).filter("name <> ''").distinct()
    inside = contained_names(wanted, pool, id_col, "a", "name")
    around = contained_names(pool.withColumn("holder", F.col("name")), wanted.select("a"), "holder", "name", "a").toDF("holder", "a")
    return inside.unionByName(around.join(wanted, "a").select(id_col, F.col("holder").alias("name"))).distinct()
