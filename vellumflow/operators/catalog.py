"""Relational operators of the chunk table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.session import broadcast_checked


def conjunction(predicates: Mapping[str, object]) -> Column:
    """Equality, or membership for a list, over all columns given; NULL and absent values
    do not restrict. Nothing given holds for every row."""
    terms = [F.col(c).isin(*v) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v) for c, v in predicates.items() if v is not None]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def select_rows(table: DataFrame, predicates: Mapping[str, object], order: str, limit: int | None = None) -> DataFrame:
    """Rows that satisfy all predicates, in order; a limit of 0 or None is none."""
    found = table.filter(conjunction(predicates)).orderBy(order)
    return found.limit(limit) if limit else found


def by_ids(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose key stands in ``ids``; an empty list gives none."""
    return table.join(broadcast_checked(ids.select(key).distinct()), key, "left_semi")


def distinct_names(table: DataFrame, column: str) -> DataFrame:
    return table.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def grouped_counts(table: DataFrame, dimensions: Sequence[str], distinct: str) -> DataFrame:
    """Counts by each dimension and in total, with distinct values, in one pass."""
    sets = ", ".join(f"({d})" for d in dimensions)
    names = ", ".join(dimensions)
    query = f"SELECT CASE {' '.join(f'WHEN grouping({d}) = 0 THEN {chr(39)}{d}{chr(39)}' for d in dimensions)} ELSE 'total' END AS dimension, coalesce({names}) AS value, count(*) AS n, count(DISTINCT {distinct}) AS n_names FROM {{table}} GROUP BY GROUPING SETS ({sets}, ())"
    return table.sparkSession.sql(query, table=table)


def upsert(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; within ``new``
    the last by ``order`` wins."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc())
    fresh = new.withColumn("_r", F.row_number().over(last)).filter("_r = 1").drop("_r")
    return old.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def list_names(table: DataFrame, column: str, contains: str | None = None, allowed: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Distinct names that contain a word, restricted by a semi join, with the true total
    beside the listed part."""
    names = distinct_names(table, column)
    if contains:
        names = names.filter(F.contains(column, F.lit(contains)))
    if allowed is not None:
        names = names.join(allowed.select(column).distinct(), column, "left_semi")
    counted = names.crossJoin(F.broadcast(names.agg(F.count(F.lit(1)).alias("total"))))  # one row
    ordered = counted.orderBy(column)
    return ordered.limit(limit) if limit else ordered
