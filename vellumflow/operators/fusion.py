"""Reciprocal-rank fusion of any number of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, TOP = 60, 30


def fuse(lists: dict[str, DataFrame], k: int = K, top: int = TOP) -> DataFrame:
    """``qid, id, rrf_score, sources, rank``.

    Every list has ``qid, id, rank``; ``k`` of 0 or None means the default. Ties go to what
    was seen first, in the order of the lists and then of their ranks, then to the smaller
    id. ``sources`` names all lists that hold the document, in their order.
    """
    k = k or K
    named = [df.select("qid", "id", "rank", F.lit(no).alias("list_no"), F.lit(name).alias("source")) for no, (name, df) in enumerate(lists.items())]
    every = reduce(DataFrame.unionByName, named)
    held = F.array_sort(F.collect_list(F.struct("list_no", "source")))
    fused = every.groupBy("qid", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("rrf_score"), F.min(F.struct("list_no", "rank")).alias("seen"), held.alias("held"))
    order = Window.partitionBy("qid").orderBy(F.round("rrf_score", 12).desc(), "seen", "id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("qid", "id", "rrf_score", F.transform("held", lambda h: h["source"]).alias("sources"), "rank")
