"""Hybrid retrieval for a table of queries: filtered recall by vectors and by words, fusion,
enrichment, reranking, context assembly. Everything is keyed by ``qid``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.session import broadcast_checked, cut, only, stored

from . import bm25, fusion, models, queryparse, vector
from .matching import related_names
from .tokens import mixed_tokens

VECTOR_K, WORD_K, OVERFETCH, RERANK_K = 15, 15, 4, 5
ITEM_CAP, TOTAL_CAP, LEAST_REST = 800, 4_000, 50


def allowed_names(parsed: DataFrame, names: DataFrame, name_col: str) -> DataFrame:
    """``qid, name``: the names a query's filter lets through, related names included."""
    asked = parsed.select("qid", F.explode("name_filter").alias("asked"))
    return related_names(asked, names, "qid", "asked", name_col)


def word_recall(index: bm25.Bm25Index, parsed: DataFrame, k: int = WORD_K, overfetch: int = OVERFETCH) -> DataFrame:
    """BM25 lists; queries with names fetch more, because they are filtered afterwards."""
    terms = parsed.select("qid", F.explode(mixed_tokens(F.col("query"))).alias("term"))
    wide = bm25.search(index, terms, k * overfetch)
    named = parsed.select("qid", F.when(F.size("names") > 0, k * overfetch).otherwise(k).alias("k"))
    return wide.join(named, "qid").filter(F.col("rank") <= F.col("k")).drop("k")


def post_filter(ranked: DataFrame, parsed: DataFrame, meta: DataFrame, allowed: DataFrame, id_col: str, name_col: str, category_col: str) -> DataFrame:
    """Filter above the limit: rows of allowed names and of the wanted category; ranks are
    renumbered, the list is not filled up again. The lists are written, and only the documents
    in them are looked at further."""
    ranked = cut(ranked)
    known = only(meta.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(category_col).alias("category")), ranked, "id")
    rows = ranked.join(known, "id", "left")
    asked = parsed.select("qid", F.col("name_filter").isNotNull().alias("filtered"), F.col("category").alias("wanted"))
    rows = rows.join(asked, "qid").join(allowed.withColumn("ok", F.lit(True)), ["qid", "name"], "left")
    kept = rows.filter((~F.col("filtered") | F.coalesce("ok", F.lit(False))) & queryparse.category_matches(F.coalesce("category", F.lit("")), F.col("wanted")))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))).select("qid", "id", "score", "rank")


def filtered_word_recall(index: bm25.Bm25Index, parsed: DataFrame, meta: DataFrame, allowed: DataFrame, id_col: str, name_col: str, category_col: str, k: int = WORD_K, overfetch: int = OVERFETCH) -> DataFrame:
    """``post_filter`` of ``word_recall``, with the lists of queries of the same terms filtered
    before they are copied to the queries: a query with names meets them by list and name."""
    lists, members = bm25.search_groups(index, parsed.select("qid", F.explode(mixed_tokens(F.col("query"))).alias("term")), k * overfetch)
    known = only(meta.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(category_col).alias("category")), lists, "id")
    listed = lists.join(known, "id", "left")
    asked = members.join(parsed.select("qid", F.when(F.size("names") > 0, k * overfetch).otherwise(k).alias("_k"), F.col("name_filter").isNotNull().alias("filtered"), F.col("category").alias("wanted")), "qid")
    named = asked.filter("filtered").join(allowed, "qid").join(listed, ["gid", "name"])
    others = asked.filter("NOT filtered").join(listed, "gid")
    columns = ["qid", "id", "score", "rank", "_k", "category", "wanted"]
    kept = named.select(*columns).unionByName(others.select(*columns)).filter((F.col("rank") <= F.col("_k")) & queryparse.category_matches(F.coalesce("category", F.lit("")), F.col("wanted")))
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "id"))).select("qid", "id", "score", "rank")


def rerank(candidates: DataFrame, k: int = RERANK_K, factory: Callable | None = None) -> DataFrame:
    """``score, rank`` by the model over ``query, content``; ties keep the earlier order."""
    score = models.rerank_score(F.col("query"), F.col("content"), factory or models.overlap_ranker)
    order = Window.partitionBy("qid").orderBy(F.col("score").desc(), "rank_before", "id")
    ranked = candidates.withColumnRenamed("rank", "rank_before").withColumn("score", score)
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).drop("rank_before")


def format_item(rank: Column, name: Column, section: Column, category: Column, content: Column) -> Column:
    """Header with what is known, then the content without empty lines."""
    name, section, category = (F.coalesce(c, F.lit("")) for c in (name, section, category))
    head = F.concat_ws(" | ", F.concat(F.lit("【检索结果 "), rank.cast("string"), F.lit("】")), F.when(name != "", F.concat(F.lit("药品："), name)), F.when(section != "", F.concat(F.lit("章节："), section)), F.when((category != "") & (category != name), F.concat(F.lit("分类："), category)))
    return F.concat(head, F.lit("\n"), F.replace(F.regexp_replace(content, "(?U)^\\s+|\\s+$", ""), F.lit("\n\n"), F.lit("\n")))


def assemble_context(items: DataFrame, item_cap: int = ITEM_CAP, total_cap: int = TOTAL_CAP, least: int = LEAST_REST) -> DataFrame:
    """``qid, context, n_items``: items in order while they fit; the first that does not is
    cut to what is left if that is more than ``least``, and nothing comes after it.

    ``items`` has ``qid, rank, item``, ranks from 1 without gaps. Every item has a character, so
    ranks above the budget are left out before anything is moved.
    """
    cut_item = items.filter(F.col("rank") <= total_cap).withColumn("item", F.substring("item", 1, item_cap))
    before = F.coalesce(F.sum(F.length("item")).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = cut_item.withColumn("before", before).filter(F.col("before") <= total_cap)
    over = F.col("before") + F.length("item") > total_cap
    flagged = placed.withColumn("over", over).withColumn("overs", F.sum(F.col("over").cast("int")).over(Window.partitionBy("qid").orderBy("rank")))
    rest = total_cap - F.col("before")
    kept = flagged.filter((F.col("overs") == 0) | (F.col("over") & (F.col("overs") == 1) & (rest > least)))
    final = kept.withColumn("item", F.when(F.col("over"), F.expr(f"substring(item, 1, {total_cap} - before)")).otherwise(F.col("item")))
    ordered = F.array_sort(F.collect_list(F.struct("rank", "item")))
    return final.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["item"]), "\n---\n").alias("context"), F.count(F.lit(1)).alias("n_items"))


def hybrid_search(queries: DataFrame, docs: DataFrame, vectors: DataFrame | None = None, embed: Callable[[Column], Column] | None = None, id_col: str = "chunk_seq", name_col: str = "drug_name", section_col: str = "section", category_col: str = "category", text_col: str = "content", k: int = RERANK_K, enable_reranker: bool = True, enable_filter: bool = True, given_names: DataFrame | None = None) -> DataFrame:
    """End to end: ``qid, rank, id, score, rrf_score, sources, name, section, category, content``.

    ``vectors`` (``id, embedding``, with ``name, category`` if they are stored beside) may be a
    stored index; otherwise documents are embedded by ``embed``. With ``enable_filter`` off neither path is filtered. ``given_names``
    (``qid, name``) replaces the names found in the queries.
    """
    embed = embed or models.embed
    names = docs.select(name_col).filter(F.col(name_col).isNotNull()).distinct()
    parsed = queryparse.parse(queries, names, name_col)
    parsed = cut(parsed if given_names is None else queryparse.override(parsed, given_names))
    if not enable_filter:
        parsed = parsed.withColumn("name_filter", F.lit(None).cast("array<string>")).withColumn("category", F.lit(None).cast("string"))
    allowed = cut(allowed_names(parsed, names, name_col))
    index = bm25.build_mixed(docs, text_col, id_col)
    words = filtered_word_recall(index, parsed, docs, allowed, id_col, name_col, category_col)
    meta = docs.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(section_col).alias("section"), F.col(category_col).alias("category"), F.col(text_col).alias("content"))

    if vectors is None:
        table = docs.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), F.col(category_col).alias("category"), embed(F.coalesce(F.col(text_col), F.lit(""))).alias("embedding"))
    else:
        table = vectors if {"name", "category"} <= set(vectors.columns) else vectors.join(meta.select("id", "name", "category"), "id")
    asked = cut(parsed.select("qid", embed(F.col("query")).alias("embedding")))
    near = filtered_vector_recall(table, asked, parsed, allowed)
    fused = stored(fusion.fuse({"vector": near, "bm25": words}))
    if not enable_reranker:
        first = fused.filter(F.col("rank") <= k)
        return first.join(only(meta, first, "id"), "id", "left").withColumn("score", F.col("rrf_score"))
    asked_by = fused.join(parsed.select("qid", "query"), "qid")
    candidates = asked_by.join(only(meta.select("id", "content"), fused, "id"), "id", "left")
    # the contents are scored where they meet the questions; only those of the last lists are moved on
    best = stored(rerank(candidates, k).select("qid", "id", "rrf_score", "sources", "score", "rank"))
    return best.join(only(meta, best, "id"), "id", "left")


def contexts(results: DataFrame) -> DataFrame:
    """``qid, context, n_items`` of search results."""
    item = format_item(F.col("rank"), F.col("name"), F.col("section"), F.col("category"), F.coalesce("content", F.lit("")))
    return assemble_context(results.select("qid", "rank", item.alias("item")))


def filtered_vector_recall(table: DataFrame, asked: DataFrame, parsed: DataFrame, allowed: DataFrame, k: int = VECTOR_K) -> DataFrame:
    """``qid, id, score, rank``: filter below the limit. ``table`` has ``id, name, category,
    embedding``; a query's allowed names and categories go with its vector as two arrays, and
    one pass over the vectors ranks for all queries, filtered or not."""
    names = allowed.groupBy("qid").agg(F.collect_set("name").alias("_names"))
    stored = broadcast_checked(table.select(F.col("category").alias("stored")).filter("stored IS NOT NULL").distinct())
    wanted = parsed.select("category").filter("category IS NOT NULL").distinct()  # a few words
    matching = wanted.join(stored, queryparse.category_matches(F.col("stored"), F.col("category"))).groupBy("category").agg(F.collect_set("stored").alias("_categories"))
    filters = parsed.select("qid", F.col("name_filter").isNotNull().alias("named"), "category").join(names, "qid", "left").join(F.broadcast(matching), "category", "left")
    none = F.array().cast("array<string>")
    filters = filters.select("qid", F.when(F.col("named"), F.coalesce("_names", none)).alias("names"), F.when(F.col("category").isNotNull(), F.coalesce("_categories", none)).alias("categories"))
    return vector.top_k(table, asked.join(filters, "qid"), k, within={"name": "names", "category": "categories"})
