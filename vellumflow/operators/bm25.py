"""BM25 as tables: postings, document lengths, dictionary, corpus statistics.

Building counts the terms of each document where it stands, without a shuffle, and aggregates
once by term. Searching takes only the postings of the query terms and cuts the documents into
shards. A histogram of each term's weights gives a score that the ``k`` best of a query reach at
least; a shard raises it, looks only into the lists of terms that can reach it, and returns only what does
(exact: what is left out cannot be among the ``k`` best). Queries of the same terms are searched
once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumflow.session import BROADCAST_ROWS, cut, stored

from .tokens import mixed_counts

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Parts into which the postings of a term are cut where terms are too many to be broadcast.
SALTS = 16
#: Postings of a shard; least postings for which another of the first shards is made, and how many those are.
SHARD_POSTINGS, LEAST_POSTINGS, FIRST_SHARDS = 3_000_000, 50_000, 6
#: A list of up to so many times the documents looked up in it is spread out, a longer one is searched.
DENSE = 8
#: Query terms of a block, which a shard meets at once.
BLOCK_TERMS = 4_000_000
#: Steps of the histograms of weights to 1, a power of 2; slack for the order of sums.
STEPS, SLACK = 512, 1e-6


@dataclass
class Bm25Index:
    postings: DataFrame  # id, term, tf, dl
    terms: DataFrame  # term, df, idf
    stats: DataFrame  # n_docs, avgdl

    def save(self, path: str) -> None:
        """The derived tables; postings are ordered by term in every file, so that a scan for few
        terms prunes pages, and need no shuffle."""
        self.postings.sortWithinPartitions("term").write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/postings")
        self._save_statistics(path)

    def _save_statistics(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.stats.write.mode("overwrite").parquet(f"{path}/stats")

    def counts(self) -> DataFrame:
        """``n_docs, n_terms, n_postings`` in one row."""
        return self.stats.select("n_docs").crossJoin(self.terms.agg(F.count(F.lit(1)).alias("n_terms"))).crossJoin(self.postings.agg(F.count(F.lit(1)).alias("n_postings")))  # one row each

    @staticmethod
    def load(spark, path: str) -> Bm25Index:
        return Bm25Index(*(spark.read.parquet(f"{path}/{part}") for part in ("postings", "terms", "stats")))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, term, tf, dl`` of the documents of a batch; a document is one row."""
    for batch in batches:
        tokens, ids = batch.column(1), batch.column(0)
        size = pc.fill_null(pc.list_value_length(tokens), 0)
        rows = pa.table({"row": pc.list_parent_indices(tokens), "term": pc.list_flatten(tokens)}).group_by(["row", "term"]).aggregate([([], "count_all")])
        row = rows["row"].combine_chunks()
        out = [ids.take(row), rows["term"].combine_chunks(), rows["count_all"].combine_chunks(), size.take(row).cast(pa.int32())]
        yield pa.RecordBatch.from_arrays(out, ["id", "term", "tf", "dl"])


def _count_mixed(batches: Iterator[pa.RecordBatch], by_term: bool) -> Iterator[pa.RecordBatch]:
    """``_count`` of the mixed tokens of a text, ordered by term or by document."""
    for batch in batches:
        row, term, times, size = mixed_counts(batch.column(1))
        if not by_term:
            order = np.argsort(row, kind="stable")
            row, term, times = row[order], term.take(pa.array(order)), times[order]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), term, pa.array(times), pa.array(size[row].astype(np.int32))], ["id", "term", "tf", "dl"])


def build(docs: DataFrame, tokens: Column, id_col: str = "id") -> Bm25Index:
    """One document per id. Documents without tokens count for the statistics with length 0."""
    tokenised = docs.select(F.col(id_col).alias("id"), tokens.alias("tokens"))
    return _index(docs, tokenised.mapInArrow(_count, f"id {_kind(tokenised)}, term string, tf bigint, dl int"))


def build_mixed(docs: DataFrame, text_col: str, id_col: str = "id", path: str | None = None) -> Bm25Index:
    """The index of ``mixed_tokens`` of a text, counted without a row or a string per token.
    With ``path`` it is also saved there: its postings are written there at once, ordered by term
    in every batch of documents, and not a second time."""
    texts, by_term = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), path is not None
    index = _index(docs, texts.mapInArrow(lambda batches: _count_mixed(batches, by_term), f"id {_kind(texts)}, term string, tf bigint, dl int"), path and f"{path}/postings")
    if path:
        index._save_statistics(path)
    return index


def _kind(df: DataFrame) -> str:
    return df.schema["id"].dataType.simpleString()


def _index(docs: DataFrame, counted: DataFrame, path: str | None = None) -> Bm25Index:
    """The postings are written once, compressed, at ``path`` or in the shared folder; dictionary
    and statistics are aggregations of them and do not tokenise again."""
    postings = stored(counted, path)
    n_docs = docs.agg(F.count(F.lit(1)).alias("n_docs"))
    counts = cut(postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")))
    stats = cut(n_docs.crossJoin(counts.agg(F.sum("tf").alias("n_tokens"))).select("n_docs", (F.coalesce("n_tokens", F.lit(0)) / F.greatest("n_docs", F.lit(1))).alias("avgdl")))  # one row each
    n_docs = stats.select("n_docs")
    frequencies = counts.select("term", "df").crossJoin(F.broadcast(n_docs))  # one row
    raw = frequencies.withColumn("raw", F.log(F.col("n_docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    floor = raw.agg((F.avg("raw") * EPSILON).alias("floor"))
    terms = raw.crossJoin(F.broadcast(floor)).select("term", "df", F.when(F.col("raw") < 0, F.col("floor")).otherwise(F.col("raw")).alias("idf"))  # one row
    return Bm25Index(postings, terms, stats)


def _asked_postings(postings: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """``slot, id, tf, dl`` of the queries' terms. Up to ``most`` terms are broadcast; more are
    joined with a salt from the document, because a frequent term has very many postings."""
    if known.limit(most + 1).count() <= most:
        return postings.join(F.broadcast(known), "term").select("slot", "id", "tf", "dl")
    salted = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["term", "_salt"]).select("slot", "id", "tf", "dl")


def search_groups(index: Bm25Index, query_terms: DataFrame, k: int = 15, k1: float = K1, b: float = B, most: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Lists ``gid, id, score, rank`` of the queries that differ in their known terms, and
    ``qid, gid``: which list is a query's. Both are written."""
    asked = query_terms.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))
    known = cut(asked.select("term").distinct().join(index.terms, "term").withColumn("slot", F.monotonically_increasing_id()))
    n_postings = known.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    avgdl = index.stats.first()["avgdl"]
    postings = stored(_asked_postings(index.postings, known.select("term", "slot"), most))
    weight = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(avgdl)))
    steps = postings.groupBy("slot", F.floor(weight * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.partitionBy("slot").orderBy(F.col("step").desc()))
    reached = steps.withColumn("above", above).groupBy("slot").agg((F.coalesce(F.max(F.when(F.col("above") >= k, F.col("step"))), F.lit(0)) / STEPS).alias("low"))

    terms = known.join(reached, "slot").select("term", "slot", "idf", "low")
    factor = F.col("times") * F.col("idf")
    bag = F.array_sort(F.collect_list(F.struct("slot", factor.alias("factor"))))
    # the k best of any one term have its weight, and lose no more than what terms below 0 can take
    least = F.max(factor * F.col("low")) + F.sum(F.least(factor, F.lit(0.0)) * (k1 + 1))
    bags = asked.join(terms, "term").groupBy("qid").agg(bag.alias("bag"), least.alias("least"))
    bags = cut(bags.withColumn("gid", F.min("qid").over(Window.partitionBy("bag"))))
    once = bags.filter("qid <=> gid").select("gid", F.transform("bag", lambda t: t["slot"]).alias("slots"), F.transform("bag", lambda t: t["factor"]).alias("factors"), "least")

    shards = max(1, min(FIRST_SHARDS, n_postings // LEAST_POSTINGS), -(-n_postings // SHARD_POSTINGS))
    n_terms = once.agg(F.coalesce(F.sum(F.size("slots")), F.lit(0))).first()[0]
    blocks = max(1, -(-n_terms // min(20 * most, BLOCK_TERMS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    places = postings.select("slot", "id", F.col("tf").cast("int").alias("tf"), "dl", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("_shard")).withColumn("_block", every(blocks) if blocks > 1 else F.lit(0))
    queries = once.withColumn("_block", F.pmod(F.xxhash64("gid"), F.lit(blocks)).cast("int")).withColumn("_shard", every(shards))
    kinds = f"gid {once.schema['gid'].dataType.simpleString()}, id {places.schema['id'].dataType.simpleString()}, score double"

    def run(places: pa.Table, queries: pa.Table) -> pa.Table:
        return _shard_top(places, queries, k, k1, b, avgdl)

    keys, parts = ["_shard", "_block"], 4 * shards * blocks + 1  # by number, or small shards are put into one task
    found = places.repartition(parts, *keys).groupBy(*keys).cogroup(queries.repartition(parts, *keys).groupBy(*keys)).applyInArrow(run, kinds)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("gid").orderBy(F.round("score", 9).desc(), "id")))
    return stored(ranked.filter(F.col("rank") <= k)), bags.select("qid", "gid")


def search(index: Bm25Index, query_terms: DataFrame, k: int = 15, k1: float = K1, b: float = B, most: int = BROADCAST_ROWS) -> DataFrame:
    """``qid, id, score, rank``: the ``k`` best documents per query; ties by id.

    ``query_terms`` has ``qid, term`` with one row per token, so that a repeated token counts
    as often. Scores of 0 or below are dropped.
    """
    lists, members = search_groups(index, query_terms, k, k1, b, most)
    return members.withColumnRenamed("gid", "_gid").join(lists, F.col("_gid").eqNullSafe(F.col("gid"))).select("qid", "id", "score", "rank")


def _shard_top(places: pa.Table, queries: pa.Table, k: int, k1: float, b: float, avgdl: float) -> pa.Table:
    """``gid, id, score`` of the documents of a shard that may be among the ``k`` best.

    A query takes its lists from the one of the highest factor on, in every shard in the same order, so
    that equal documents have equal sums. The ``k`` best of a list so far raise what a document needs;
    once the lists left do not reach it alone, they are only looked up.
    """
    ids = pc.unique(places["id"])
    ids = ids.take(pc.sort_indices(ids))  # documents are numbered in the order of their ids
    doc = pc.index_in(places["id"], ids).to_numpy().astype(np.int64)
    slot, tf, dl = (places[c].to_numpy() for c in ("slot", "tf", "dl"))
    order = np.lexsort((doc, slot))
    doc, tf, dl = doc[order], tf[order].astype(np.float64), dl[order]
    weight = tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))
    held, start = np.unique(slot[order], return_index=True)
    highest = np.maximum.reduceat(weight, start) if len(held) else weight
    start = np.append(start, len(doc))

    # terms of the queries, query by query, without those that the shard does not hold
    size = pc.list_value_length(queries["slots"]).to_numpy()
    terms, factor = (pc.list_flatten(queries[c]).to_numpy() for c in ("slots", "factors"))
    owner, least = np.repeat(np.arange(len(size)), size), np.maximum(queries["least"].to_numpy() - SLACK, 0)
    lost = np.bincount(owner, np.minimum(factor, 0) * (k1 + 1), len(size)) - SLACK  # what a score may still lose
    at = np.minimum(np.searchsorted(held, terms), max(len(held) - 1, 0))
    mine = held[at] == terms if len(held) else np.zeros(len(terms), bool)
    at, factor, owner = at[mine], factor[mine], owner[mine]
    most = np.maximum(factor * highest[at], 0) if len(held) else factor
    reach = np.bincount(owner, most, len(size))  # what all terms together reach
    use = (reach >= least)[owner] & (factor != 0)
    at, factor, owner, most = at[use], factor[use], owner[use], most[use]
    order = np.lexsort((at, -factor, owner))
    at, factor, owner, most = at[order], factor[order], owner[order], most[order]
    asked, first = np.unique(owner, return_index=True)
    from_, to = start[at].tolist(), start[at + 1].tolist()
    factor, most, ends, least, lost, reach = factor.tolist(), most.tolist(), np.append(first, len(owner)).tolist(), least.tolist(), lost.tolist(), reach.tolist()

    total = np.zeros(len(ids))
    gids, docs, scores = [], [], []
    for n, q in enumerate(asked.tolist()):
        i, end, rest, need = ends[n], ends[n + 1], reach[q], least[q]
        lists, parts = [], []
        while i < end and most[i] > 0 and rest >= need:  # else documents of the other lists alone do not reach it
            d = doc[from_[i] : to[i]]
            before = total[d]
            s = before + weight[from_[i] : to[i]] * factor[i]
            total[d] = s
            parts.append(d[before == 0] if lists else d)
            lists.append(d)
            rest -= most[i]
            i += 1
            if len(s) >= k and i < end:
                need = max(need, np.partition(s, -k)[-k] + lost[q])
        if not lists:
            continue
        found = []
        for d in parts:
            s = total[d]
            near = s + rest >= need
            found.append((d[near], s[near]))
        for d in lists:
            total[d] = 0
        d, s = found[0] if len(found) == 1 else map(np.concatenate, zip(*found))
        for j in range(i, end):
            if not len(d):
                break
            x, y = from_[j], to[j]
            if y - x < DENSE * len(d):
                total[doc[x:y]] = weight[x:y]
                s = s + total[d] * factor[j]
                total[doc[x:y]] = 0
            else:
                place = np.minimum(np.searchsorted(doc[x:y], d), y - x - 1) + x
                s = s + np.where(doc[place] == d, weight[place] * factor[j], 0)
            rest -= most[j]
            if len(d) > k:
                need = max(need, np.partition(s, -k)[-k] + lost[q])
                near = s + rest >= need
                d, s = d[near], s[near]
        kept = (s >= need) & (s > 0)
        d, s = d[kept], s[kept]
        if len(d) > k:
            best = np.lexsort((d, -np.round(s, 9)))[:k]
            d, s = d[best], s[best]
        if len(d):
            gids.append(np.full(len(d), q))
            docs.append(d)
            scores.append(s)
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    taken = queries["gid"].take(pa.array(join(gids, np.int64)))
    return pa.table({"gid": taken, "id": ids.take(pa.array(join(docs, np.int64))), "score": join(scores, np.float64)})
