"""Exact inner-product search over a table of vectors, also filtered per query.

Every slice of vectors meets a block of queries in one matrix product; what a query's filter
excludes is masked in the scores, so no row per (query, vector) is ever written, and only the
``k`` best per query leave a task. Queries are sent to the workers if a count shows that they
fit one block. More of them are cut into blocks and the vectors into shards, which meet in a
cogroup; the results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Query vectors, and values allowed by their filters, that are sent to the workers at once.
QUERY_BLOCK, BLOCK_VALUES = 150_000, 4_000_000
#: Numbers of query vectors that are sent at once; queries above which a task for each core is enough.
BLOCK_NUMBERS, MANY = 32_000_000, 4_096
#: Vectors of a shard, and of one matrix product.
SHARD_ROWS, SLICE = 50_000, 1_024
#: Queries of one matrix product.
ROWS = 2_048


def normalise(vector: Column) -> Column:
    """Unit length; a zero vector stays."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 15, id_col: str = "id", vector_col: str = "embedding", where: Column | None = None, within: Mapping[str, str] | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """``qid, id, score, rank`` of the ``k`` largest inner products per query; ties by id.

    ``queries`` has ``qid, embedding``; ``where`` filters the vectors for all queries, and
    Catalyst pushes it into the scan. ``within`` names, for columns of the vectors, the column
    of the queries that holds the array of values a query allows; NULL allows all.
    """
    within = dict(within or {})
    if where is not None:
        vectors = vectors.filter(where)
    source = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"), *[F.col(c).alias(f"_v{i}") for i, c in enumerate(within)]).filter("embedding IS NOT NULL")
    asked = queries.select("qid", "embedding", *[F.col(c).alias(f"_q{i}") for i, c in enumerate(within.values())]).filter("embedding IS NOT NULL")
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, id {source.schema['id'].dataType.simpleString()}, score double"
    values = sum((F.coalesce(F.greatest(F.size(f"_q{i}"), F.lit(0)), F.lit(0)) for i in range(len(within))), F.lit(0))
    free = F.lit(True)
    for i in range(len(within)):
        free = free & F.col(f"_q{i}").isNull()
    n, n_free, n_values, wide = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(free.cast("int")), F.lit(0)), F.coalesce(F.sum(values), F.lit(0)), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    block = max(1, min(block, BLOCK_NUMBERS // max(wide, 1)))
    if n_free <= block and n * wide <= BLOCK_NUMBERS and n_values <= BLOCK_VALUES:
        if n > MANY:  # every task returns k rows a query
            source = source.coalesce(source.sparkSession.sparkContext.defaultParallelism)
        found = _broadcast_top(source, asked, k, len(within), kinds)
    else:
        found = _sharded_top(source, asked, k, len(within), kinds, -(-max(n, n_values * block // BLOCK_VALUES) // block))
    order = Window.partitionBy("qid").orderBy(F.round("score", 9).desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _broadcast_top(source: DataFrame, asked: DataFrame, k: int, filters: int, kinds: str) -> DataFrame:
    sent = source.sparkSession.sparkContext.broadcast(asked.toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BlockTop(sent.value, k, filters)
        for batch in batches:
            best.add(batch)
        yield best.result()

    return source.mapInArrow(run, kinds)


def _sharded_top(source: DataFrame, asked: DataFrame, k: int, filters: int, kinds: str, blocks: int) -> DataFrame:
    shards = max(1, -(-source.count() // SHARD_ROWS))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    v = source.withColumn("_shard", F.pmod(F.xxhash64("id"), F.lit(shards))).withColumn("_block", every(blocks))
    q = asked.withColumn("_block", F.pmod(F.xxhash64("qid"), F.lit(blocks))).withColumn("_shard", every(shards))

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        best = BlockTop(queries, k, filters)
        for batch in vectors.to_batches():
            best.add(batch)
        return pa.Table.from_batches([best.result()])

    return v.groupBy("_shard", "_block").cogroup(q.groupBy("_shard", "_block")).applyInArrow(run, kinds)


class BlockTop:
    """The ``k`` best vectors so far for each query of a block."""

    def __init__(self, queries: pa.Table, k: int, filters: int):
        self.k, self.qids = k, queries.column("qid").combine_chunks()
        flat = queries.column("embedding").combine_chunks()
        flat = pc.list_flatten(flat).to_numpy(zero_copy_only=False)
        self.matrix = flat.reshape(len(self.qids), -1) if len(self.qids) else np.zeros((0, 0))
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.matrix, self.matrix, dtype=np.float64))
        self.floor = np.full(len(self.qids), -np.inf)  # the k-th best score of each query
        self.allowed = [queries.column(f"_q{i}").to_pylist() for i in range(filters)]
        self.free = np.arange(len(self.qids))  # queries without a filter
        self.holders: list[dict] = []  # for each value of a filter, the queries that allow it and have no filter before
        for allowed in self.allowed:
            found: dict = {}
            bound = np.array([allowed[q] is not None for q in self.free.tolist()], dtype=bool)
            for q in self.free[bound].tolist():
                for value in set(allowed[q]):
                    found.setdefault(value, []).append(q)
            self.holders.append({value: np.array(qs) for value, qs in found.items()})
            self.free = self.free[~bound]
        self.allowed = [[None if a is None else frozenset(a) for a in allowed] for allowed in self.allowed[1:]]
        self.held: list[tuple[np.ndarray, pa.Array, np.ndarray]] = []
        self.n_held = self.n_last = 0
        self.id_type: pa.DataType | None = None

    def add(self, batch: pa.RecordBatch) -> None:
        self.id_type = batch.schema.field("id").type
        column = lambda part, name: part.column(part.schema.get_field_index(name))
        for i, holders in enumerate(self.holders if len(batch) else ()):
            coded = column(batch, f"_v{i}").dictionary_encode()
            codes = coded.indices.fill_null(len(coded.dictionary)).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
            for u, value in enumerate(coded.dictionary.to_pylist()):
                if value in holders:
                    self._meet(batch.take(pa.array(order[edges[u] : edges[u + 1]])), holders[value], i + 1)
        for first in range(0, len(batch), SLICE) if len(self.free) else ():
            self._meet(batch.slice(first, SLICE), self.free, len(self.holders))

    def _meet(self, part: pa.RecordBatch, queries: np.ndarray, later: int) -> None:
        """Keep what may be among the best of ``queries``, by products in single precision with
        room for their error; the scores that are kept are exact. Filters from ``later`` on are
        tested for what is kept so far, before anything else is left out."""
        flat = part.column(part.schema.get_field_index("embedding")).flatten().to_numpy(zero_copy_only=False)
        vectors = flat.reshape(len(part), -1)
        norm = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64)).max()
        ids = part.column(part.schema.get_field_index("id"))
        exact = not norm * self.norm.max() < 1e30
        narrow = vectors.astype(np.float64 if exact else np.float32).T
        for first in range(0, len(queries), ROWS):
            qs = queries[first : first + ROWS]
            scores = self.matrix[qs].astype(narrow.dtype) @ narrow
            for i in range(later, len(self.holders)):
                values = part.column(part.schema.get_field_index(f"_v{i}")).to_pylist()
                for n, q in enumerate(qs.tolist()):
                    if (lets := self.allowed[i - 1][q]) is not None:
                        scores[n, [value not in lets for value in values]] = -np.inf
            room = 1e-8 + (vectors.shape[1] + 8) * 1.2e-7 * self.norm[qs] * norm
            least = self.floor[qs]
            new = np.flatnonzero(np.isneginf(least)) if len(part) > self.k else ()
            if len(new):
                take = -np.partition(-scores[new], self.k - 1, axis=1)[:, self.k - 1]
                least[new] = take - room[new]
            q, v = np.divmod(np.flatnonzero(scores >= (least - room)[:, None].astype(scores.dtype)), len(part))
            if later < len(self.holders) and len(q):
                open_ = scores[q, v] > -np.inf
                q, v = q[open_], v[open_]
            if len(q) == 0:
                continue
            q = qs[q]
            self.held.append((q, ids.take(pa.array(v)), np.einsum("ij,ij->i", self.matrix[q].astype(np.float64), vectors[v].astype(np.float64))))
            self.n_held += len(q)
        if self.n_held > self.n_last + self.k * len(self.free) + 1_000_000:
            self._reduce()

    def _reduce(self) -> None:
        if not self.held:
            return
        q, score = np.concatenate([h[0] for h in self.held]), np.concatenate([h[2] for h in self.held])
        ids = pa.chunked_array([h[1] for h in self.held]).combine_chunks()
        if pa.types.is_integer(ids.type) and not ids.null_count:
            order = np.lexsort((ids.to_numpy(), -np.round(score, 9), q))
        else:
            rows = pa.table({"q": q, "s": -np.round(score, 9), "id": ids})
            order = pc.sort_indices(rows, [("q", "ascending"), ("s", "ascending"), ("id", "ascending")]).to_numpy()
        q, score = q[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kept = place < self.k
        last = place == self.k - 1
        self.floor[q[last]] = np.round(score[last], 9)
        self.held = [(q[kept], ids.take(pa.array(order[kept])), score[kept])]
        self.n_held = self.n_last = int(kept.sum())

    def result(self) -> pa.RecordBatch:
        self._reduce()
        if not self.held:
            return pa.RecordBatch.from_arrays([self.qids.slice(0, 0), pa.array([], self.id_type or pa.int64()), pa.array([], pa.float64())], ["qid", "id", "score"])
        q, ids, score = self.held[0]
        return pa.RecordBatch.from_arrays([self.qids.take(pa.array(q)), ids, pa.array(score)], ["qid", "id", "score"])
