"""Model boundaries: embedding, reranking and generation behind Arrow batches.

A model is a plain callable, built once per worker by a factory; the factories here are
deterministic stand-ins that need no weights.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embed = Callable[[list[str]], np.ndarray]
Rank = Callable[[str, list[str]], list[float]]
Chat = Callable[[str], str]


def hashing_embedder(dim: int = 64) -> Embed:
    """Unit vectors from hashed character bigrams."""

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            codes = np.frombuffer((t + "  ")[: max(len(t), 2)].encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            mixed = (codes[:-1] * np.uint64(1_000_003) + codes[1:]) * np.uint64(0x9E3779B97F4A7C15)
            slots, signs = (mixed >> np.uint64(20)) % np.uint64(dim), (mixed >> np.uint64(63)).astype(np.float64) * 2 - 1
            out[i] = np.bincount(slots.astype(np.int64), weights=signs, minlength=dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)

    return run


def overlap_ranker() -> Rank:
    """Share of the query's characters that stand in the text."""

    def run(query: str, texts: list[str]) -> list[float]:
        asked = set(query)
        return [len(asked & set(t)) / max(len(asked), 1) for t in texts]

    return run


def echo_chat() -> Chat:
    return lambda prompt: "根据参考资料：" + prompt[-200:]


def embed(text: Column, factory: Callable[[], Embed] = hashing_embedder, prefix: str = "", batch: int = 32) -> Column:
    """``array<float>`` of a text; the prefix is the instruction put before queries."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for series in batches:
            values = [prefix + (t or "") for t in series]
            parts = [model(values[a : a + batch]) for a in range(0, len(values), batch)]
            yield pd.Series([row for part in parts for row in part], index=series.index)

    return run(text)


def rerank_score(query: Column, text: Column, factory: Callable[[], Rank] = overlap_ranker, longest: int = 1_024) -> Column:
    """Score of the pair; the text is cut to what the model takes."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, t in batches:
            texts, scores, by = t.tolist(), np.zeros(len(q)), {}
            for i, query_text in enumerate(q.fillna("").tolist()):
                by.setdefault(query_text, []).append(i)
            for query_text, rows in by.items():  # in lists: a batch may hold a query for every row
                scores[rows] = model(query_text, [texts[i] or "" for i in rows])
            yield pd.Series(scores, index=q.index)

    return run(query, F.substring(text, 1, longest))


def _reply(model: Chat, prompt: str, attempts: int, wait: float) -> tuple[str, str | None]:
    error = None
    for no in range(attempts):
        try:
            return model(prompt), None
        except Exception as e:  # noqa: BLE001
            error = str(e)
            if no + 1 < attempts:
                time.sleep(wait * 2**no)
    return "[ERROR]", error


def said(prompt: Column, factory: Callable[[], Chat] = echo_chat, attempts: int = 3, wait: float = 2.0) -> Column:
    """``struct<answer, error>`` of a prompt as ``generate`` gives them, beside the other columns
    of a row; a NULL prompt is not sent and gives NULLs."""

    @F.pandas_udf("answer string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for prompts in batches:
            yield pd.DataFrame([(None, None) if p is None else _reply(model, p, attempts, wait) for p in prompts], columns=["answer", "error"], dtype=object)

    return run.asNondeterministic()(prompt)  # so that no plan calls a model twice


def generate(prompts: DataFrame, key: str, prompt_col: str, factory: Callable[[], Chat] = echo_chat, attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """``key, answer, error``: one call per prompt, tried ``attempts`` times with doubled
    waits; a call that fails for good gives ``[ERROR]`` and its message, not a failed job."""
    kind = prompts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for pdf in batches:
            replies = [_reply(model, prompt or "", attempts, wait) for prompt in pdf["prompt"]]
            yield pd.DataFrame({"key": pdf["key"], "answer": [a for a, _ in replies], "error": [e for _, e in replies]})

    found = prompts.select(F.col(key).alias("key"), F.col(prompt_col).alias("prompt")).mapInPandas(run, f"key {kind}, answer string, error string")
    return found.withColumnRenamed("key", key)
