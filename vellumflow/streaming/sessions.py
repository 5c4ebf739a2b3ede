"""Streaming forms: sessions with a timeout, trust state, event rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def session_windows(events: DataFrame, key: str, at: str, gap: str = "24 hours", late: str = "1 hour") -> DataFrame:
    """Closed sessions per key; on a stream the watermark ends and releases them."""
    marked = events.withWatermark(at, late) if events.isStreaming else events
    grouped = marked.groupBy(F.col(key), F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"))
    return grouped.select(key, F.col("w.start").alias("started_at"), F.col("w.end").alias("expires_at"), "n_events")


def trust(turns: DataFrame, key: str, at: str, on_topic: str, timeout_ms: int = 86_400_000) -> DataFrame:
    """``key, turn, verdict`` on a stream: a session whose question matched ``on_topic`` is
    trusted until it has been idle for ``timeout_ms``; state is one flag per session."""
    kind = turns.schema[key].dataType.simpleString()

    def step(k: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        trusted = state.get[0] if state.exists else False
        for pdf in batches:
            verdicts = []
            for hit in pdf.sort_values("turn")["text"].fillna("").str.contains(on_topic, regex=True):
                trusted = trusted or bool(hit)
                verdicts.append("pass" if trusted else "ask")
            yield pd.DataFrame({"key": k[0], "turn": pdf.sort_values("turn")["turn"].to_numpy(), "verdict": verdicts})
        state.update((trusted,))
        state.setTimeoutDuration(timeout_ms)

    return turns.groupBy(key).applyInPandasWithState(step, f"key {kind}, turn bigint, verdict string", "trusted boolean", "append", GroupStateTimeout.ProcessingTimeTimeout)


def event_rows(answers: DataFrame, key: str, answer_col: str, size: int = 50) -> DataFrame:
    """An answer as the rows of its event stream: ``content`` pieces, then ``metadata``."""
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.length(answer_col) - 1, F.lit(0)), F.lit(size)), lambda i: F.struct(F.lit("content").alias("kind"), F.substring(F.col(answer_col), i + 1, F.lit(size)).alias("payload")))
    last = F.array(F.struct(F.lit("metadata").alias("kind"), F.to_json(F.struct(F.length(answer_col).alias("length"))).alias("payload")))
    return answers.select(key, F.posexplode(F.concat(pieces, last)).alias("seq", "e")).select(key, "seq", "e.kind", "e.payload")


def sse_lines(rows: DataFrame) -> DataFrame:
    """``data: `` lines of event rows, for a sink behind ``foreachBatch``."""
    return rows.withColumn("line", F.concat(F.lit("data: "), F.to_json(F.struct("kind", "payload")), F.lit("\n\n")))
