"""Sessions as a keyed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIFETIME = "24 HOURS"


def session_id(*keys: Column) -> Column:
    """``sess_`` and twelve hexadecimal digits, the same for the same keys."""
    return F.concat(F.lit("sess_"), F.substring(F.sha2(F.concat_ws("\x1f", *[k.cast("string") for k in keys]), 256), 1, 12))


def last_active(events: DataFrame, key: str, at: str) -> DataFrame:
    return events.groupBy(key).agg(F.min(at).alias("created_at"), F.max(at).alias("last_active"), F.count(F.lit(1)).alias("n_events"))


def expired(sessions: DataFrame, now: Column, lifetime: str = LIFETIME) -> DataFrame:
    """``is_expired``: the last activity lies more than the lifetime back."""
    return sessions.withColumn("is_expired", now - F.col("last_active") > F.expr(f"INTERVAL {lifetime}"))


def valid_request(question: Column, temperature: Column, max_tokens: Column, top_k: Column) -> Column:
    """Bounds of a request; NULL parameters take their defaults and are valid."""
    ok = lambda c, lo, hi: F.coalesce(c.between(lo, hi), F.lit(True))
    return F.coalesce(F.length(question).between(1, 500), F.lit(False)) & ok(temperature, 0, 2) & ok(max_tokens, 100, 8192) & ok(top_k, 1, 30)


def get(sessions: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    """The sessions asked for; an unknown one gives no row."""
    return sessions.join(ids.select(key).distinct(), key, "left_semi")


def delete(sessions: DataFrame, ids: DataFrame, key: str = "session_id") -> DataFrame:
    """The sessions that are left."""
    return sessions.join(ids.select(key).distinct(), key, "left_anti")


def cleanup(sessions: DataFrame, now: Column, lifetime: str = LIFETIME) -> DataFrame:
    """The sessions that have not expired."""
    return expired(sessions, now, lifetime).filter("NOT is_expired").drop("is_expired")
