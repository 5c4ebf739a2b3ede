"""Registered queries: a DataFrame form of every operator over the given tables, and its SQL."""

from __future__ import annotations

from . import blocks, chunking, dialogue, ranking, relational, stores, texts

MODULES = (texts, blocks, chunking, ranking, relational, dialogue, stores)


def all_queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def all_sql() -> dict:
    return {name: s for m in MODULES for name, s in m.SQL.items()}
