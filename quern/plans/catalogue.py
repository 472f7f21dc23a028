"""Every query of the library outside the training-data operators, with its SQL."""

from __future__ import annotations

from . import access_queries, conversation_queries, corpus_queries, evaluation_queries, index_queries, ranking_queries, relational_queries, routing_queries, streaming_queries  # noqa: F401
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
