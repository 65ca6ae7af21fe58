"""Registered queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tieledger.plans import activity_queries, graph_queries, identity_queries, ledger_queries, rule_queries, source_queries

_ALL = [*ledger_queries.Q.entries, *graph_queries.Q.entries, *activity_queries.Q.entries, *rule_queries.Q.entries, *source_queries.Q.entries, *identity_queries.Q.entries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, run, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, _, sql in _ALL if sql}
