"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.plans import feature_queries, operator_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = feature_queries.QUERIES | table_queries.QUERIES | operator_queries.QUERIES
ORACLE_SQL: dict[str, str] = feature_queries.SQL | table_queries.SQL | operator_queries.SQL
