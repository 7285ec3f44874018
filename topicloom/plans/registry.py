"""Every query of the engine by name, with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import text_queries, topic_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = text_queries.QUERIES | topic_queries.QUERIES
ORACLE: dict[str, str] = text_queries.ORACLE | topic_queries.ORACLE
