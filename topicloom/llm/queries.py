"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, chat_format, exact_dedup, langid, mixing, near_dup, packing, pii, substring, warc

MODULES = [exact_dedup, chat_format, packing, mixing, substring, warc, pii, langid, near_dup, ann]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
for m in MODULES:
    QUERIES |= m.QUERIES
    ORACLE |= m.ORACLE
