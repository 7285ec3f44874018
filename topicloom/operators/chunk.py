"""Documents from raw texts: split, filter, then join consecutive pieces across text boundaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from .order import numbered

STRATEGIES = ("paragraph_group", "fixed_window", "post_group")


class DocumentBuilder:
    """Builds ``chunk_id, text`` from ordered raw texts by one of three strategies."""

    def __init__(self, strategy: str = "paragraph_group", chunk_size: int = 5, delimiter: str = "\n\n") -> None:
        if strategy not in STRATEGIES:
            raise ValueError(f"strategy must be one of {STRATEGIES}")
        if chunk_size < 1:
            raise ValueError("chunk_size must be at least 1")
        self.strategy, self.chunk_size, self.delimiter = strategy, chunk_size, delimiter

    def build(self, texts: DataFrame, text: str = "text", order: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        body = F.coalesce(F.col(text), F.lit(""))
        keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(order)]
        if self.strategy == "post_group":
            pieces = texts.select(*keys, F.lit(0).alias("pos"), body.alias("piece"))
        else:
            import re

            pattern = re.escape(self.delimiter) if self.strategy == "paragraph_group" else r"(?<=[.!?])\s+"
            pieces = texts.select(*keys, F.posexplode(F.split(body, pattern)).alias("pos", "piece"))
            pieces = pieces.withColumn("piece", strip(F.col("piece"))).filter(F.col("piece") != "")
        rows = numbered(pieces, *[f"k{i}" for i in range(len(order))], "pos")
        return group_chunks(rows, self.chunk_size)


def group_chunks(rows: DataFrame, size: int) -> DataFrame:
    """Runs of ``size`` pieces (rn from 0, piece), joined by one space; the last may be shorter."""
    chunks = rows.groupBy(F.floor(F.col("rn") / size).cast("long").alias("chunk_id"))
    parts = F.array_sort(F.collect_list(F.struct("rn", "piece")))
    return chunks.agg(F.array_join(F.transform(parts, lambda x: x["piece"]), " ").alias("text"))
