"""Topic scores of a stream of documents: stateless, one row per document and topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.embed import HashEmbedder
from ..operators.project import doc_topics


def score_stream(docs: DataFrame, centroids: DataFrame, dim: int = 64, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, topic_id, prob`` for a stream (or a table) of documents, by the hashing embedder's row-wise form."""
    vector = HashEmbedder(dim).vector(F.coalesce(F.col(text), F.lit("")))
    return doc_topics(docs.select(key, vector.alias("embedding")), centroids, key)
