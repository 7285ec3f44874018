"""Words and documents against topic centroids: threshold, top words, MMR selection, softmax."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import unit
from .anchors import cosine_to

#: Words that a topic's selection starts from, and that it selects, at most.
POOL, MOST = 100, 50


def topic_words(words: DataFrame, centroids: DataFrame, min_prob: float = 0.15, key: str = "word", pool: int = POOL) -> DataFrame:
    """``topic_id, rank, <key>, sim``: the ``pool`` nearest words of each topic from ``min_prob`` on; ties by word."""
    met = cosine_to(words, centroids, key).filter(F.col("sim") >= min_prob)
    w = Window.partitionBy("topic_id").orderBy(F.desc(F.round("sim", 9)), key)
    return met.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= pool).select("topic_id", "rank", key, "sim")


def _mmr(key: str, diversity: float, cap: float, most: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        x, rel = np.stack(pdf["embedding"]), pdf["sim"].to_numpy().round(9)
        sim = (x @ x.T).round(9)
        chosen, free, worst = [0], np.ones(len(x), bool), sim[0].copy()
        free[0] = False
        while len(chosen) < most:
            able = free & (worst < cap)
            if not able.any():
                break
            score = np.where(able, ((1 - diversity) * rel - diversity * worst).round(9), -np.inf)
            best = int(score.argmax())
            chosen.append(best)
            free[best] = False
            worst = np.maximum(worst, sim[best])
        out = pdf.iloc[chosen][["topic_id", key, "sim"]].astype({key: object})
        return out.assign(rank=range(1, len(out) + 1))[["topic_id", "rank", key, "sim"]]

    return run


def mmr_words(words: DataFrame, centroids: DataFrame, min_prob: float = 0.15, diversity: float = 0.2, max_sim: float = 0.85, key: str = "word", most: int = MOST) -> DataFrame:
    """Maximal marginal relevance within each topic's pool (at most ``POOL`` rows a group).

    The nearest word first; then, of words whose largest similarity to the chosen ones is under ``max_sim``,
    the best of (1 - diversity) relevance - diversity similarity. ``sim`` is the cosine to the centroid,
    in order of choice. A topic with one word keeps it; a topic with none has no rows.
    """
    pool = topic_words(words, centroids, min_prob, key).join(words.select(key, "embedding"), key)
    kind = words.schema[key].dataType.simpleString()
    return pool.groupBy("topic_id").applyInPandas(_mmr(key, diversity, max_sim, most), f"topic_id int, rank int, {key} {kind}, sim double")


def doc_topics(docs: DataFrame, centroids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, topic_id, prob``: softmax over topics of a document's cosines; stateless, so it streams too."""
    spread = F.array_sort(F.collect_list(F.struct("topic_id", "centroid")))
    few = F.broadcast(centroids.groupBy().agg(spread.alias("cs")))
    dots = F.transform("cs", lambda c: F.aggregate(F.zip_with("embedding", c["centroid"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    met = docs.crossJoin(few).select(key, F.transform("cs", lambda c: c["topic_id"]).alias("ids"), dots.alias("s")).withColumn("top", F.array_max("s"))
    met = met.withColumn("e", F.transform("s", lambda v: F.exp(v - F.col("top"))))
    met = met.withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    probs = met.select(key, F.explode(F.zip_with("ids", F.transform("e", lambda v: v / F.col("total")), lambda i, p: F.struct(i.alias("topic_id"), p.alias("prob")))).alias("x"))
    return probs.select(key, "x.topic_id", "x.prob")


def dominant(probs: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, topic_id, prob``: each document's first most probable topic."""
    best = F.min(F.struct((-F.round("prob", 9)).alias("o"), "topic_id", "prob"))
    return probs.groupBy(key).agg(best.alias("b")).select(key, "b.topic_id", "b.prob")


def topic_counts(dominants: DataFrame, topics: DataFrame) -> DataFrame:
    """``topic_id, n``: documents by dominant topic; topics without any count 0."""
    n = dominants.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    return topics.select("topic_id").join(n, "topic_id", "left").select("topic_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


class WordTopicProjector:
    """A vocabulary against a fitted clusterer's topics."""

    def __init__(self, clusterer, embedder) -> None:  # noqa: ANN001
        self.clusterer, self.embedder = clusterer, embedder

    def project_vocabulary(self, vocab: DataFrame, min_prob: float = 0.15, mmr_diversity: float = 0.2, mmr_max_sim: float = 0.85, normalize_embeddings: bool = False) -> DataFrame:
        words = self.embedder.encode(vocab.select("word").distinct(), "word", "word")
        if normalize_embeddings:
            words = words.withColumn("embedding", unit(F.col("embedding")))
        centroids = self.clusterer.centroids(vocab.sparkSession).withColumn("centroid", unit(F.col("centroid")))
        return mmr_words(words, centroids, min_prob, mmr_diversity, mmr_max_sim)
