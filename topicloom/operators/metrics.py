"""Topic quality, clustering and classification metrics, as DataFrame plans."""

from __future__ import annotations

import logging
import math

from pyspark.ml.classification import LinearSVC, OneVsRest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import cosine
from .shared import table

EPS = 1e-12


def clean_topics(topics: DataFrame, topk: int = 10) -> DataFrame:
    """``topic_id, rank, word``: without empty words, ranked anew, the first ``topk``; empty topics vanish."""
    rows = topics.filter(F.col("word").isNotNull() & (F.col("word") != ""))
    w = Window.partitionBy("topic_id").orderBy("rank")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= topk).select("topic_id", "rank", "word")


def effective_k(topics: DataFrame, topk: int = 10) -> int:
    """The length all topics can be cut to."""
    least = topics.groupBy("topic_id").count().agg(F.min("count")).first()[0]
    return min(topk, least or 0)


def topic_diversity(topics: DataFrame) -> DataFrame:
    """``diversity``: distinct words over all words; 0 of none."""
    return topics.agg(F.coalesce(F.count_distinct("word") / F.nullif(F.count("word"), F.lit(0)), F.lit(0.0)).alias("diversity"))


def word_pairs(topics: DataFrame) -> DataFrame:
    """``topic_id, wi, wj`` with wi ranked after wj."""
    a, b = topics.select("topic_id", F.col("rank").alias("ri"), F.col("word").alias("wi")), topics.select("topic_id", F.col("rank").alias("rj"), F.col("word").alias("wj"))
    return a.join(b, "topic_id").filter("ri > rj").select("topic_id", "wi", "wj")


def windowed(docs: DataFrame, topics: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Stretches of sliding windows that hold the same topic words (``n, words``), and the number of windows.

    ``docs`` is (doc_id, tokens). A document of L tokens has max(1, L - width + 1) windows. A topic word is in
    a range of windows; ranges are cut at every ``width`` windows, so that a cut lies in two blocks at most, and
    the ranges' ends split a block into stretches. No row is made for a single window.
    """
    size = F.size("tokens")
    total = docs.agg(F.sum(F.greatest(F.lit(1), size - width + 1)).cast("double").alias("n"))
    tokens = docs.select("doc_id", size.alias("len"), F.posexplode("tokens").alias("pos", "word"))
    tokens = tokens.join(topics.select("word").distinct(), "word", "left_semi")
    low, high = F.greatest(F.lit(0), F.col("pos") - (width - 1)), F.least(F.col("pos"), F.greatest(F.lit(0), F.col("len") - width))
    ranges = tokens.select("doc_id", "word", low.alias("low"), high.alias("high"))
    block = lambda c: F.floor(F.col(c) / width)
    cuts = ranges.select("doc_id", "word", "low", "high", F.explode(F.sequence(block("low"), block("high"))).alias("block"))
    cut = F.struct(F.greatest("low", F.col("block") * width).alias("low"), (F.least("high", (F.col("block") + 1) * width - 1) + 1).alias("end"), "word")
    held = cuts.groupBy("doc_id", "block").agg(F.collect_list(cut).alias("cuts"))
    held = held.withColumn("ends", F.array_sort(F.array_union(F.col("cuts.low"), F.col("cuts.end"))))
    stretch = held.select("cuts", F.explode(F.arrays_zip(F.col("ends").alias("a"), F.slice("ends", 2, width + 1).alias("b"))).alias("s")).filter("s.b IS NOT NULL")
    inside = F.filter("cuts", lambda c: (c["low"] <= F.col("s.a")) & (F.col("s.b") <= c["end"]))
    words = F.array_distinct(F.transform(inside, lambda c: c["word"]))
    return stretch.select((F.col("s.b") - F.col("s.a")).alias("n"), words.alias("words")).filter(F.size("words") > 0), total


def probabilities(docs: DataFrame, topics: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """p(word) and p(wi, wj) over windows, for words and pairs of the topics (pairs unordered: wi < wj)."""
    wins, total = windowed(docs, topics, width)
    wins = table(wins.groupBy(F.array_sort("words").alias("words")).agg(F.sum("n").alias("n")), "windows")  # sets of topic words: few, read twice
    share = (F.col("c") / F.col("n")).alias("p")
    single = wins.select("n", F.explode("words").alias("word")).groupBy("word").agg(F.sum("n").alias("c")).crossJoin(F.broadcast(total)).select("word", share)
    pairs = word_pairs(topics).select(F.least("wi", "wj").alias("a"), F.greatest("wi", "wj").alias("b")).distinct()
    met = wins.filter(F.size("words") > 1).select("n", "words", F.explode("words").alias("a")).select("n", "a", F.explode("words").alias("b")).filter("a < b")
    met = met.groupBy("a", "b").agg(F.sum("n").alias("c")).crossJoin(F.broadcast(total))
    joint = pairs.join(met, ["a", "b"], "left").select("a", "b", F.coalesce(share, F.lit(0.0)).alias("p"))
    return single, joint


def _pair_scores(docs: DataFrame, topics: DataFrame, width: int) -> DataFrame:
    topics = table(topics, "topics")
    single, joint = probabilities(docs, topics, width)
    pairs = word_pairs(topics).withColumn("a", F.least("wi", "wj")).withColumn("b", F.greatest("wi", "wj"))
    met = pairs.join(joint, ["a", "b"]).join(single.select(F.col("word").alias("wi"), F.col("p").alias("pi")), "wi").join(single.select(F.col("word").alias("wj"), F.col("p").alias("pj")), "wj")
    pmi = F.log((F.col("p") + EPS) / (F.col("pi") * F.col("pj")))
    return met.select("topic_id", "wi", "wj", pmi.alias("pmi"), (pmi / -F.log(F.col("p") + EPS)).alias("npmi"))


def _mean_of_topics(pairs: DataFrame, score: str, name: str) -> DataFrame:
    return pairs.groupBy("topic_id").agg(F.avg(score).alias("s")).agg(F.avg("s").alias(name))


def npmi(docs: DataFrame, topics: DataFrame, width: int = 10) -> DataFrame:
    return _mean_of_topics(_pair_scores(docs, topics, width), "npmi", "npmi")


def uci(docs: DataFrame, topics: DataFrame, width: int = 10) -> DataFrame:
    return _mean_of_topics(_pair_scores(docs, topics, width), "pmi", "uci")


def umass(docs: DataFrame, topics: DataFrame) -> DataFrame:
    """Mean of ln((D(wi, wj) + eps) / D(wj)) over pairs, wi ranked after wj, then over topics."""
    topics = table(topics, "topics")
    held = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("word")).join(topics.select("word").distinct(), "word", "left_semi")
    single = held.groupBy("word").agg(F.count(F.lit(1)).alias("d"))
    sets = held.groupBy("doc_id").agg(F.collect_set("word").alias("ws"))
    met = sets.select("ws", F.explode("ws").alias("wi")).select("wi", F.explode("ws").alias("wj")).groupBy("wi", "wj").agg(F.count(F.lit(1)).alias("c"))
    pairs = word_pairs(topics).join(met, ["wi", "wj"], "left").join(single.withColumnRenamed("word", "wj"), "wj")
    return _mean_of_topics(pairs.withColumn("s", F.log((F.coalesce("c", F.lit(0)) + EPS) / F.col("d"))), "s", "umass")


def c_v(docs: DataFrame, topics: DataFrame, width: int = 110) -> DataFrame:
    """Per topic word the NPMI vector over all topic words; mean cosine to the topic's summed vector."""
    topics = table(topics, "topics")
    single, joint = probabilities(docs, topics, width)
    both = joint.select("a", "b", "p").unionByName(joint.select(F.col("b").alias("a"), F.col("a").alias("b"), "p")).unionByName(single.select(F.col("word").alias("a"), F.col("word").alias("b"), "p"))
    mine, other = topics.select("topic_id", F.col("word").alias("a")), topics.select("topic_id", F.col("word").alias("b"))
    met = mine.join(other, "topic_id").join(both, ["a", "b"])
    met = met.join(single.select(F.col("word").alias("a"), F.col("p").alias("pa")), "a").join(single.select(F.col("word").alias("b"), F.col("p").alias("pb")), "b")
    pmi = F.log((F.col("p") + EPS) / (F.col("pa") * F.col("pb")))
    cells = met.select("topic_id", "a", "b", (pmi / -F.log(F.col("p") + EPS)).alias("v"))
    total = cells.groupBy("topic_id", "b").agg(F.sum("v").alias("s"))
    norms = total.groupBy("topic_id").agg(F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("ns"))
    word = cells.join(total, ["topic_id", "b"]).groupBy("topic_id", "a").agg(F.sum(F.col("v") * F.col("s")).alias("dot"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("nv"))
    scored = word.join(norms, "topic_id").withColumn("c", F.when((F.col("nv") == 0) | (F.col("ns") == 0), 0.0).otherwise(F.col("dot") / (F.col("nv") * F.col("ns"))))
    return _mean_of_topics(scored, "c", "c_v")


def irbo(topics: DataFrame, p: float = 0.9) -> DataFrame:
    """1 - mean rank-biased overlap (extrapolated) of topic pairs, to the depth of the shortest topic."""
    k = effective_k(topics, 1 << 30)
    t = topics.filter(F.col("rank") <= k)
    a, b = (t.select(F.col("topic_id").alias(f"t{s}"), F.col("rank").alias(f"r{s}"), "word") for s in "ab")
    ids = t.select("topic_id").distinct()
    pairs = ids.select(F.col("topic_id").alias("ta")).join(ids.select(F.col("topic_id").alias("tb")), F.col("ta") < F.col("tb"))
    common = a.join(b, "word").filter("ta < tb").select("ta", "tb", F.greatest("ra", "rb").alias("depth"))
    # A word that both have by depth m adds to every overlap X_d with d >= m.
    tail = F.aggregate(F.sequence(F.col("depth"), F.lit(k)), F.lit(0.0), lambda s, d: s + F.pow(F.lit(p), d) / d)
    gain = F.lit((1 - p) / p) * tail + F.lit(p**k / k if k else 0.0)
    rbo = common.groupBy("ta", "tb").agg(F.sum(gain).alias("rbo"))
    return pairs.join(rbo, ["ta", "tb"], "left").agg((1 - F.avg(F.coalesce("rbo", F.lit(0.0)))).alias("irbo"))


def contingency(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    return rows.groupBy(F.col(cluster).alias("cluster"), F.col(label).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("n"))


def nmi(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """Mutual information over the arithmetic mean of the entropies; 1 if both are 0."""
    c = contingency(rows, cluster, label)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(0))
    c = c.withColumn("t", F.sum("n").over(every)).withColumn("a", F.sum("n").over(Window.partitionBy("cluster"))).withColumn("b", F.sum("n").over(Window.partitionBy("label")))
    entropy = lambda m: -F.sum(F.col("n") / F.col("t") * F.log(F.col(m) / F.col("t")))  # noqa: E731  each cell's share of its margin
    s = c.agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("a") * F.col("b")))).alias("i"), entropy("a").alias("h"), entropy("b").alias("g"))
    return s.select(F.when(F.col("h") + F.col("g") == 0, F.lit(1.0)).otherwise(2 * F.col("i") / (F.col("h") + F.col("g"))).alias("nmi"))


def purity(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    c = contingency(rows, cluster, label).groupBy("cluster").agg(F.max("n").alias("m"), F.sum("n").alias("s"))
    return c.agg((F.sum("m") / F.sum("s")).alias("purity"))


def ari(rows: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    two = lambda x: x * (x - 1) / 2
    c = contingency(rows, cluster, label)
    s = c.agg(F.sum(two(F.col("n"))).alias("s"), F.sum("n").alias("n"))
    a = c.groupBy("cluster").agg(F.sum("n").alias("x")).agg(F.sum(two(F.col("x"))).alias("a"))
    b = c.groupBy("label").agg(F.sum("n").alias("x")).agg(F.sum(two(F.col("x"))).alias("b"))
    m = s.crossJoin(a).crossJoin(b).withColumn("e", F.col("a") * F.col("b") / two(F.col("n")))
    top = (F.col("a") + F.col("b")) / 2
    return m.select(F.when(top == F.col("e"), F.lit(1.0)).otherwise((F.col("s") - F.col("e")) / (top - F.col("e"))).alias("ari"))


def with_outliers(rows: DataFrame, cluster: str = "cluster", rule: str = "drop") -> DataFrame:
    """Negative clusters dropped, or made one more cluster after the last."""
    if rule == "drop":
        return rows.filter(F.col(cluster) >= 0)
    top = rows.agg((F.max(cluster) + 1).alias("_extra"))
    return rows.crossJoin(F.broadcast(top)).withColumn(cluster, F.when(F.col(cluster) < 0, F.col("_extra")).otherwise(F.col(cluster))).drop("_extra")


def compact_ids(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Cluster ids mapped, in order, to 0, 1, 2, ...; the few ids are ranked, not the rows."""
    ids = rows.select(cluster).distinct().withColumn("compact", F.dense_rank().over(Window.orderBy(cluster)) - 1)
    return rows.join(ids, cluster)


def semantic_coherence(words: DataFrame) -> DataFrame:
    """``coherence``: mean pairwise cosine per topic (topic_id, rank, embedding), then over topics of two words and more."""
    a, b = words.select("topic_id", F.col("rank").alias("ri"), F.col("embedding").alias("x")), words.select("topic_id", F.col("rank").alias("rj"), F.col("embedding").alias("y"))
    sims = a.join(b, "topic_id").filter("ri < rj").select("topic_id", cosine(F.col("x"), F.col("y")).alias("s"))
    return sims.groupBy("topic_id").agg(F.avg("s").alias("s")).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("coherence"))


def alignment(rows: DataFrame, topics: DataFrame, cluster: str = "cluster", label: str = "label") -> DataFrame:
    """``topic_id, label, percent, n``: each topic's most frequent class (ties to the least), "(empty)" for none."""
    c = contingency(rows, cluster, label).withColumn("label", F.col("label").cast("string"))
    best = c.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("o"), "label")).alias("b"), F.sum("n").alias("s"))
    met = topics.select("topic_id").join(best, F.col("topic_id") == F.col("cluster"), "left")
    return met.select("topic_id", F.coalesce("b.label", F.lit("(empty)")).alias("label"), F.coalesce(-F.col("b.o") * 100 / F.col("s"), F.lit(0.0)).alias("percent"), F.coalesce("s", F.lit(0.0)).cast("long").alias("n"))


def confusion(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    return rows.groupBy(F.col(label).alias("label"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_f1(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    """``label, precision, recall, f1, support`` per class of the labels; 0 where undefined."""
    c = confusion(rows, label, pred)
    hit = c.filter("label = pred").select("label", F.col("n").alias("tp"))
    true = c.groupBy("label").agg(F.sum("n").alias("support"))
    said = c.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("said"))
    m = true.join(hit, "label", "left").join(said, "label", "left").withColumn("tp", F.coalesce("tp", F.lit(0))).withColumn("said", F.coalesce("said", F.lit(0)))
    ratio = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(a / b)
    return m.select("label", ratio(F.col("tp"), F.col("said")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("said") + F.col("support")).alias("f1"), "support")


def accuracy_and_macro_f1(rows: DataFrame, label: str = "label", pred: str = "pred") -> DataFrame:
    f = class_f1(rows, label, pred).agg(F.avg("f1").alias("macro_f1"))
    return rows.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy")).crossJoin(f)


def svm_f1(train: DataFrame, test: DataFrame, features: str = "probs", label: str = "label") -> float:
    """Micro F1 (accuracy) of a linear SVM, one against the rest, fitted on ``train``; ``label`` counts from 0."""
    as_ml = lambda d: d.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"))
    model = OneVsRest(classifier=LinearSVC(maxIter=50)).fit(as_ml(train))
    return model.transform(as_ml(test)).agg(F.avg((F.col("label") == F.col("prediction")).cast("double"))).first()[0]


def corpus_stats(docs: DataFrame, label: Column) -> DataFrame:
    """``label, docs, mean_chars``."""
    return docs.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("docs"), F.avg(F.length("text")).alias("mean_chars"))


def words_in_set(topics: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """``topic_id, found``: a topic's words that are in a given set, in order; [] for none."""
    held = F.array(*[F.lit(w) for w in wanted])
    hits = F.array_sort(F.collect_list(F.when(F.array_contains(held, F.col("word")), F.struct("rank", "word"))))
    return topics.groupBy("topic_id").agg(F.transform(hits, lambda x: x["word"]).alias("found"))


def indexed_f1(train: DataFrame, test: DataFrame) -> float:
    """``svm_f1`` for labels of any kind; a label that ``train`` lacks is never hit."""
    index = StringIndexer(inputCol="name", outputCol="y", handleInvalid="keep").fit(named := train.withColumn("name", F.col("label").cast("string")))
    return svm_f1(index.transform(named), index.transform(test.withColumn("name", F.col("label").cast("string"))), label="y")


def compute_metrics(docs: DataFrame, topics: DataFrame, clusters: DataFrame | None = None, topk: int = 10, train: DataFrame | None = None, test: DataFrame | None = None) -> dict[str, float]:
    """All metrics by name, to four digits; NaN where there is nothing to measure or the measure fails.

    ``docs`` (doc_id, tokens), ``topics`` (topic_id, rank, word), ``clusters`` (cluster, label), ``train`` and
    ``test`` (probs, label). NMI and purity ask for as many labels as clusters, F1 for both splits.
    """
    names = ("CV", "NPMI", "UCI", "UMass", "TD", "IRBO", "NMI", "Purity", "F1")
    out = dict.fromkeys(names, math.nan)
    cut = clean_topics(topics, topk)
    k = effective_k(cut, topk)
    if k >= 2:
        cut = cut.filter(F.col("rank") <= k).persist()
        plans = {"CV": c_v(docs, cut), "NPMI": npmi(docs, cut), "UCI": uci(docs, cut), "UMass": umass(docs, cut), "TD": topic_diversity(cut), "IRBO": irbo(cut)}
        measures = {name: (lambda plan=plan: plan.first()[0]) for name, plan in plans.items()}
        if clusters is not None:
            n_clusters, n_labels = clusters.agg(F.count("cluster"), F.count("label")).first()
            if n_clusters == n_labels > 0:
                measures |= {"NMI": lambda: nmi(clusters).first()[0], "Purity": lambda: purity(clusters).first()[0]}
        if train is not None and test is not None:
            measures["F1"] = lambda: indexed_f1(train, test)
        for name, measure in measures.items():
            try:
                got = measure()
            except Exception as e:  # noqa: BLE001  one measure that fails leaves the others
                logging.getLogger(__name__).warning("%s failed: %s", name, e)
                got = None
            out[name] = math.nan if got is None else round(got, 4)
    return out


def results_to_table(results: dict[str, dict[str, dict[str, float]]], metrics: tuple[str, ...] = ("CV", "NPMI", "TD", "IRBO", "NMI", "Purity")) -> str:
    """Dataset -> model -> metrics as text: four digits, NaN as such, FAIL for a model without results."""
    fmt = lambda x: "NaN" if x is None or math.isnan(x) else f"{x:.4f}"
    lines = [" | ".join(["dataset", "model", *metrics])]
    for data, models in results.items():
        for model, got in models.items():
            lines.append(" | ".join([data, model, *(["FAIL"] * len(metrics) if got is None else [fmt(got.get(m)) for m in metrics])]))
    return "\n".join(lines)
