import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import anchors, baselines, metrics, mixture, model, project, sample
from topicloom.plans import topic_queries
from topicloom.sources import text as sources
from topicloom.streaming.score import score_stream


def vectors(spark, rows, name="rank"):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], f"{name} long, embedding array<double>")


def test_dedup_is_strict_and_greedy(spark):
    rows = [(1, (1, 0)), (2, (0.8, 0.6)), (3, (0, 1)), (4, (0.6, 0.8))]
    for fold in (0, 100):
        assert sorted(r["rank"] for r in anchors.greedy_dedup(vectors(spark, rows), 0.8, fold).collect()) == [1, 3]
    assert anchors.greedy_dedup(vectors(spark, rows), None).count() == 4


def test_dedup_compares_equal_vectors_once(spark, monkeypatch):
    rows = [(i, ((1, 0), (0, 0), (0.8, 0.6), (0, 1))[i % 4]) for i in range(400)]
    pairs, seen = anchors.near_pairs, []
    monkeypatch.setattr(anchors, "near_pairs", lambda r, *a: seen.append(r.count()) or pairs(r, *a))
    got = [sorted(r["rank"] for r in anchors.greedy_dedup(vectors(spark, rows), 0.8, fold).collect()) for fold in (0, 1000)]
    assert got[0] == got[1] == sorted([0, *range(1, 400, 4), 3]) and seen == [103]


def test_mmr_cap_single_and_softmax(spark):
    topics = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "topic_id int, centroid array<double>")
    words = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.8, 0.6])], "word string, embedding array<double>")
    got = [(r["topic_id"], r["word"]) for r in project.mmr_words(words, topics, 0.1, max_sim=0.8).orderBy("topic_id", "rank").collect()]
    assert got == [(0, "a"), (1, "b")]  # a similarity of exactly the cap is too much; one word alone stays
    probs = project.doc_topics(words.withColumnRenamed("word", "doc_id"), topics).groupBy("doc_id").agg(F.sum("prob").alias("s"), F.max("prob").alias("m")).collect()
    assert all(r["s"] == pytest.approx(1) and r["m"] <= math.e**2 / (math.e**2 + 2) for r in probs)


def test_mixture(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, 0.1, (60, 3)) for m in ([0, 0, 0], [3, 0, 0], [0, 3, 0])])
    rows = vectors(spark, enumerate(x), "k")
    m = mixture.GMMTopicClusterer(3)
    with pytest.raises(RuntimeError):
        _ = m.cluster_centers_
    m.fit(rows)
    assert m.is_fitted and sorted(np.abs(m.cluster_centers_).round(0).sum(axis=1).tolist()) == [0, 3, 3]
    assert m.predict_proba(rows, "k").groupBy("k").agg(F.sum("prob").alias("s")).filter("abs(s - 1) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        mixture.GMMTopicClusterer(500).fit(rows)


def test_metrics(spark):
    rows = spark.createDataFrame([(0, "a"), (0, "a"), (0, "b"), (1, "b")], "cluster int, label string")
    assert metrics.purity(rows).first()[0] == 0.75
    same = rows.withColumn("label", F.col("cluster").cast("string"))
    assert metrics.nmi(same).first()[0] == pytest.approx(1) and metrics.ari(same).first()[0] == pytest.approx(1)
    topics = spark.createDataFrame([("t", 1, "x"), ("t", 2, ""), ("t", 3, "y"), ("u", 1, "y"), ("u", 2, "x")], "topic_id string, rank int, word string")
    cut = metrics.clean_topics(topics)
    assert metrics.effective_k(cut) == 2 and metrics.topic_diversity(cut).first()[0] == 0.5
    docs = spark.createDataFrame([(1, ["x", "y"]), (2, ["x"]), (3, ["z"])], "doc_id long, tokens array<string>")
    got = metrics.compute_metrics(docs, topics, rows)
    assert got["Purity"] == 0.75 and got["UMass"] == pytest.approx((math.log(1 / 2) + math.log(1 / 1)) / 2, abs=1e-4)
    assert math.isnan(metrics.compute_metrics(docs, topics.limit(1))["CV"])
    assert math.isnan(got["F1"]) and math.isnan(metrics.compute_metrics(docs, topics, rows.withColumn("label", F.when(F.col("cluster") == 1, F.col("label"))))["NMI"])
    side = [([0.9, 0.1], "a"), ([0.8, 0.2], "a"), ([0.1, 0.9], "b"), ([0.2, 0.8], "b")]
    split = spark.createDataFrame(side, "probs array<double>, label string")
    odd = spark.createDataFrame([*side, ([0.5, 0.5], "new")], "probs array<double>, label string")
    assert metrics.compute_metrics(docs, topics, train=split, test=odd)["F1"] == 0.8
    assert "FAIL" in metrics.results_to_table({"d": {"m": None}})


@pytest.mark.parametrize("width", [1, 3, 10, 200])
def test_window_probabilities_by_brute_force(spark, width):
    rng = np.random.default_rng(width)
    texts = [[f"w{x}" for x in rng.integers(0, 12, n)] for n in (0, 1, 2, 9, 60, 150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, tokens array<string>")
    topics = spark.createDataFrame([(0, 1, "w0"), (0, 2, "w1"), (0, 3, "w2"), (1, 1, "w1"), (1, 2, "w9"), (1, 3, "never")], "topic_id int, rank int, word string")
    wins = [set(t[i : i + width]) for t in texts for i in range(max(1, len(t) - width + 1))]
    share = lambda *ws: sum(all(w in x for w in ws) for x in wins) / len(wins)
    single, joint = metrics.probabilities(docs, topics, width)
    assert {r["word"]: r["p"] for r in single.collect()} == pytest.approx({w: share(w) for w in ("w0", "w1", "w2", "w9")})
    pairs = [("w0", "w1"), ("w0", "w2"), ("w1", "w2"), ("w1", "w9"), ("never", "w1"), ("never", "w9")]
    assert {(r["a"], r["b"]): r["p"] for r in joint.collect()} == pytest.approx({p: share(*p) for p in pairs})


def test_samples(spark):
    rows = spark.createDataFrame([(i, f"c{i % 3}") for i in range(30)], "doc_id long, label string")
    assert sample.balanced_sample(rows, 2).count() == 3
    assert {r["n"] for r in sample.stratified_split(rows).filter("split = 'test'").groupBy("label").agg(F.count("*").alias("n")).collect()} == {2}


def test_lda_keeps_all_words(spark):
    rng = np.random.default_rng(1)
    tokens = [[f"{'ab'[i % 2]}{w}" for w in rng.integers(0, 3000, 400)] for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(tokens)), "doc_id long, tokens array<string>")
    got = baselines.lda_topics(docs, k=2, n_words=10_000, max_iter=20).collect()
    for t in (0, 1):
        mine = [(r["rank"], r["word"], r["weight"]) for r in got if r["topic_id"] == t]
        assert {w for _, w, _ in mine} == {w for ws in tokens for w in ws} and len(mine) > 5000  # the old bound
        assert sum(x for _, _, x in mine) == pytest.approx(1) and [n for n, _, _ in sorted(mine)] == list(range(1, len(mine) + 1))


def test_words_stay_in_their_documents(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{'ab'[i % 2]}x{'cdefghij'[w]}" for w in rng.integers(0, 8, 30)) for i in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (40, None), (41, "the 12"), (42, "axc axd")], "doc_id long, text string")
    tokens = sample.preprocess(docs)
    assert "Exchange" not in tokens._jdf.queryExecution().executedPlan().toString()
    got = {r["doc_id"]: r["tokens"] for r in tokens.collect()}
    assert got == {i: t.split() for i, t in enumerate(texts)}
    held = [{r["word"]: r["weight"] for r in baselines.lda_topics(tokens, k=2, n_words=99).collect() if r["topic_id"] == t} for t in (0, 1)]
    sides = sorted(round(sum(x for w, x in h.items() if w[0] == "a"), 2) for h in held)
    assert sides[0] < 0.05 and sides[1] > 0.95 and all(len(h) == 16 for h in held)


def test_svm_passes_serve_all_classes(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal([4.0 * (i % 5 == k) for k in range(5)], 0.5)] + [1.0], i % 5) for i in range(300)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    spark.sparkContext.setJobGroup("svm", "svm")
    got = baselines.linear_svm(v.filter("vec_id < 200"), v.filter("vec_id >= 200")).collect()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("svm"))
    spark.sparkContext._jsc.clearJobGroup()
    assert len(got) == 100 and sum(r["label"] == r["pred"] for r in got) >= 99 and jobs < 150


def test_nmf_converges_either_way(spark):
    rng = np.random.default_rng(2)
    x = (rng.random((12, 3)) * (rng.random((12, 3)) < 0.5)) @ (rng.random((3, 9)) * (rng.random((3, 9)) < 0.5))
    cells = [(i, f"p{j}", float(x[i, j])) for i in range(12) for j in range(9) if x[i, j] > 0]
    weights = spark.createDataFrame(cells, "doc_id long, phrase string, weight double")

    def product(**how):
        w, h = baselines.nmf(weights, k=3, **how)
        a, b = {r["doc_id"]: r["w"] for r in w.collect()}, {r["phrase"]: r["h"] for r in h.collect()}
        return np.array([[np.dot(a[i], b[f"p{j}"]) if i in a and f"p{j}" in b else 0.0 for j in range(9)] for i in range(12)])

    assert np.allclose(product(max_iter=4), product(max_iter=4, few=0), atol=1e-9)
    assert np.linalg.norm(product() - x) < 0.05 * np.linalg.norm(x)


def test_nmf_keeps_documents_in_blocks(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"{'ab'[i % 2]}x{'cdefghij'[w]}" for w in rng.integers(0, 8, 30)) for i in range(40)]
    rows = [(i, t, "test" if i % 8 == 7 else "train") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (40, None, "train"), (41, "the of", "test"), (3, "axc", "train"), (4, "bxc bxc", "val")], "doc_id long, text string, split string")
    weights = baselines.tfidf_features(docs)
    assert "Exchange" not in weights._jdf.queryExecution().executedPlan().toString()  # the phrases stay with their documents
    tf = {}
    for r in docs.collect():
        for t in (r["text"] or "").split():
            tf[r["doc_id"], r["split"], t] = tf.get((r["doc_id"], r["split"], t), 0) + 1
    n = docs.filter("split = 'train'").count()
    df = {t: sum(s == "train" and u == t for _, s, u in tf) for _, _, t in tf}
    raw = [(i, t, (1 + math.log(c)) * (math.log((1 + n) / (1 + df[t])) + 1)) for (i, _, t), c in tf.items() if 3 <= df[t] <= 0.95 * n]
    norm = {i: math.sqrt(sum(x * x for j, _, x in raw if j == i)) for i, _, _ in raw}
    want = sorted((i, t, x / norm[i]) for i, t, x in raw)
    got = sorted(tuple(r) for r in weights.collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-12)
    apart = spark.createDataFrame(got, "doc_id long, phrase string, weight double").repartition(5, "phrase")
    sides = [{r["phrase"]: r["h"] for r in baselines.nmf(x, k=2, few=few)[1].collect()} for x, few in ((weights, 0), (apart, 0), (apart, 10**6))]
    assert all(s.keys() == sides[0].keys() and np.allclose([s[p] for p in s], [sides[0][p] for p in s], atol=1e-6) for s in sides)
    assert len({(p[0], int(np.argmax(h))) for p, h in sides[0].items()}) == 2


def test_registered_baselines_run_in_full(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(baselines, "lda_topics", lambda docs, **how: seen.update(lda=how) or spark.createDataFrame([], "weight double"))
    monkeypatch.setattr(baselines, "tfidf_features", lambda docs, **how: seen.update(tfidf=how))
    monkeypatch.setattr(baselines, "nmf", lambda weights, **how: seen.update(nmf=how) or (None, None))
    monkeypatch.setattr(baselines, "component_words", lambda h: spark.createDataFrame([], "weight double"))
    for query in (topic_queries.lda_topics, topic_queries.nmf_topics):
        query(spark, "/root/testdata/sf0.001")
    assert seen == {"lda": {}, "tfidf": {}, "nmf": {}}


def test_sources(spark, tmp_path):
    (tmp_path / "b.txt").write_text("second\nline")
    (tmp_path / "a.txt").write_text("first")
    assert [(r["doc_id"], r["text"]) for r in sources.text_files(spark, f"file://{tmp_path}/*.txt").orderBy("doc_id").collect()] == [(0, "first"), (1, "second\nline")]
    (tmp_path / "p.csv").write_text('content,x\n"two\nlines",1\n,2\n')
    assert sources.csv_texts(spark, f"file://{tmp_path}/p.csv").count() == 1
    rows = spark.createDataFrame([(" t ", "['earn', 'other']"), ("u", "['earn', 'acq']"), ("v", None), (None, "['ship']"), ("w", "no list")], "text string, topics string")
    assert [tuple(r) for r in sources.one_category(rows).collect()] == [("t", "earn")]
    with pytest.raises(ValueError):
        sources.load_dataset(spark, "none", "")


def test_one_of_categories_as_its_sql(spark, tmp_path):
    import duckdb

    names = ("en", "fr", "EN", "de", "o'en", 'a"b', "src1", None, "")
    rows = [(t, a, b) for t in ("x", "", " \n", None) for a in names for b in (*names, "src2", "SRC1")]
    spark.createDataFrame(rows, "text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in topic_queries.one_of_categories(spark, f"file://{tmp_path}").collect())
    documents = duckdb.sql(f"SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")  # noqa: F841  named in the SQL
    assert got == sorted(duckdb.sql(topic_queries.ORACLE["one_of_categories"]).fetchall()) and len(got) == 4


def test_model_and_stream(spark, tmp_path):
    texts = [f"report on {w} rivers. report about {w} weather and {w} harvest season" for w in ("amber", "birch", "cedar", "dune", "ember") for _ in range(3)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = model.TopicModel(kp_algorithm="rake", n_topics=3, min_df=1, min_anchor_df=1, max_anchor_df_ratio=1.0, anchor_dedup_threshold=None, soft_threshold=0.05)
    with pytest.raises(RuntimeError):
        m.transform(docs)
    probs = m.fit_transform(docs)
    assert probs.count() == 45 and m.topics_.count() > 0 and sum(m.get_document_topics(0).values()) == pytest.approx(1)
    assert m.get_topic_words(99).count() == 0 and m.get_document_topics(-1) == {}
    m.save(spark, f"file://{tmp_path}/m")
    again = model.TopicModel.load(spark, f"file://{tmp_path}/m").transform(docs)
    assert probs.join(again.withColumnRenamed("prob", "q"), ["doc_id", "topic_id"]).filter("abs(prob - q) > 1e-9").count() == 0
    docs.write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(docs.schema).parquet(f"file://{tmp_path}/in")
    q = score_stream(stream, m.centroids(spark)).writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("scored").join(probs.withColumnRenamed("prob", "q"), ["doc_id", "topic_id"]).filter("abs(prob - q) < 1e-9").count() == 45
    assert m.fit(docs.limit(0)).topics_.count() == 0
