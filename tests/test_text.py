import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as T
from topicloom.operators import anchors, chunk, keyphrase, vocab


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_cleaning_and_tokens(spark):
    assert column(spark, ["a\nb", " x  y ", "a\u0000b", None, "ﬁ"], T.clean_text) == ["ab", "x y", "ab", None, "fi"]
    assert column(spark, ["don't IT's we'll", "'tis"], T.no_contractions) == ["don it we", "tis"]
    assert column(spark, ["Café solo word1 words"], T.content_tokens) == [["solo", "words"]]
    assert column(spark, ["aaab", "abab", "x" * 26], T.bad_token) == [True, False, True]
    assert column(spark, ["a b c"], lambda x: T.ngrams(F.split(x, " "), 1, 2)) == [["a", "b", "c", "a b", "b c"]]
    assert column(spark, ["Short. And this one is long enough! ok", "tiny"], T.sentences) == [["And this one is long enough!"], ["tiny"]]


@pytest.mark.parametrize(
    ("strategy", "size", "texts", "want"),
    [
        ("post_group", 2, ["a", "b", "c", "d", "e"], ["a b", "c d", "e"]),
        ("paragraph_group", 2, ["a\n\nb", "c"], ["a b", "c"]),
        ("post_group", 3, ["a", "", "b"], ["a  b"]),
        ("fixed_window", 1, ["One. Two!  Three", None], ["One.", "Two!", "Three"]),
        ("paragraph_group", 5, [], []),
    ],
)
def test_chunks(spark, strategy, size, texts, want):
    out = chunk.DocumentBuilder(strategy, size).build(docs(spark, *texts)) if texts else chunk.DocumentBuilder(strategy, size).build(docs(spark, "x").limit(0))
    assert [r["text"] for r in out.orderBy("chunk_id").collect()] == want


def test_chunk_arguments():
    with pytest.raises(ValueError):
        chunk.DocumentBuilder("nothing")
    with pytest.raises(ValueError):
        chunk.DocumentBuilder(chunk_size=0)


def test_vocabulary_counts_occurrences(spark):
    assert [tuple(r) for r in vocab.build_vocabulary(docs(spark, "x x x", "y y")).collect()] == [("x", 3)]
    assert vocab.content_words(docs(spark, "alpha beta", "alpha gamma")).count() == 0  # no room between bounds


def test_rake(spark):
    out = keyphrase.rake(docs(spark, "solar system and solar system, system.", "windows 95 users", "one two three four", "", None))
    got = [(r["doc_id"], r["phrase"], round(r["score"], 4)) for r in out.orderBy("doc_id", "rank").collect()]
    assert got == [(0, "solar system", 3.6667), (0, "system", 1.6667), (1, "windows users", 4.0)]


def test_anchor_band(spark):
    rows = [(d, p) for p, n in (("once", 1), ("twice", 2), ("often", 3)) for d in range(n)]
    phrases = spark.createDataFrame(rows, "doc_id long, phrase string")
    assert [(r["phrase"], r["rank"]) for r in anchors.anchor_pool(phrases, 5).collect()] == [("twice", 1)]
    assert anchors.anchor_pool(phrases, 4).count() == 0
    assert [r["phrase"] for r in anchors.anchor_pool(phrases, 5, max_ratio=None).orderBy("rank").collect()] == ["often", "twice"]


def test_all_algorithms_give_phrases(spark):
    five = docs(spark, *[f"The quick report number {w} describes {w} rivers and {w} mountains. Another report about {w} weather follows here." for w in ("alpha", "beta", "gamma", "delta", "omega")])
    for name in keyphrase.ALGORITHMS:
        out = keyphrase.KeyphraseExtractor(name, 5, tfidf_ngram_range=(1, 1)).extract(five)
        assert out.select("doc_id").distinct().count() == 5, name
    with pytest.raises(ValueError):
        keyphrase.KeyphraseExtractor("none")


def shuffled(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_yake_terms_stay_within_documents(spark):
    got = keyphrase.yake_terms(docs(spark, "Don't stop. It stops, it (it) stop!\n\nStop it", " ", None, "..."))
    assert not shuffled(got)
    rows = {r["term"]: tuple(r)[2:] for r in got.collect()}
    assert rows == {"don": (1, 1, 0, 0, 1, 1, 0), "stop": (3, 3, 2, 2, 1, 1, 0), "it": (4, 2, 3, 3, 3, 3, 1), "stops": (1, 1, 1, 1, 1, 1, 1)}


def test_yake_stays_within_documents(spark):
    got = keyphrase.yake(docs(spark, "Solar system, solar system; big planets. The solar system (old) system.", "", None))
    assert not shuffled(got)
    want = ["system", "solar", "solar system", "planets", "big", "old"]
    assert [(r["rank"], r["phrase"]) for r in got.collect()] == list(enumerate(want, 1))


def test_keybert_stays_within_documents(spark):
    got = keyphrase.keybert(docs(spark, "red café", "café red_fox 42 red"))
    assert not shuffled(got)
    twice = keyphrase.keybert(spark.createDataFrame([(1, "red café"), (1, "café red fox"), (2, "red café")], "doc_id long, text string")).collect()
    assert column(spark, ["", " \n\u2003", None, " a "], T.blank) == [True, True, True, False]
    assert len({(r["doc_id"], r["phrase"]) for r in twice}) == len(twice) == 9 and max(r["score"] for r in twice) <= 1 + 1e-9
