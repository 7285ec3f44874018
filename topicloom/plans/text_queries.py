"""Queries over raw texts: vocabularies, chunks, keyphrases, anchors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import anchors, chunk, keyphrase, sample, vocab
from ..operators.embed import HashEmbedder


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _rank(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 6))


def build_vocabulary(s, d):  # noqa: ANN001, ANN201
    return vocab.build_vocabulary(_docs(s, d))


def content_words(s, d):  # noqa: ANN001, ANN201
    return vocab.content_words(_docs(s, d))


def ngram_counts(s, d):  # noqa: ANN001, ANN201
    tokens = T.without(T.default_tokens(F.col("text")), T.ENGLISH)
    grams = _docs(s, d).select("doc_id", tokens.alias("t")).select(F.explode(T.ngrams(F.col("t"), 1, 2)).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def clean_text(s, d):  # noqa: ANN001, ANN201
    return _docs(s, d).select("doc_id", T.clean_text(F.col("text")).alias("text"))


def contractions(s, d):  # noqa: ANN001, ANN201
    return _docs(s, d).select("doc_id", F.md5(T.no_contractions(F.col("text"))).alias("text_md5"))


def bad_tokens(s, d):  # noqa: ANN001, ANN201
    every = _docs(s, d).select(F.explode(T.content_tokens(F.col("text"))).alias("word")).distinct()
    return every.filter(T.bad_token(F.col("word")))


def sentences(s, d):  # noqa: ANN001, ANN201
    return _docs(s, d).select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("p", "sentence")).select("doc_id", F.col("p").cast("long").alias("pos"), "sentence")


def paragraph_group(s, d):  # noqa: ANN001, ANN201
    return chunk.DocumentBuilder("paragraph_group").build(_docs(s, d))


def paragraph_group_lines(s, d):  # noqa: ANN001, ANN201
    return chunk.DocumentBuilder("paragraph_group", delimiter="\n").build(_docs(s, d))


def fixed_window(s, d):  # noqa: ANN001, ANN201
    return chunk.DocumentBuilder("fixed_window").build(_docs(s, d))


def post_group(s, d):  # noqa: ANN001, ANN201
    return chunk.DocumentBuilder("post_group").build(s.read.parquet(f"{d}/conversations.parquet"), order=("conv_id", "turn"))


def rake_phrases(s, d):  # noqa: ANN001, ANN201
    return _rank(keyphrase.rake(_docs(s, d)))


def tfidf_phrases(s, d):  # noqa: ANN001, ANN201
    return _rank(keyphrase.tfidf(_docs(s, d)))


def embed_keyphrases(s, d):  # noqa: ANN001, ANN201
    return _rank(keyphrase.keybert(_docs(s, d)))


def yake_term_stats(s, d):  # noqa: ANN001, ANN201
    return keyphrase.yake_terms(_docs(s, d))


def yake_phrases(s, d):  # noqa: ANN001, ANN201
    return _rank(keyphrase.yake(_docs(s, d)))


def gsc_candidates(s, d):  # noqa: ANN001, ANN201
    return keyphrase.gsc_candidates(_docs(s, d)).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "phrase"))), lambda x: x["phrase"]), "|")).alias("phrases_md5"))


def gsc_phrases(s, d):  # noqa: ANN001, ANN201
    return _rank(keyphrase.gsc(_docs(s, d)))


def phrase_doc_freq(s, d):  # noqa: ANN001, ANN201
    return anchors.phrase_doc_freq(keyphrase.rake(_docs(s, d)))


def anchor_pool(s, d):  # noqa: ANN001, ANN201
    docs = _docs(s, d)
    return anchors.anchor_pool(keyphrase.rake(docs), docs.count())


def hash_embed(s, d):  # noqa: ANN001, ANN201
    out = HashEmbedder().encode(_docs(s, d), "doc_id", "text")
    return out.select("doc_id", F.posexplode("embedding").alias("p", "v")).select("doc_id", F.col("p").cast("long").alias("dim"), F.round("v", 6).alias("v")).filter("v <> 0")


def preprocess(s, d):  # noqa: ANN001, ANN201
    return sample.preprocess(_docs(s, d)).select("doc_id", F.size("tokens").cast("long").alias("n"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"))


QUERIES = {
    f.__name__: f
    for f in (build_vocabulary, content_words, ngram_counts, clean_text, contractions, bad_tokens, sentences, paragraph_group, paragraph_group_lines, fixed_window, post_group)
    + (rake_phrases, tfidf_phrases, embed_keyphrases, yake_term_stats, yake_phrases, gsc_candidates, gsc_phrases, phrase_doc_freq, anchor_pool, hash_embed, preprocess)
}


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_W = r"[\p{L}\p{N}\p{M}_]"
#: Words of n word characters and more: the text between other characters.
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}\p{M}_]+'), lambda x: length(x) >= 2)"
_STOP = f"list_filter({_TOKENS}, lambda x: NOT list_contains({_list(T.ENGLISH)}, x))"
_STRIP = r"regexp_replace(regexp_replace({}, '^\s+', ''), '\s+$', '')"
_CLEAN = rf"len(list_filter(string_split(phrase, ' '), lambda w: regexp_full_match(w, '\p{{L}}{{2,}}') AND NOT list_contains({_list(T.PHRASE_STOPS)}, w))) > 0"


def _chunks(pieces: str, k: int = 5) -> str:
    return f"""WITH p AS ({pieces}), r AS (SELECT *, row_number() OVER (ORDER BY k0, k1, pos) - 1 AS rn FROM p)
        SELECT rn // {k} AS chunk_id, string_agg(piece, ' ' ORDER BY rn) AS text FROM r GROUP BY 1"""


def _split(pattern: str) -> str:
    return f"""SELECT * FROM (SELECT k0, k1, pos, {_STRIP.format("raw")} AS piece FROM (
        SELECT doc_id AS k0, 0 AS k1, unnest(range(len(xs))) AS pos, unnest(xs) AS raw FROM (SELECT doc_id, {pattern} AS xs FROM documents))) WHERE piece <> ''"""


_SENT = r"string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
_NGRAMS = f"""t AS (SELECT doc_id, {_STOP} AS t FROM documents),
        g AS (SELECT doc_id, unnest(t) AS phrase FROM t UNION ALL
              SELECT doc_id, unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: t[i] || ' ' || t[i + 1])) FROM t)"""
_RAKE = rf"""s AS (SELECT doc_id, unnest(range(len(xs))) AS sp, unnest(xs) AS part FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[.!?,;:\n]') AS xs FROM documents)),
        m AS (SELECT doc_id, sp, array_to_string(list_transform(regexp_extract_all(part, '{_W}+|[^\p{{L}}\p{{N}}\p{{M}}_]+'),
                     lambda x: CASE WHEN list_contains({_list(T.PHRASE_STOPS)}, x) THEN chr(1) ELSE x END), '') AS part FROM s),
        c AS (SELECT doc_id, sp, unnest(range(len(xs))) AS cp, unnest(xs) AS part FROM (SELECT doc_id, sp, string_split(part, chr(1)) AS xs FROM m)),
        run AS (SELECT * FROM (SELECT doc_id, sp, cp, list_filter(regexp_split_to_array(part, '[\s!-/:-@\[-`{{-~]+'), lambda w: regexp_full_match(w, '\p{{L}}{{2,}}')) AS ws FROM c) WHERE len(ws) BETWEEN 1 AND 3),
        w AS (SELECT doc_id, word, sum(k)::DOUBLE / count(*) AS w FROM (SELECT doc_id, unnest(ws) AS word, len(ws) AS k FROM run) GROUP BY 1, 2),
        f AS (SELECT doc_id, array_to_string(ws, ' ') AS phrase, min((sp, cp)) AS pos FROM run GROUP BY 1, 2),
        sc AS (SELECT f.doc_id, phrase, pos, sum(w.w) AS score FROM (SELECT *, unnest(string_split(phrase, ' ')) AS word FROM f) f JOIN w USING (doc_id, word) GROUP BY 1, 2, 3),
        rake AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS rank, phrase, round(score, 6) AS score FROM sc WHERE {_CLEAN} QUALIFY rank <= 10)"""
_DIM = "('0x' || substr(md5(w), 1, 8))::BIGINT % 64"
_SIGN = "CASE WHEN ('0x' || substr(md5(w), 9, 1))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END"
_HASH = f"""hw AS (SELECT doc_id AS k, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS w FROM documents),
        hs AS (SELECT k, {_DIM} AS b, sum({_SIGN})::DOUBLE AS s FROM hw WHERE w <> '' GROUP BY 1, 2),
        hn AS (SELECT k, sqrt(sum(s * s)) AS n FROM hs GROUP BY 1),
        hd AS (SELECT hs.k, b, s / n AS v FROM hs JOIN hn USING (k) WHERE n > 0)"""

ORACLE = {
    "build_vocabulary": r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY 1 HAVING count(*) >= 3",
    "content_words": rf"""WITH w AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}'))) AS word FROM documents)
        SELECT word, count(*) AS df FROM w WHERE NOT list_contains({_list(T.WORD_STOPS)}, word) AND length(word) < 26
            AND NOT regexp_matches(word, '{"|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")}')
        GROUP BY 1 HAVING count(*) BETWEEN least(3, (SELECT count(*) FROM documents)) AND 0.98 * (SELECT count(*) FROM documents)""",
    "ngram_counts": f"WITH {_NGRAMS} SELECT phrase AS gram, count(*) AS n FROM g WHERE phrase IS NOT NULL GROUP BY 1",
    "contractions": r"SELECT doc_id, md5(lower(replace(regexp_replace(text, '(?i)''(?:t|s|re|ve|ll|d|m)\b', '', 'g'), '''', ''))) AS text_md5 FROM documents",
    "bad_tokens": rf"""WITH w AS (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{4,}}'))) AS word FROM documents)
        SELECT word FROM w WHERE length(word) >= 26 OR regexp_matches(word, '{"|".join(c * 3 for c in "abcdefghijklmnopqrstuvwxyz")}')""",
    "sentences": rf"""WITH p AS (SELECT doc_id, text, list_filter(list_transform({_SENT}, lambda x: {_STRIP.format("x")}), lambda x: length(x) > 15) AS xs FROM documents),
        q AS (SELECT doc_id, CASE WHEN len(xs) > 0 THEN xs ELSE [text] END AS xs FROM p)
        SELECT doc_id, unnest(range(len(xs))) AS pos, unnest(xs) AS sentence FROM q""",
    "paragraph_group": _chunks(_split("string_split(text, chr(10) || chr(10))")),
    "paragraph_group_lines": _chunks(_split("string_split(text, chr(10))")),
    "fixed_window": _chunks(_split(_SENT)),
    "post_group": _chunks("SELECT conv_id AS k0, turn AS k1, 0 AS pos, coalesce(text, '') AS piece FROM conversations"),
    "rake_phrases": f"WITH {_RAKE} SELECT doc_id, rank, phrase, score FROM rake",
    "gsc_candidates": rf"""WITH m AS (SELECT doc_id, string_split(array_to_string(list_transform(regexp_extract_all(lower(text), '{_W}+|[^\p{{L}}\p{{N}}\p{{M}}_]+'),
            lambda x: CASE WHEN list_contains({_list(T.PHRASE_STOPS)}, x) THEN chr(1) ELSE x END), ''), chr(1)) AS xs FROM documents),
        r AS (SELECT doc_id, unnest(range(len(xs))) AS k, unnest(xs) AS part FROM m),
        w AS (SELECT doc_id, k, regexp_extract_all(part, '[a-z]{{2,}}') AS ws FROM r),
        g AS (SELECT doc_id, k, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n) WHERE len(ws) >= n),
        p AS (SELECT doc_id, array_to_string(ws[i:i + n - 1], ' ') AS phrase, min((k, n, i)) AS pos FROM g GROUP BY 1, 2)
        SELECT doc_id, count(*) AS n, md5(string_agg(phrase, '|' ORDER BY pos)) AS phrases_md5 FROM p WHERE {_CLEAN} GROUP BY 1""",
    "phrase_doc_freq": f"WITH {_RAKE} SELECT phrase, count(DISTINCT doc_id) AS df FROM rake GROUP BY 1",
    "anchor_pool": f"""WITH {_RAKE}, df AS (SELECT phrase, count(DISTINCT doc_id) AS df FROM rake GROUP BY 1)
        SELECT phrase, df, row_number() OVER (ORDER BY df DESC, phrase) AS rank FROM df WHERE df BETWEEN 2 AND floor(0.4 * (SELECT count(*) FROM documents))""",
    "tfidf_phrases": f"""WITH {_NGRAMS}, n AS (SELECT count(*)::DOUBLE AS n FROM documents),
        tf AS (SELECT doc_id, phrase, count(*) AS c FROM g WHERE phrase IS NOT NULL GROUP BY 1, 2),
        df AS (SELECT phrase, count(*) AS df FROM tf, n GROUP BY phrase, n HAVING count(*) BETWEEN least(2, n) AND CASE WHEN n >= 20 THEN 0.95 ELSE 1.0 END * n),
        w AS (SELECT doc_id, phrase, (1 + ln(c)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df USING (phrase), n),
        v AS (SELECT doc_id, phrase, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS score FROM w)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase DESC) AS rank, phrase, round(score, 6) AS score FROM v WHERE {_CLEAN} QUALIFY rank <= 10""",
    "hash_embed": f"WITH {_HASH} SELECT k AS doc_id, b AS dim, round(v, 6) AS v FROM hd WHERE round(v, 6) <> 0",
    "embed_keyphrases": f"""WITH {_HASH}, {_NGRAMS}, c AS (SELECT DISTINCT doc_id, phrase FROM g WHERE phrase IS NOT NULL AND {_CLEAN}),
        pw AS (SELECT phrase, unnest(regexp_split_to_array(phrase, '[^a-z]+')) AS w FROM (SELECT DISTINCT phrase FROM c)),
        ps AS (SELECT phrase, {_DIM} AS b, sum({_SIGN})::DOUBLE AS s FROM pw WHERE w <> '' GROUP BY 1, 2),
        pn AS (SELECT phrase, sqrt(sum(s * s)) AS n FROM ps GROUP BY 1),
        dots AS (SELECT c.doc_id, c.phrase, sum(ps.s / nullif(n, 0) * v) AS s FROM c JOIN ps USING (phrase) JOIN pn USING (phrase) JOIN hd ON hd.k = c.doc_id AND hd.b = ps.b GROUP BY 1, 2),
        v AS (SELECT doc_id, phrase, coalesce(s, 0.0) AS score FROM c LEFT JOIN dots USING (doc_id, phrase))
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, phrase) AS rank, phrase, round(score, 6) AS score FROM v QUALIFY rank <= 10""",
    "yake_term_stats": rf"""WITH x AS (SELECT doc_id, regexp_split_to_array(lower(replace(regexp_replace(text, '(?i)''(?:t|s|re|ve|ll|d|m)\b', '', 'g'), '''', '')), '[.!?\n]+') AS xs FROM documents),
        s AS (SELECT doc_id, unnest(range(len(xs))) AS sent, unnest(xs) AS part FROM x),
        t AS (SELECT doc_id, sent, unnest(range(len(ts))) AS pos, unnest(ts) AS term FROM (SELECT doc_id, sent, regexp_extract_all(part, '[\p{{L}}\p{{N}}]+') AS ts FROM s)),
        n AS (SELECT *, lag(term) OVER w AS l, lead(term) OVER w AS r FROM t WINDOW w AS (PARTITION BY doc_id, sent ORDER BY pos))
        SELECT doc_id, term, count(*) AS tf, count(DISTINCT sent) AS sents, count(l) AS n_left, count(DISTINCT l) AS left_kinds, count(r) AS n_right, count(DISTINCT r) AS right_kinds, min(sent) AS first_sent
        FROM n GROUP BY 1, 2""",
    "preprocess": rf"""WITH w AS (SELECT doc_id, unnest(range(len(ts))) AS pos, unnest(ts) AS word FROM (
            SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: length(x) >= 3 AND NOT list_contains({_list(T.ENGLISH)}, x)) AS ts FROM documents)),
        df AS (SELECT word, count(DISTINCT doc_id) AS df FROM w GROUP BY 1 HAVING df BETWEEN 5 AND 0.85 * (SELECT count(*) FROM documents))
        SELECT doc_id, count(*) AS n, md5(string_agg(word, ' ' ORDER BY pos)) AS tokens_md5 FROM w JOIN df USING (word) GROUP BY 1 HAVING count(*) >= 3""",
}
