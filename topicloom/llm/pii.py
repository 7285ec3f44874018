"""Personal data: pattern spans plus information-theoretic sanitisation, with Spark expressions only.

Emails, addresses, cards and phone numbers found by pattern are the protected entities. Over the whole
corpus, co-occurrence tells how strongly an ordinary term reveals one of them: the pointwise mutual
information PMI(t; c) = log2 p(t, c) / (p(t) p(c)), against all there is to reveal, IC(c) = -log2 p(c).
A term that gives away at least ``disclosure`` of an entity's information, with evidence that chance does
not produce, is marked in the documents that hold the entity and generalised with it.

All counts, of the pair, the entity, the term and the corpus, take each different text once, so copies of one
document neither add evidence nor hide it; an entity or pair needs ``min_docs`` different texts. Only terms that
pass on the joint side are counted over the corpus.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, settle, starts

#: In the order in which spans with one start are listed.
KINDS = ("email", "ip", "card", "phone", "term")
_DOMAIN = r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: Kind -> (cheap test of the whole text, pattern of tokens). Tokens hold every match of the kind's contract
#: and swallow the runs that cannot start one, so that each is found in one pass without backtracking.
PATTERNS = {
    "email": (r"@[A-Za-z0-9-]+\.[A-Za-z0-9-]", rf"[A-Za-z0-9._%+-]++(?:{_DOMAIN})?+"),
    "ip": (r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", r"[0-9]++(?:\.[0-9]++\.[0-9]++\.[0-9]++)?+"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){11}", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
TOKEN = r"[\p{L}\p{N}]+"


def luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    doubled = F.transform(
        at, lambda i: (F.substring(digits, F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1)))
    )
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def valid(kind: str, token: Column) -> Column:
    digits = F.regexp_replace(token, "[^0-9]", "")
    if kind == "email":
        return F.contains(token, F.lit("@"))
    if kind == "ip":
        part = lambda p: F.coalesce(F.regexp_replace(p, "^0+", ""), F.lit(""))
        return F.contains(token, F.lit(".")) & F.forall(
            F.split(token, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(0)) <= 255)
        )
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    return F.length(digits).between(9, 15)


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern, leftmost and without overlap: array of start, end (code points), value."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.greatest(F.size(found), F.lit(1)))
    both = F.when(F.size(found) > 0, F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), m.alias("m"))))
    both = F.coalesce(both, F.array().cast("array<struct<gap:bigint,m:string>>"))
    begin = starts(F.transform(both, lambda x: x["gap"] + F.length(x["m"])))
    return F.zip_with(
        both, begin, lambda x, s: F.struct((s + x["gap"]).alias("start"), (s + x["gap"] + F.length(x["m"])).alias("end"), x["m"].alias("value"))
    )


def passes(kind: str, x: Column) -> Column:
    return valid(kind, x["value"])


def ranked(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))


def base_spans(text: Column) -> Column:
    """The pattern spans of a text by start, then kind: array of start, kind (its rank), end, value."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    parts = []
    for k, kind in enumerate(PATTERNS):
        test, pattern = PATTERNS[kind]
        hits = ranked(F.filter(located(text, pattern), partial(passes, kind)), k)
        parts.append(F.when(F.rlike(text, F.lit(test)), hits).otherwise(none))
    return F.array_sort(F.flatten(F.array(*parts)))


def outside(text: Column, spans: Column) -> Column:
    """The text before, between and after sorted spans, cut by their places and joined by spaces; one pass of it."""
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,n:bigint>>").alias("gaps"))
    gap = lambda a, s: F.struct(a["at"].alias("start"), F.greatest(s["start"] - a["at"], F.lit(0)).alias("n"))
    cut = F.aggregate(spans, state, lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.concat(a["gaps"], F.array(gap(a, s))).alias("gaps")))
    part = lambda g: F.substring(text, (g["start"] + 1).cast("int"), g["n"].cast("int"))
    return let(cut, lambda c: F.concat_ws(" ", F.transform(c["gaps"], part), F.substring(text, (c["at"] + 1).cast("int"), F.lit(2**31 - 1))))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits; the first or last may be empty."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}]+")


def terms_of(text: Column, spans: Column) -> Column:
    """Distinct lower-case terms of three letters and more outside the spans."""
    words = F.array_distinct(words_of(F.when(F.size(spans) > 0, outside(text, spans)).otherwise(text)))
    return F.filter(words, lambda w: F.length(w) >= 3)


def entity(span: Column) -> Column:
    digits = F.regexp_replace(span["value"], "[^0-9]", "")
    value = F.when(span["kind"] == 0, F.lower(span["value"])).when(span["kind"] == 1, span["value"]).otherwise(digits)
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def revealing(found: DataFrame, docs: DataFrame, text: str, disclosure: float, min_docs: int, min_bits: float, broadcast_terms: int) -> DataFrame | None:
    """Pairs (entity, term) that disclose too much, of ``found`` (rid, digest, text, spans) and the whole corpus."""
    some = found.filter(F.size("spans") > 0)
    once = some.groupBy("digest").agg(F.min("rid").alias("rid"))
    some = some.join(once.select("rid"), "rid", "left_semi")
    held = some.select("rid", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
    n = found.select("digest").distinct().count()
    p = lambda c: F.col(c) / F.lit(float(n))
    # A pair has no more evidence than its entity would have alone, and its term may be this common at most.
    known = held.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c")).filter(F.col("n_c") >= min_docs).withColumn("ic", -F.log2(p("n_c")))
    known = known.withColumn("slack", F.pow(F.lit(2.0), F.col("ic") * (1 - disclosure)) * (1 + 1e-9))
    known = settle(known.filter(F.col("n_c") * F.col("ic") >= min_bits), "pii-entities")
    widest = known.agg(F.max(F.col("n_c") * F.col("slack"))).first()[0]
    if widest is None:
        return None
    held = held.join(known, "entity").select("rid", "entity", "n_c", "ic", "slack")
    words = some.select("rid", F.explode(terms_of(F.col("text"), F.col("spans"))).alias("term"))
    least = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_least")).filter(F.col("n_least").between(min_docs, widest))
    # A term is too common for a pair already if it is so among the documents that hold entities.
    close = (F.col("n_least") <= F.col("n_c") * F.col("slack")) & (F.col("n_least") * F.col("ic") >= min_bits)
    pairs = held.join(words.join(least, "term"), "rid").filter(close).groupBy("entity", "term")
    pairs = pairs.agg(F.count(F.lit(1)).alias("n_tc"), *[F.first(c).alias(c) for c in ("n_c", "ic", "slack", "n_least")])
    pairs = pairs.filter((F.col("n_tc") >= min_docs) & (F.col("n_tc") * F.col("ic") >= min_bits) & (F.col("n_least") <= F.col("n_tc") * F.col("slack")))
    pairs = settle(pairs.select("entity", "term", "n_tc", "n_c", "ic"), "pii-pairs")
    terms = pairs.select("term").distinct()
    n_terms = terms.count()
    if not n_terms:
        return None
    body = F.coalesce(F.col(text), F.lit(""))
    terms = F.broadcast(terms) if n_terms <= broadcast_terms else terms
    # No pattern runs again: all words of all texts are counted, and where texts have spans, what stands outside
    # them takes the place of the whole.
    met = lambda rows, words: rows.select("digest", F.explode(words).alias("term")).join(terms, "term", "left_semi").distinct()
    every = met(docs.select(F.xxhash64(body).alias("digest"), body.alias("text")), words_of(F.col("text"))).select("term", F.lit(1).alias("n"))
    whole = met(some, words_of(F.col("text"))).select("term", F.lit(-1).alias("n"))
    outer = met(some, terms_of(F.col("text"), F.col("spans"))).select("term", F.lit(1).alias("n"))
    df = every.unionByName(whole).unionByName(outer).groupBy("term").agg(F.sum("n").alias("n_t"))
    scored = pairs.join(df, "term").withColumn("pmi", F.log2(p("n_tc") / (p("n_t") * p("n_c"))))
    return settle(scored.filter(F.col("pmi") >= disclosure * F.col("ic")).select("entity", "term", "pmi", "ic"), "pii-revealing")


def sanitise(
    docs: DataFrame,
    text: str = "text",
    row_id: str = "doc_id",
    disclosure: float = 0.9,
    min_docs: int = 2,
    min_bits: float = 40.0,
    broadcast_terms: int = 100_000,
    rewrite: bool = False,
) -> DataFrame:
    """Per row ``<row_id>`` and ``spans``: array of start, kind (rank in KINDS), end, value; sorted.

    Offsets are code points, ends exclusive. Null text counts as empty and has no spans; repeated rows each
    get theirs; no rows in, no rows out; other columns are ignored. Terms are never taken out of pattern
    spans. With ``rewrite`` the column ``clean`` holds the text in which each entity is replaced by its kind
    in brackets and each revealing term by [term]; overlapping spans give one replacement, the first.
    Up to ``broadcast_terms`` terms are broadcast to be counted; more are joined by shuffle.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(row_id).alias("id"), F.xxhash64(body).alias("digest"), body.alias("text"), base_spans(body).alias("spans"))
    found = found.withColumn("text", F.when(F.lit(rewrite) | (F.size("spans") > 0), F.col("text")))
    found = settle(found, "pii-found")
    bad = revealing(found, docs, text, disclosure, min_docs, min_bits, broadcast_terms)
    if bad is not None:
        some = found.filter(F.size("spans") > 0)
        marked = (
            some.select("rid", F.explode(F.array_distinct(F.transform("spans", entity))).alias("entity"))
            .join(bad.groupBy("entity").agg(F.collect_set("term").alias("terms")), "entity")
            .groupBy("rid")
            .agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
        )
        apart = lambda x: ~F.exists("spans", lambda s: (x["start"] < s["end"]) & (s["start"] < x["end"]))
        extra = F.filter(located(F.col("text"), TOKEN), lambda x: F.array_contains("terms", F.lower(x["value"])) & apart(x))
        more = some.join(marked, "rid").select("rid", ranked(extra, 4).alias("extra"))
        found = found.join(more, "rid", "left").withColumn(
            "spans", F.when(F.col("extra").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "extra")))
        )
    out = found.select(F.col("id").alias(row_id), "spans", "text")
    if rewrite:
        names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
        state = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
        piece = lambda a, s: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.element_at(names, s["kind"] + 1))
        done = F.aggregate(
            "spans", state, lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(piece(a, s).alias("out"), s["end"].alias("at")))
        )
        out = out.withColumn("done", done).withColumn("clean", F.concat("done.out", F.substring(F.col("text"), (F.col("done.at") + 1).cast("int"), F.lit(2**31 - 1)))).drop("done")
    return out.drop("text")


def listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] < 4)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return out.select("doc_id", *[count(k) for k in range(4)], F.sha2(F.encode(listed(base), "UTF-8"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


ORACLE: dict[str, str] = {}
QUERIES = {"op7_pii": op7_pii}
