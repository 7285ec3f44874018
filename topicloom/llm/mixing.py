"""Mixing sources to target weights by a time-varying curriculum, with Spark expressions only.

Each source has a weight schedule: weight as a piecewise linear function of training time u in [0, 1]. Its
integral is the source's share of the whole budget. A source cannot give more than ``repeats`` times its
size, so targets stop there and the excess is shared anew by weight (water filling, solved in closed form
by running sums over the sources in order of cap per weight).

Inside a source the documents are passed through in a fixed pseudo-random order, as often as the target
needs. The running word count of a document is a point of its source's cumulative demand; inverting the
integrated schedule there gives the training time at which the document is due, and the mix is the
documents range-sorted by that time.

Running sums never need one task per source: documents fall into hash buckets, (source, bucket) sums are
combined before their shuffle, and the sums within a bucket are taken where the bucket lies. A hot source
so spreads over all buckets, whose number grows with the table. Rows that share an id (or have none) share a
bucket; a crowded one is split further by id and size, and rows alike in both, which can stand in any order,
are salted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import located, settle, source_of, word_count

#: Knots (u, weight) of the schedules, dealt to the sources in order, again and again. Their integrals
#: are 5, 2 and 1: the heaviest sources lead early in training and the light ones late.
SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (1.0, 1.5)))

#: Rows that a bucket of one source is meant to hold; one of more than twice as many is split.
PER_BUCKET = 500_000
#: Up to so many crowded buckets or groups of rows alike are broadcast; each stands for ``PER_BUCKET`` rows and more.
BROADCAST_CROWDS = 100_000


def integral(knots: tuple[tuple[float, float], ...]) -> float:
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))


def schedule_column(schedules: tuple, slot: Column) -> Column:
    """Segments of the schedule that a slot has: start, weight, slope, area before, area of all."""
    out = []
    for knots in schedules:
        done, segments = 0.0, []
        for (u, w), (v, x) in zip(knots, knots[1:], strict=False):
            segments.append(F.struct(F.lit(float(u)).alias("u"), F.lit(float(w)).alias("w"), F.lit((x - w) / (v - u)).alias("slope"), F.lit(done).alias("done")))
            done += (v - u) * (w + x) / 2
        out.append(F.struct(F.array(*segments).alias("segments"), F.lit(done).alias("area")))
    return F.element_at(F.array(*out), slot.cast("int") + 1)


def due(schedule: Column, part: Column) -> Column:
    """The training time at which ``part`` of a source's whole demand has been met: the inverse of the integral."""
    y = part * schedule["area"]
    last = F.element_at(F.filter(schedule["segments"], lambda s: s["done"] <= y), -1)
    rest = y - last["done"]
    root = F.sqrt(F.greatest(last["w"] * last["w"] + 2 * last["slope"] * rest, F.lit(0.0)))
    step = F.when(rest <= 0, F.lit(0.0)).otherwise(2 * rest / (last["w"] + root))
    return last["u"] + step


def targets(sizes: DataFrame, schedules: tuple, repeats: int, share: float = 1.0) -> DataFrame:
    """Per source (``source``, ``source_size``): its schedule and its share of all words, capped and reshared.

    One row per source goes through one task here; sources are few beside documents.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumn("slot", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(schedules))
    ranked = ranked.withColumn("schedule", schedule_column(schedules, F.col("slot"))).withColumn("weight", F.col("schedule.area"))
    ranked = ranked.withColumn("cap", (F.col("source_size") * repeats).cast("double"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    filled = (
        ranked.withColumn("budget", F.sum("source_size").over(every).cast("double") * share)
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("left"))
    )
    water = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(every)["level"]
    return filled.withColumn("target", F.least(F.col("cap"), F.coalesce(water, F.col("cap") / F.col("weight")) * F.col("weight"))).select(
        "source", "source_size", "target", "schedule"
    )


def slotted(sized: DataFrame, sums: DataFrame, per_bucket: int) -> DataFrame | None:
    """``sized`` with a ``slot`` that splits crowded buckets in the order of their rows, empty elsewhere; None if none is crowded."""

    def met(rows: DataFrame, few: DataFrame) -> DataFrame:
        few = settle(few, "mix-crowds")
        few = few.withColumnsRenamed({"source": "s", "bucket": "b", "slot": "t"})
        on = F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))
        on = on & (F.col("slot") == F.col("t")) if "t" in few.columns else on
        return rows.join(F.broadcast(few) if few.count() <= BROADCAST_CROWDS else few, on, "left").drop("s", "b", "t")

    crowded = sums.filter(F.col("rows") > 2 * per_bucket)
    if crowded.isEmpty():
        return None
    alike = F.concat_ws(":", "key", F.col("id").isNull().cast("int"), F.lpad(F.col("size").cast("string"), 20, "0"))
    rows = met(sized, crowded.select("source", "bucket", F.lit(True).alias("crowded")))
    rows = rows.withColumn("slot", F.when(F.col("crowded"), alike).otherwise(""))
    many = rows.filter("crowded").groupBy("source", "bucket", "slot").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > per_bucket)
    rows = met(rows, many.select("source", "bucket", "slot", F.ceil(F.col("n") / per_bucket).alias("parts")))
    salt = F.lpad(F.pmod(F.xxhash64("row"), F.col("parts")).cast("string"), 20, "0")
    slot = F.when(F.col("parts").isNotNull(), F.concat_ws(":", "slot", salt)).otherwise(F.col("slot"))
    return settle(rows.withColumn("slot", slot).drop("crowded", "parts"), "mix-slots")


def mix(
    docs: DataFrame,
    schedules: tuple = SCHEDULES,
    repeats: int = 3,
    share: float = 1.0,
    whole: bool = False,
    seed: str = "mix",
    per_bucket: int = PER_BUCKET,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    order: str | None = None,
) -> DataFrame:
    """What a mix takes of each document: ``row_id, source, size, source_size, target, taken, copies, positions, position``.

    Sources are ordered by code point, null last and a source of its own, and get ``schedules`` in turn.
    ``taken`` counts words, repeats included, and sums to each source's target rounded down, since the
    document on the edge is taken in part; with ``whole`` it is taken wholly if at least half of it is due,
    so that ``taken`` is ``copies`` times the size. ``positions`` are the training times of the copies,
    ``position`` the first (null if none). A null or blank text has size 0 and is not taken; null ids are
    ordered like an empty id; repeated rows count each; an empty table gives no rows. A task orders
    about ``per_bucket`` rows, or twice as many. ``order`` names a column whose hash orders documents in place of
    the id's. Only the columns named are read.
    """
    key = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(order or row_id).cast("string"), F.lit(""))))
    row = F.xxhash64(row_id) if order else F.monotonically_increasing_id()
    sized = docs.select(F.col(row_id).alias("id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), key.alias("key"), row.alias("row"))
    sized = settle(sized, "mix-sizes")
    digits, n = 3, sized.count()
    while 16**digits * per_bucket < n:
        digits += 1
    sized = sized.withColumn("bucket", F.substring("key", 1, digits))
    sums = settle(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"), F.count(F.lit(1)).alias("rows")), "mix-sums")
    split = slotted(sized, sums, per_bucket)
    if split is None:
        sized, sums = (t.withColumn("slot", F.lit("")) for t in (sized, sums))
    else:
        sized = split
        sums = settle(sized.groupBy("source", "bucket", "slot").agg(F.sum("size").alias("bucket_size")), "mix-sums")
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), schedules, repeats, share)
    before = Window.partitionBy("source").orderBy("bucket", "slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    goal = sums.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "bucket", "slot", "base", "source_size", "target", "schedule")
    goal = settle(goal.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.col("slot").alias("t"), "base", "source_size", "target", "schedule"), "mix-goal")
    inside = Window.partitionBy("source", "bucket", "slot").orderBy("key", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(goal, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")) & (F.col("slot") == F.col("t"))).withColumn("start", F.col("base") + F.col("inner"))
    asked = F.floor("target")
    passes = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda k: F.col("start") + k * F.col("source_size"))
    got = F.transform(passes, lambda s: F.struct(s.alias("s"), F.least(F.greatest(asked - s, F.lit(0)), F.col("size")).alias("n")))
    if whole:
        got = F.transform(got, lambda x: F.struct(x["s"].alias("s"), F.when(2 * x["n"] >= F.col("size"), F.col("size")).otherwise(F.lit(0)).alias("n")))
    placed = placed.withColumn("got", F.filter(got, lambda x: x["n"] > 0))
    placed = placed.withColumn("positions", F.transform("got", lambda x: due(F.col("schedule"), F.least(x["s"] / F.col("target"), F.lit(1.0)))))
    return placed.select(
        F.col("id").alias(row_id),
        F.col("source").alias(source),
        "size",
        "source_size",
        "target",
        F.aggregate("got", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("taken"),
        F.size("got").alias("copies"),
        "positions",
        F.get("positions", F.lit(0)).alias("position"),
    )


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = mix(docs).select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return out.orderBy(F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: whole documents, each as often as the mix takes it, in training order.

    Documents are ordered by id and text, so reruns agree; rows are told apart by their place in the table,
    so each of several equal rows is taken as often as it is due. Rows without words are not taken; null
    sources are a source; an empty table gives no rows; all columns are kept as they are.
    """
    rows = located(spark, source_of(docs), docs.schema)
    named = rows.select("at", "text", "source", F.struct("doc_id", F.xxhash64("text")).alias("order"))
    taken = mix(named, whole=True, row_id="at", order="order").filter("copies > 0")
    taken = taken.select("at", F.explode("positions").alias("mixed_at"))
    out = rows.select(F.struct(*docs.columns).alias("doc"), "at").join(taken, "at")
    return out.repartitionByRange("mixed_at").sortWithinPartitions("mixed_at", "doc.doc_id").select("doc.*")


ORACLE = {
    "op4_mix_sources": r"""
        WITH RECURSIVE s AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
        t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                     CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
              FROM s GROUP BY source),
        fill AS (
            SELECT source, source_size, w, 0 AS round, false AS capped, 0.0::DOUBLE AS target FROM t
            UNION ALL
            SELECT source, source_size, w, round + 1, capped OR wish > 3.0 * source_size, CASE WHEN capped THEN target WHEN wish > 3.0 * source_size THEN 3.0 * source_size ELSE wish END
            FROM (SELECT *, w * ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(target) FILTER (WHERE capped) OVER (), 0.0)::DOUBLE) / (sum(w) FILTER (WHERE NOT capped) OVER ()) AS wish FROM fill) f
            WHERE round < 30),
        goal AS (SELECT source, source_size, w, target FROM fill WHERE round = 30),
        p AS (
            SELECT s.*, g.source_size, g.w, g.target,
                   CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
            FROM s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source),
        q AS (
            SELECT *, CAST(least(greatest(floor(target) - start, 0), size) + least(greatest(floor(target) - start - source_size, 0), size)
                           + least(greatest(floor(target) - start - 2 * source_size, 0), size) AS BIGINT) AS taken,
                   least(start / target, 1.0) * w AS y, CASE w WHEN 5 THEN 7.5 WHEN 2 THEN 2.0 ELSE 0.5 END::DOUBLE AS w0,
                   CASE w WHEN 5 THEN -5.0 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS slope
            FROM p)
        SELECT doc_id, size, source_size, target, taken,
               round(CASE WHEN taken > 0 THEN 2 * y / (w0 + sqrt(greatest(w0 * w0 + 2 * slope * y, 0))) END, 6) AS position
        FROM q""",
}
QUERIES = {"op4_mix_sources": op4_mix_sources}
