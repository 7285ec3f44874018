"""Exact dedup: a stateful stream over digests, with full bytes checked on every hit.

Documents stream through a keyed aggregation whose state lives in RocksDB on the executors' disks and is
checkpointed to the shared folder. The state has no watermark and so never expires. For each digest it
retains the stable identifier (the smallest doc_id so far), the locator of that row's content (file and
row number) and how many rows had it. Every further row of a known digest is a hit. Hits are then held
against the retained row byte by byte: a digest alone never drops a document.

The texts are shuffled once, to meet the state; of those only the texts of repeated digests are written
down, and only they are shuffled again for the comparison. No step gathers a group in one task: the
aggregations combine before their shuffle, and the joins are such that AQE can split a hot digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, fresh, located, settle, source_of

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalise(text: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def as_stream(spark: SparkSession, path: str) -> str:
    """File streams take folders and patterns: a single file is named by a pattern that only it fits."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    return f"{path[:-1]}[{path[-1]}]" if single else path


def keyed_state(
    spark: SparkSession, path: str, schema: T.StructType, text: str, row_id: str, digest: Callable[[Column], Column], batch_bytes: str | None
) -> DataFrame:
    """Run the stream over all files there are; return the state: digest, keep_id, keep_at, n.

    ``keep_at`` is the locator (file, row number) of the row with the smallest id, nulls last.
    """
    reader = spark.readStream.schema(schema)
    if batch_bytes:
        reader = reader.option("maxBytesPerTrigger", batch_bytes)
    rows = reader.parquet(as_stream(spark, path)).select(
        digest(normalise(F.col(text))).alias("digest"),
        F.struct(
            F.col(row_id).isNull().alias("no_id"),
            F.col(row_id).alias("id"),
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("who"),
    )
    state = rows.groupBy("digest").agg(F.min("who").alias("who"), F.count(F.lit(1)).alias("n"))
    out = fresh(spark, "dedup-state")

    def put(batch: DataFrame, number: int) -> None:  # overwritten whole if a batch is run again
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    held = {
        k: spark.conf.get(k, None)
        for k in (
            "spark.sql.streaming.stateStore.providerClass",
            "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage",
            "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB",
            "spark.sql.streaming.stateStore.rocksdb.allowFAllocate",  # else each partition's store takes megabytes of empty files
            "spark.sql.streaming.noDataMicroBatches.enabled",
        )
    }
    writer = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", fresh(spark, "dedup-stream"))
    for k, v in zip(held, (ROCKS, "true", "100", "false", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        running = writer.trigger(availableNow=True).start()  # the stream keeps a copy of the settings
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    running.awaitTermination()
    wanted = T.StructType([*state.schema.fields, T.StructField("batch", T.LongType())])
    kept = spark.read.schema(wanted)
    try:
        kept = kept.parquet(out)
    except Exception as e:  # no rows, no batch, no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        kept = spark.createDataFrame([], wanted)
    if kept.agg(F.max("batch")).first()[0]:  # of several batches the last word on each digest counts
        kept = kept.groupBy("digest").agg(F.max_by("who", "batch").alias("who"), F.max("n").alias("n"))
    return kept.select("digest", F.col("who.id").alias("keep_id"), F.struct("who.file", "who.row").alias("keep_at"), "n")


def exact_dedup(
    spark: SparkSession,
    path: str,
    text: str = "text",
    row_id: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
    batch_bytes: str | None = None,
) -> DataFrame:
    """Group the rows of the Parquet table at ``path`` by equal normalised text.

    Returns one row per row: ``<row_id>``, ``at`` (its locator), ``digest``, ``keep_id``, ``group_size``,
    ``kept``. Of equal texts the row with the smallest id stays; null ids come last, and of rows with the
    same id the first by file and row number stays. Null text counts as empty; an empty table gives no
    rows; further columns are ignored whatever their names. ``digest`` may be any function of the text
    (tests use a weak one to force collisions): texts that differ are never put together. With
    ``batch_bytes`` the stream takes that much input per micro-batch.
    """
    schema = spark.read.parquet(path).schema
    state = keyed_state(spark, path, schema, text, row_id, digest, batch_bytes)
    norm = normalise(F.col(text))
    rows = spark.read.schema(schema).parquet(path).select(
        F.col(row_id).alias("id"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
        digest(norm).alias("digest"),
        norm.alias("norm"),
    )
    # Small state rows are hashed, texts stream past them and are never sorted.
    met = rows.join(state.hint("shuffle_hash"), "digest").select(
        "id", "at", "digest", "keep_id", "n", (F.col("at") == F.col("keep_at")).alias("first"), F.when(F.col("n") > 1, F.col("norm")).alias("norm")
    )
    met = settle(met, "dedup-met")
    alone = met.filter((F.col("n") == 1) | F.col("first"))
    firsts = met.filter((F.col("n") > 1) & F.col("first")).select("digest", F.col("norm").alias("first_norm"))
    hits = met.filter((F.col("n") > 1) & ~F.col("first")).join(firsts, "digest")
    hits = settle(
        hits.select("id", "at", "digest", "keep_id", "n", (same := F.col("norm") == F.col("first_norm")).alias("same"), F.when(~same, F.col("norm")).alias("norm")),
        "dedup-hits",
    )
    columns = [F.col("id").alias(row_id), "at", "digest", "keep_id", F.col("n").alias("group_size")]
    if hits.filter(~F.col("same")).isEmpty():
        return alone.select(*columns, F.lit(True).alias("kept")).unionByName(hits.select(*columns, F.lit(False).alias("kept")))
    # Different texts under one digest: those that differ from the first are grouped by their bytes.
    odd = hits.filter(~F.col("same"))
    less = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
    own = odd.groupBy("norm").agg(F.min(F.struct(F.col("id").isNull().alias("x"), F.col("id").alias("id"), "at")).alias("who"), F.count(F.lit(1)).alias("m"))
    odd = odd.join(own, "norm").select(
        F.col("id").alias(row_id), "at", "digest", F.col("who.id").alias("keep_id"), F.col("m").alias("group_size"), (F.col("at") == F.col("who.at")).alias("kept")
    )
    even = alone.select(*columns, F.lit(True).alias("kept")).unionByName(hits.filter("same").select(*columns, F.lit(False).alias("kept")))
    even = even.join(less, "digest", "left").withColumn("group_size", F.col("group_size") - F.coalesce(F.col("less"), F.lit(0))).drop("less")
    return even.unionByName(odd)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one document stays, as ``exact_dedup`` picks it.

    Rows are told apart by their place in the table, so repeated ids and rows do no harm. Null and blank
    texts are equal to each other as there; an empty table gives no rows; all columns are kept as they are.
    """
    path = source_of(docs)
    kept = exact_dedup(spark, path).filter("kept").select("at")
    return located(spark, path, docs.schema).join(kept, "at", "left_semi").select(*docs.columns)


ORACLE = {
    "op1_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
}
QUERIES = {"op1_exact_dedup": op1_exact_dedup}
