"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: ASCII white space as the contracts name it: space and \t \n \v \f \r.
SPACE = r"\x20\x09-\x0D"
#: A word: a maximal run of anything else.
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the cluster names it.

    Only where it is unset and all of Spark runs on this machine (tests), a temporary folder is made and set;
    on a cluster such a folder would lie on each machine's own disk, so there it is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = held.get() if held.isDefined() else None
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="topicloom-")
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    df.write.parquet(path := fresh(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def source_of(docs: DataFrame) -> str:
    """The path of ``docs`` if it is one whole Parquet table without partition columns, else that of a written copy."""
    spark = docs.sparkSession
    plan = docs._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and (table := plan.relation()).getClass().getSimpleName() == "HadoopFsRelation":
        roots = table.location().rootPaths()
        if roots.size() == 1 and table.partitionSchema().isEmpty() and table.fileFormat().getClass().getSimpleName() == "ParquetFileFormat":
            return roots.head().toString()
    docs.write.parquet(path := fresh(spark, "source"))
    return path


def located(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The Parquet table at ``path`` with each row's locator ``at`` (file, row), which names it for good."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return spark.read.schema(schema).parquet(path).withColumn("at", at)


def give_back() -> None:
    """Return memory that a Python worker has freed to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(conf).delete(at, True)


def word_count(text: Column) -> Column:
    """Words of a text (null: 0), counted without building an array of them."""
    marks = F.regexp_replace(text, rf"[{SPACE}]*{WORD}[{SPACE}]*", "x")
    return F.coalesce(F.length(F.regexp_replace(marks, rf"[{SPACE}]", "")), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def starts(lengths: Column, run: int = 256) -> Column:
    """Exclusive running sums, by runs so that long arrays cost little more than short ones."""
    zero = F.lit(0).cast("long")
    sums = lambda xs: F.aggregate(xs, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    total = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / run).cast("int")), lambda k: F.slice(v, k * run + 1, run))
    inside = lambda xs, first: F.transform(F.slice(sums(xs), 1, F.size(xs)), lambda s: s + first)
    joined = lambda runs: let(
        sums(F.transform(runs, total)), lambda base: F.flatten(F.transform(runs, lambda xs, k: let(F.element_at(base, k + 1), lambda first: inside(xs, first))))
    )
    return let(lengths, lambda v: F.when(F.size(v) > 0, let(cut(v), joined)).otherwise(F.array().cast("array<bigint>")))
