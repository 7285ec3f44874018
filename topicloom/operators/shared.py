"""Tables written where driver and executors both reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the cluster names it; unset, a temporary folder where all of Spark runs on this machine."""
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not got:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        got = held.get() if held.isDefined() else None
    if not got:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        got = "file://" + tempfile.mkdtemp(prefix="topicloom-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(got)
    return got.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Written and read back: what follows starts from files, whichever executors are lost."""
    df.write.parquet(path := f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)
