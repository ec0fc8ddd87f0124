"""Helpers shared by the corpus operators: shared scratch tables, checked broadcasts, text normalisation."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a (bigint) id list that may be broadcast: 2M ids are some 32 MB. Longer lists are joined by shuffle.
MAX_BROADCAST_IDS = 2_000_000

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def scratch(spark: SparkSession) -> str:
    """A new folder (URI or path) below ``spark.checkpoint.dir``, which every executor can read.

    The setting is read from the session; only a local session that has none (tests) is given a local folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="skein-shared-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/skein-{uuid.uuid4().hex}"


def table(df: DataFrame, at: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    df.write.mode("overwrite").parquet(f"{at}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{at}/{name}")


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more, and let Spark clean up the shuffle files of finished jobs, which it
    does once the driver's references to them are collected."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)
    gc.collect()
    jvm.System.gc()


def small(df: DataFrame, limit: int = MAX_BROADCAST_IDS) -> DataFrame:
    """``df`` (already a table) with a broadcast hint if it has at most ``limit`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= limit else df


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
