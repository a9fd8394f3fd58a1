"""Tables between stages: written to the folder that all executors share, read back as Parquet."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few dozen bytes up to which a side may be broadcast (some tens of MB at most).
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset on one machine (tests) a new temporary folder, which is then set. On a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not re.fullmatch(r"local(\[[^\]]*\])?", master := spark.sparkContext.master):
            raise ValueError(f"spark.checkpoint.dir is unset, and executors of {master} share no temporary folder")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """df written as Parquet and reread: the lineage is cut, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """df, to be joined by moving both sides: the planner judges by compressed files, and would broadcast millions of short rows."""
    return df.hint("merge")


def side(df: DataFrame) -> DataFrame:
    """df to be joined: broadcast if it has few rows (counted), else moved."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else apart(df)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, count: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted, on a stored table); else as it is."""
    n = df.count() if count is None else count
    return F.broadcast(df) if n <= rows else df
