"""Tables written in the folder that all executors share, and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir. Where that is unset, a new local folder serves in local mode (tests) only; on a cluster that
    would be another disk for each executor, so it is refused."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        top = known.get() if known.isDefined() else None
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="graphcv-shared-")
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/graphcv-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder: cuts lineage, survives lost executors, and its size is known to the planner."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table that `written` made and nothing reads any more."""
    for name in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(name).getParent()
        if folder.getName().startswith("graphcv-"):
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, bytes_a_row: int = 64, limit: int = 64 << 20) -> DataFrame:
    """`df` to broadcast if its rows take `limit` bytes at most by count, else to shuffle."""
    return F.broadcast(df) if df.count() * bytes_a_row <= limit else df
