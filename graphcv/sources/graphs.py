"""Graphs as tables: reading, writing, and graphs derived from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphcv.operators.graph import canonical_edges


def read_graph(spark: SparkSession, path: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """The simple undirected graph stored as an edge table at `path`."""
    return canonical_edges(spark.read.parquet(path), src, dst)


def write_result(df: DataFrame, path: str, partition_by: str = "run") -> None:
    """Result tables, one directory a run; a run that is written again is replaced, the others stay."""
    df.write.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).mode("overwrite").parquet(path)


def copurchase(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (parts) and edges: two parts are linked if one order has both."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey").distinct()
    both = items.alias("a").join(items.alias("b"), "l_orderkey").where("a.l_partkey < b.l_partkey")
    edges = both.select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst")).distinct()
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"))
    return nodes, edges


def planted(spark: SparkSession, sf_dir: str, k: int = 3, inside: str = "4ccccc", across: str = "0ccccc") -> tuple[DataFrame, DataFrame]:
    """Nodes (parts, with their block g) and edges drawn by hash, more often inside a block. All pairs of parts are looked at: for small tests."""
    nodes = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("node"), (F.col("p_partkey") % k + 1).cast("int").alias("g"))
    a, b = nodes.select(F.col("node").alias("src"), F.col("g").alias("g1")), nodes.select(F.col("node").alias("dst"), F.col("g").alias("g2"))
    key = F.md5(F.concat(F.lit("42:"), F.col("src").cast("string"), F.lit(":"), F.col("dst").cast("string")).cast("binary"))
    edges = a.join(b, F.col("src") < F.col("dst")).where(key < F.when(F.col("g1") == F.col("g2"), F.lit(inside)).otherwise(F.lit(across)))
    return nodes, edges.select("src", "dst")
