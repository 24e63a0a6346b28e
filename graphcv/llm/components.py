"""Connected components of a link table, by distributed label propagation over stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.llm.shared import written


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node reachable from every node of `links` (a, b): node, component. Nodes without links are not in it.

    Alternates large and small stars: every node links its larger, then its smaller neighbours to the least of them,
    until nothing changes; rounds grow with the logarithm of the longest path. Each round is written to the shared
    folder. The least neighbour is found by aggregation, so no node's neighbours meet in one task. Self links and
    repeated links do no harm; nodes may be of any orderable type.
    """
    both = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    edges = written(both, "links")
    for _ in range(max_rounds):
        arcs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = arcs.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = arcs.where("b > a").join(least, "a").select(F.col("b"), F.col("m")).where("b <> m").distinct()  # larger neighbours to the least
        large = written(large, "large-stars")  # read twice
        small = large.groupBy("b").agg(F.min("m").alias("m"))
        stars = large.withColumnRenamed("m", "n").join(small, "b").select(F.explode(F.array(F.struct(F.col("b"), F.col("m")), F.struct(F.col("n").alias("b"), F.col("m")))).alias("e"))
        after = written(stars.select(F.least("e.b", "e.m").alias("a"), F.greatest("e.b", "e.m").alias("b")).where("a <> b").distinct(), "links")
        same = after.count() == edges.count() and after.join(edges, ["a", "b"], "left_anti").isEmpty()
        edges = after
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots)
