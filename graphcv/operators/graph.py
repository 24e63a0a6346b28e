"""Shaping graphs: edges, arcs, nodes, degrees, regularised weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.functions.columns import key_number, seeded_key


def canonical_edges(df: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Simple undirected edges, src < dst: loops, repeats and rows with a missing end go."""
    whole = df.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst)))  # least() skips nulls
    return whole.select(F.least(src, dst).alias("src"), F.greatest(src, dst).alias("dst")).distinct()


def arcs(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; other columns stay."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select("src", "dst", *rest).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def node_table(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """All nodes: the ends of edges, and those of `nodes`, which also holds isolated ones."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"))
    return (ends.unionByName(nodes.select("node")) if nodes is not None else ends).distinct()


def degrees(nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, degree: zeros are kept. Counts ends of edges, without making arcs first."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node")).groupBy(*keys, "node").agg(F.count("*").alias("degree"))
    return nodes.select(*keys, "node").join(ends, [*keys, "node"], "left").select(*keys, "node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def degree_stats(degree: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, n_nodes, mean_degree, n_isolated."""
    return degree.groupBy(*keys).agg(F.count("*").alias("n_nodes"), F.avg("degree").alias("mean_degree"), F.count_if(F.col("degree") == 0).alias("n_isolated"))


def isolated_labels(degree: DataFrame, k: int, seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """A seeded random label of 1..k for each node without edges."""
    g = key_number(seeded_key(seed, *keys, "node")) % k + 1
    return degree.where("degree = 0").select(*keys, "node", g.cast("int").alias("g"))


def regularized_weights(edges: DataFrame, degree: DataFrame, tau: float, laplace: bool, scale: str = "piece", n_graph: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """Edges of the regularised matrix A + tau dbar / N, scaled by degrees on both sides if `laplace`: keys, src, dst, w, c.

    The constant is never spread over all pairs: w is the edge's own part, c what every pair (i, j) of the piece adds
    besides, c = const * f_i * f_j with f = 1 or the scale of a node. scale: "graph" divides by `n_graph`, "piece" by the
    piece's nodes, "dk" by the piece's nodes in the degrees too. A node without weight has the scale 0.
    """
    on = list(keys)
    stats = degree_stats(degree, keys).select(*on, (F.lit(float(tau)) * F.col("mean_degree")).alias("mass"), F.col("n_nodes"))
    joined = degree.join(F.broadcast(stats), on) if on else degree.crossJoin(F.broadcast(stats))  # stats: a row for each piece
    size = F.lit(float(n_graph)) if scale == "graph" else F.col("n_nodes").cast("double")
    const = F.col("mass") / size
    heavy = F.col("degree") + (const if scale == "dk" else F.col("mass"))
    f = F.when(heavy > 0, 1 / F.sqrt(heavy)).otherwise(0.0) if laplace else F.lit(1.0)
    scaled = joined.select(*on, "node", f.alias("f"), const.alias("const"))
    a = scaled.select(*on, F.col("node").alias("src"), F.col("f").alias("f1"), "const")
    b = scaled.select(*on, F.col("node").alias("dst"), F.col("f").alias("f2"))
    met = edges.join(a, [*on, "src"]).join(b, [*on, "dst"])
    return met.select(*on, "src", "dst", (F.col("f1") * F.col("f2")).alias("w"), (F.col("const") * F.col("f1") * F.col("f2")).alias("c"))
