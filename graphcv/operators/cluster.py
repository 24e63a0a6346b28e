"""Clustering positions into communities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.functions.columns import distance
from graphcv.operators.spectral import row_normalize, sub_eigenvectors
from graphcv.sources.shared import written


def kmeans(x: np.ndarray, k: int, nstart: int = 30, rounds: int = 30, seed: int = 42) -> np.ndarray:
    """Labels 1..k of the best of `nstart` runs, numbered by the first row that has them."""
    rng, best = np.random.default_rng(seed), (np.inf, None)
    squares = (x * x).sum(1)
    for _ in range(nstart):
        centers = x[rng.integers(len(x))][None]
        near = ((x - centers[0]) ** 2).sum(1)
        while len(centers) < k:  # far points are likelier starts
            p = near / near.sum() if near.sum() > 0 else None
            centers = np.vstack([centers, x[rng.choice(len(x), p=p)]])
            near = np.minimum(near, ((x - centers[-1]) ** 2).sum(1))
        g = None
        for _ in range(rounds):
            d = squares[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
            new = d.argmin(1)
            if g is not None and (new == g).all():
                break
            g = new
            for c in range(k):
                if (g == c).any():
                    centers[c] = x[g == c].mean(0)
        cost = float(np.maximum(d[np.arange(len(x)), g], 0).sum())
        if cost < best[0] - 1e-12:
            best = cost, g
    _, first, g = np.unique(best[1], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[g] + 1


def kmedoids(x: np.ndarray, k: int, seed: int = 42, cells: int = 4_000_000) -> np.ndarray:
    """Labels 1..k: medoids chosen greedily among all rows, each lowering the sum of distances of all rows most; then every
    row goes to the nearest medoid. Distances are made for blocks of candidates, `cells` at once, and never kept."""
    squares, step = (x * x).sum(1), max(1, cells // max(1, len(x)))

    def distances(m: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(squares[:, None] - 2 * x @ x[m].T + squares[m], 0))

    blocks = [np.arange(i, min(i + step, len(x))) for i in range(0, len(x), step)]
    chosen = [int(np.concatenate([distances(m).sum(0) for m in blocks]).argmin())]
    near = distances(np.array(chosen))[:, 0]
    while len(chosen) < min(k, len(x)):
        gain = np.concatenate([np.maximum(near[:, None] - distances(m), 0).sum(0) for m in blocks])
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
        near = np.minimum(near, distances(np.array(chosen[-1:]))[:, 0])
    m = x[chosen]
    return (squares[:, None] - 2 * x @ m.T + (m * m).sum(1)).argmin(1) + 1


def tiled_medoids(positions: DataFrame, cands: list[int], keys: tuple[str, ...], normalize: bool, tile: int = 2000) -> DataFrame:
    """keys, cand, node, g as `kmedoids` gives them, for pieces of any size: each medoid is chosen by one job that sums, for all candidates,
    the distances of all rows by tiles of both. Of equal sums (9 digits) the least node is chosen. A piece's medoids come to the driver."""
    on = [*keys, "cand"]
    each = positions.select(*keys, "node", F.explode(F.array(*[F.lit(c) for c in cands])).alias("cand"), "x").withColumn("x", F.slice("x", 1, F.col("cand")))
    each = written((row_normalize(each) if normalize else each).select(*on, "node", "x"), "medoid-rows")
    largest = each.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    tiles = max(1, -(-largest // tile))
    part = F.pmod(F.xxhash64("node"), F.lit(tiles)).cast("int")
    every, types = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))), dict(each.dtypes)
    state = each.select(*on, "node", "x", F.lit(float("inf")).alias("near"), F.lit(1).alias("g"))
    schema = ", ".join(f"{c} {types[c]}" for c in on)

    def far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0))

    for turn in range(1, max(cands) + 1):
        open_ = state.where(F.col("cand") >= turn).where(F.col("cand") > 1)
        rows = open_.select(*on, part.alias("ti"), every.alias("tj"), F.lit(0).alias("side"), "node", "x", "near").unionByName(open_.select(*on, every.alias("ti"), part.alias("tj"), F.lit(1).alias("side"), "node", "x", "near"))

        def costs(key, pdf: pd.DataFrame) -> pd.DataFrame:
            a, b = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
            if not len(a) or not len(b):
                return pd.DataFrame({c: [] for c in (*on, "node", "cost")}, dtype=object)
            cost = np.minimum(far(np.stack(a["x"].to_numpy()), np.stack(b["x"].to_numpy())), a["near"].to_numpy()[:, None]).sum(0)
            return pd.DataFrame({**{c: key[k] for k, c in enumerate(on)}, "node": b["node"].to_numpy(), "cost": cost})

        summed = rows.groupBy(*on, "ti", "tj").applyInPandas(costs, f"{schema}, node {types['node']}, cost double").groupBy(*on, "node").agg(F.sum("cost").alias("cost"))
        best = written(summed.groupBy(*on).agg(F.min(F.struct(F.round("cost", 9).alias("cost"), F.col("node"))).alias("b")).select(*on, F.col("b.node").alias("node")), "medoids")
        medoid = F.broadcast(each.join(F.broadcast(best), [*on, "node"]).select(*on, F.col("x").alias("m")))  # a row a piece and candidate
        met = state.join(medoid, on, "left")
        away = F.when(F.col("m").isNull(), F.lit(float("inf"))).otherwise(distance(F.col("x"), F.col("m")))
        state = met.withColumn("away", away).select(*on, "node", "x", F.least("near", "away").alias("near"), F.when(F.col("away") < F.col("near"), turn).otherwise(F.col("g")).alias("g"))
        state = written(state, "medoid-state")
    return state.select(*on, "node", "g")


def cluster_labels(positions: DataFrame, cands: list[int], keys: tuple[str, ...] = ("rep", "sub"), normalize: bool = False, method: str = "kmeans", seed: int = 42, most: int = 10_000) -> DataFrame:
    """keys, cand, node, g: labels from the first `cand` entries of x, for all candidates of a piece in one pass. One label needs no
    clustering. Medoids of pieces of more than `most` rows are chosen by tiles (`tiled_medoids`), as their work is the square of the rows."""
    if method == "kmedoids" and (positions.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > most:
        return tiled_medoids(positions, cands, keys, normalize)
    rows = positions
    choose = kmeans if method == "kmeans" else kmedoids

    def label(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        x, out = np.stack(pdf["x"].to_numpy()), []
        for c in cands:
            y = x[:, :c]
            if normalize:
                n = np.sqrt((y * y).sum(1, keepdims=True))
                y = y / np.where(n > 0, n, 1)
            g = np.ones(len(y), int) if c == 1 else choose(y, c, seed=seed)
            out.append(pd.DataFrame({**{k: v for k, v in zip(keys, key, strict=True)}, "cand": c, "node": pdf["node"].to_numpy(), "g": g}))
        return pd.concat(out)

    types = dict(rows.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "cand int, node long, g int"])
    return rows.select(*keys, "node", "x").groupBy(*keys).applyInPandas(label, schema)


def spectral_labels(members: DataFrame, edges: DataFrame, cands: list[int], corrected: bool = False, tau: float = 0.0, laplace: bool = False, method: str = "kmeans", keys: tuple[str, ...] = ("rep", "sub"), scale: str = "piece", n_graph: int = 0) -> DataFrame:
    """keys, cand, node, g: spectral labels of every piece; one eigensolve at the largest candidate serves all. Rows are
    normalised for the degree-corrected model."""
    found = sub_eigenvectors(members, edges, max(cands), tau, laplace, scale, n_graph, keys)
    return cluster_labels(found, cands, keys, corrected, method)


def graph_labels(positions: DataFrame, k: int, normalize: bool = False, nstart: int = 5, seed: int = 42) -> DataFrame:
    """node, g of a whole graph's positions (node, x), by the library's distributed k-means, the best of `nstart` seeds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    table = (row_normalize(positions) if normalize else positions).select("node", array_to_vector("x").alias("features"))
    if k == 1:
        return table.select("node", F.lit(1).alias("g"))
    models = [KMeans(k=k, seed=seed + s, maxIter=30).fit(table) for s in range(nstart)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(table).select("node", (F.col("prediction") + 1).alias("g"))
