"""Eigenvectors of pieces and of whole graphs, and alignment of positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.operators.graph import arcs, degrees
from graphcv.operators.krylov import by_piece, leading_eigenpairs
from graphcv.sources.shared import written


def regular_rows(degree: DataFrame, taus: dict[int, float], laplace: bool, scale: str = "piece", n_graph: int = 0) -> tuple[DataFrame, dict[int, float]]:
    """(piece, node, f; piece -> constant) of regularised matrices f_i f_j (linked + constant), from degree: piece, node, degree.

    The constant is tau dbar over the piece's nodes (scale "graph": `n_graph`); scale "dk" adds to degrees what it adds to entries.
    """
    stats = {r["piece"]: r for r in degree.groupBy("piece").agg(F.avg("degree").alias("mean"), F.count("*").alias("n")).collect()}  # a row a piece
    mass = {p: taus[p] * (r["mean"] or 0.0) for p, r in stats.items()}
    consts = {p: mass[p] / max(1, n_graph if scale == "graph" else r["n"]) for p, r in stats.items()}
    if not laplace or not stats:
        return degree.select("piece", "node", F.lit(1.0).alias("f")), consts
    heavy = F.col("degree") + by_piece(consts if scale == "dk" else mass)
    return degree.select("piece", "node", F.when(heavy > 0, 1 / F.sqrt(heavy)).otherwise(0.0).alias("f")), consts


def sub_eigenvectors(members: DataFrame, edges: DataFrame, k: int, tau: float = 0.0, laplace: bool = False, scale: str = "piece", n_graph: int = 0, keys: tuple[str, ...] = ("rep", "sub"), **options) -> DataFrame:
    """keys, node, x, values: rows of the top-k eigenvectors (by magnitude) of every piece's regularised matrix, with the eigenvalues.

    All pieces are solved together (`leading_eigenpairs`): small ones in a task each, larger ones on the cluster, so no piece
    needs to fit into a task. The constant of the regularisation stays a rank-one part.
    """
    types, found = dict(members.dtypes), sorted(tuple(r) for r in members.select(*keys).distinct().collect())  # a row a piece
    schema = ", ".join(f"{c} {types[c]}" for c in keys)
    if not found:
        return members.select(*keys, "node", F.array().cast("array<double>").alias("x"), F.array().cast("array<double>").alias("values"))
    named = F.broadcast(members.sparkSession.createDataFrame([(*key, p) for p, key in enumerate(found)], f"{schema}, piece int"))
    own = edges.select(*keys, "src", "dst").join(named, list(keys)).select("piece", "src", "dst")
    degree = written(degrees(members.select(*keys, "node").join(named, list(keys)).select("piece", "node"), own, ("piece",)), "piece-degrees")
    rows, consts = regular_rows(degree, dict.fromkeys(range(len(found)), tau), laplace, scale, n_graph)
    vectors, solved = leading_eigenpairs(rows, written(arcs(own), "piece-arcs"), consts, k, **options)
    values = members.sparkSession.createDataFrame([(p, v) for p, (v, _) in solved.items()], "piece int, values array<double>")
    return vectors.join(F.broadcast(values), "piece").join(named, "piece").select(*keys, "node", "x", "values")


def adjacency_embedding(members: DataFrame, edges: DataFrame, d: int, laplace: bool = False, keys: tuple[str, ...] = ("rep", "sub")) -> DataFrame:
    """keys, node, x: eigenvectors scaled by the root of their eigenvalue's magnitude."""
    found = sub_eigenvectors(members, edges, d, 0.0, laplace, keys=keys)
    return found.select(*keys, "node", F.zip_with("x", "values", lambda v, e: v * F.sqrt(F.abs(e))).alias("x"))


def graph_eigenvectors(nodes: DataFrame, edges: DataFrame, k: int, tau: float = 0.0, laplace: bool = False, scale: str = "piece", **options) -> tuple[DataFrame, list[float], list[float]]:
    """(node, x; eigenvalues; residuals) of the whole graph's regularised matrix (see `leading_eigenpairs` for the options)."""
    found, solved = each_tau_eigenvectors(nodes, edges, k, [tau], laplace, scale, lone=True, **options)
    values, residuals = solved.get(0, ([], []))
    return found.select("node", "x"), values, residuals


def each_tau_eigenvectors(nodes: DataFrame, edges: DataFrame, k: int, taus: list[float], laplace: bool = False, scale: str = "piece", lone: bool = False, **options):
    """(piece, node, x; piece -> eigenvalues and residuals) of the whole graph's matrix for every tau (piece i is taus[i]), all taus in
    the same rounds. Without `lone`, nodes without edges are left out at tau = 0."""
    degree = written(degrees(nodes, edges), "degrees")
    piece = F.explode(F.sequence(F.lit(0), F.lit(len(taus) - 1))).alias("piece")
    rows = degree.select(piece, "node", "degree")
    none = [i for i, t in enumerate(taus) if t == 0]
    if none and not lone:
        rows = rows.where((F.col("degree") > 0) | ~F.col("piece").isin(*none))
    rows, consts = regular_rows(rows, dict(enumerate(map(float, taus))), laplace, scale)
    return leading_eigenpairs(rows, written(arcs(edges.select("src", "dst")).select(piece, "src", "dst"), "arcs"), consts, k, **options)


def train_row_svd(nodes: DataFrame, edges: DataFrame, train: DataFrame, k: int, shift: float = 0.001, **options) -> tuple[DataFrame, list[float]]:
    """(node, x; singular values): the top-k right singular vectors of the rows of the nodes `train`, all nodes as columns, with
    `shift` added to every entry, which stays a rank-one part."""
    marked = nodes.select(F.lit(0).alias("piece"), "node").join(train.select("node", F.lit(True).alias("train")), "node", "left").na.fill(False, ["train"])
    found, values = _train_rows(marked, edges, k, shift, options)
    return found.select("node", "x"), values.get(0, [])


def fold_row_svd(folds: DataFrame, edges: DataFrame, k: int, cv: int, shift: float = 0.001, **options) -> tuple[DataFrame, dict[int, list[float]]]:
    """(fold, node, x; fold -> singular values): `train_row_svd` for every fold held out, all folds in the same rounds. folds: node, fold."""
    every = F.explode(F.sequence(F.lit(1), F.lit(cv))).alias("piece")
    marked = folds.select(every, "node", "fold").select("piece", "node", (F.col("fold") != F.col("piece")).alias("train"))
    found, values = _train_rows(marked, edges, k, shift, options)
    return found.withColumnRenamed("piece", "fold"), values


def _train_rows(marked: DataFrame, edges: DataFrame, k: int, shift: float, options: dict):
    rows = written(marked.select("piece", "node", F.lit(1.0).alias("f"), "train"), "row-marks")
    links = written(arcs(edges.select("src", "dst")).join(rows.where("train").select("piece", F.col("node").alias("dst")), "dst").select("piece", "src", "dst"), "train-arcs")
    found, solved = leading_eigenpairs(rows, links, {}, k, shift=shift, **options)
    return found, {p: [float(np.sqrt(max(v, 0.0))) for v in values] for p, (values, _) in solved.items()}


def row_normalize(positions: DataFrame) -> DataFrame:
    """x divided by its norm; a row of zeros stays."""
    size = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
    return positions.withColumn("_n", size).withColumn("x", F.transform("x", lambda v: v / F.when(F.col("_n") > 0, F.col("_n")).otherwise(1.0))).drop("_n")


def procrustes_align(positions: DataFrame, shared: DataFrame, translate: bool = False, keys: tuple[str, ...] = ("rep",)) -> DataFrame:
    """Positions (keys, sub, node, x) of every piece turned (and moved) onto piece 1 by their shared nodes (keys, node).

    The d x d cross products are sums over shared nodes, so any number of them meets in small groups; each piece's turn
    is the polar factor of its cross product.
    """
    both = positions.join(shared.select(*keys, "node"), [*keys, "node"])
    one = both.where("sub = 1").select(*keys, "node", F.col("x").alias("z"))
    met = both.where("sub > 1").join(one, [*keys, "node"]).select(*keys, "sub", F.posexplode("x").alias("i", "u"), "z", "node")
    cross = met.select(*keys, "sub", "i", "u", F.posexplode("z").alias("j", "v")).groupBy(*keys, "sub", "i", "j").agg(F.sum(F.col("u") * F.col("v")).alias("c"), F.sum("u").alias("su"), F.sum("v").alias("sv"), F.count("*").alias("n"))

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["i"].max()) + 1
        c, su, sv = np.zeros((d, d)), np.zeros(d), np.zeros(d)
        c[pdf["i"], pdf["j"]], su[pdf["i"]], sv[pdf["j"]] = pdf["c"], pdf["su"], pdf["sv"]
        n = float(pdf["n"].iloc[0])
        if translate:
            c = c - np.outer(su, sv) / n
        u, _, v = np.linalg.svd(c)
        q = u @ v
        move = sv / n - (su / n) @ q if translate else np.zeros(d)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in (*keys, "sub")}, "q": [[list(r) for r in q.T]], "move": [list(move)]})

    types = dict(positions.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in (*keys, "sub")), "q array<array<double>>, move array<double>"])
    turns = cross.groupBy(*keys, "sub").applyInPandas(turn, schema)
    moved = positions.join(turns, [*keys, "sub"], "left")
    product = F.zip_with(F.transform("q", lambda row: F.aggregate(F.zip_with(row, F.col("x"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)), "move", lambda a, b: a + b)
    return moved.select(*keys, "sub", "node", F.when(F.col("q").isNull(), F.col("x")).otherwise(product).alias("x"))
