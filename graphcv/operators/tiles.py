"""Losses of all pairs of held-out blocks, tile by tile, without a table of pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.operators.graph import arcs
from graphcv.operators.krylov import by_magnitude, largest_positive, leading_eigenpairs
from graphcv.operators.loss import LOSSES, auc_loss
from graphcv.sources.shared import written

#: Scores are counted by their logit in so many bins for the AUC.
BINS, REACH = 10_000, 14.0
#: Losses that sums and counts of a tile give.
TILED = ("l2", "sse", "mse", "deviance", "loglik", "auc")


def _tile_losses(rows: DataFrame, on: list[str], by: list[str], link: str, own: bool, exact: bool, losses: tuple[str, ...]) -> DataFrame:
    """by, loss, value over the pairs of all tiles. l2, sse, mse, deviance and auc come from sums and counts of a tile; another loss (see
    `register_loss`) aggregates the tiles' pairs as they leave it, which are summed up before any shuffle. rows: on (by and the tiles ti, tj), kind (0 left, 1 right,
    2 edge), node, j, x. own: both sides are the same nodes, so a tile with itself counts i < j alone.

    Scores are counted by bins of their logit. With `exact`, bins that hold both kinds of pairs are counted once more by the scores
    themselves (to 12 digits), so the AUC has no error; the other bins cannot hold a pair in the wrong order.
    """
    types = dict(rows.dtypes)
    key_schema = ", ".join(f"{c} {types[c]}" for c in by)

    def scores(key, pdf: pd.DataFrame):
        one, two, three = (pdf[pdf["kind"] == k] for k in (0, 1, 2))
        if not len(one) or not len(two):
            return None
        i, j = one["node"].to_numpy(dtype=np.int64), two["node"].to_numpy(dtype=np.int64)
        x, y = np.stack(one["x"].to_numpy()), np.stack(two["x"].to_numpy())
        oi, oj = np.argsort(i), np.argsort(j)
        if link == "dot":
            p = np.clip(x[oi] @ y[oj].T, 1e-6, 1 - 1e-6)
        else:
            u, v = x[oi, :-1], y[oj, :-1]
            far = np.sqrt(np.maximum((u * u).sum(1)[:, None] - 2 * u @ v.T + (v * v).sum(1), 0))
            p = 1 / (1 + np.exp(-((x[oi, -1][:, None] + y[oj, -1]) / 2 - far)))
        t = np.zeros(p.shape, bool)
        t[np.searchsorted(i[oi], three["node"].to_numpy(dtype=np.int64)), np.searchsorted(j[oj], three["j"].to_numpy(dtype=np.int64))] = True
        if own and key[len(by)] == key[len(by) + 1]:
            once = i[oi][:, None] < j[oj]
            p, t = p[once], t[once]
        else:
            p, t = p.ravel(), t.ravel()
        inside = (p > 0) & (p < 1)
        q = np.where(inside, p, 0.5)
        place = np.clip(((np.log(q) - np.log1p(-q)) / (2 * REACH) + 0.5) * BINS, 0, BINS - 1).astype(np.int64)
        return p, t, inside, q, np.where(inside, place, np.where(p <= 0, 0, BINS - 1))

    def count(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = scores(key, pdf)
        if found is None or not len(found[0]):
            return pd.DataFrame({c: [] for c in [*by, "bin", "pos", "neg", "sse", "deviance"]})
        p, t, inside, q, place = found
        pos, neg = np.bincount(place[t], minlength=BINS), np.bincount(place[~t], minlength=BINS)
        some = np.flatnonzero(pos + neg)
        out = pd.DataFrame({**{c: key[k] for k, c in enumerate(by)}, "bin": some, "pos": pos[some].astype(float), "neg": neg[some].astype(float), "sse": 0.0, "deviance": 0.0})
        out.loc[0, ["sse", "deviance"]] = [float(((t - p) ** 2).sum()), float(np.where(inside, -np.where(t, np.log(q), np.log1p(-q)), 0).sum())]
        return out

    def refine(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found, lists = scores(key, pdf), pdf[pdf["kind"] == 3]["x"]
        empty = pd.DataFrame({c: [] for c in [*by, "phat", "pos", "neg"]})
        if found is None or not len(lists):
            return empty
        p, t, _, _, place = found
        mixed = np.zeros(BINS, bool)
        mixed[np.asarray(lists.iloc[0], dtype=np.int64)] = True
        some = mixed[place]
        if not some.any():
            return empty
        at, spot = np.unique(np.round(p[some], 12), return_inverse=True)
        n, pos = np.bincount(spot, minlength=len(at)), np.bincount(spot, t[some], minlength=len(at))
        return pd.DataFrame({**{c: key[k] for k, c in enumerate(by)}, "phat": at, "pos": pos.astype(float), "neg": n - pos})

    def listed(key, pdf: pd.DataFrame) -> pd.DataFrame:
        found = scores(key, pdf)
        p, t = (found[0], found[1]) if found else (np.zeros(0), np.zeros(0))
        return pd.DataFrame({**{c: [key[k]] * len(p) for k, c in enumerate(by)}, "y": np.asarray(t, float), "phat": p})

    others = [x for x in losses if x not in TILED]
    if others:
        pairs = rows.groupBy(*on).applyInPandas(listed, f"{key_schema}, y double, phat double").groupBy(*by).agg(*[LOSSES[x](F.col("y"), F.col("phat")).cast("double").alias(x) for x in others])
        more = pairs.select(*by, F.explode(F.array(*[F.struct(F.lit(x).alias("loss"), F.col(x).alias("value")) for x in others])).alias("v")).select(*by, "v.loss", "v.value")
        if len(others) == len(losses):
            return more
        return more.unionByName(_tile_losses(rows, on, by, link, own, exact, tuple(x for x in losses if x in TILED)))
    sums = written(rows.groupBy(*on).applyInPandas(count, f"{key_schema}, bin long, pos double, neg double, sse double, deviance double"), "tiles")
    parts = {"l2": F.sqrt(F.sum("sse")), "sse": F.sum("sse"), "mse": F.sum("sse") / F.sum(F.col("pos") + F.col("neg")), "deviance": F.sum("deviance"), "loglik": F.sum("deviance")}
    parts = {x: parts[x] for x in losses if x != "auc"}
    long = None
    if parts:
        plain = sums.groupBy(*by).agg(*[v.alias(x) for x, v in parts.items()])
        long = plain.select(*by, F.explode(F.array(*[F.struct(F.lit(x).alias("loss"), F.col(x).alias("value")) for x in parts])).alias("v")).select(*by, "v.loss", "v.value")
    if "auc" not in losses:
        return long
    bins = written(sums.groupBy(*by, "bin").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "tile-bins")
    middle = 1 / (1 + F.exp(-((F.col("bin") + 0.5) / BINS - 0.5) * (2 * REACH)))
    points = bins.select(*by, middle.alias("phat"), "pos", "neg")
    if exact:
        mixed = bins.where("pos > 0 and neg > 0").groupBy(*by).agg(F.collect_list(F.col("bin").cast("double")).alias("x"))  # BINS at most
        spots = rows.select(*on).distinct().join(F.broadcast(mixed), by).select(*on, F.lit(3).alias("kind"), F.lit(None).cast("long").alias("node"), F.lit(None).cast("long").alias("j"), "x")
        fine = rows.unionByName(spots).groupBy(*on).applyInPandas(refine, f"{key_schema}, phat double, pos double, neg double")
        fine = fine.groupBy(*by, F.round("phat", 12).alias("phat")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        points = points.where("not (pos > 0 and neg > 0)").unionByName(fine)
    ranks = auc_loss(points, tuple(by)).select(*by, F.lit("auc").alias("loss"), "value")
    return ranks if long is None else long.unionByName(ranks)


def tiled_pair_loss(left: DataFrame, right: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("rep", "cand"), link: str = "dot", tile: int = 1000, exact: bool = True, losses: tuple[str, ...] = ("l2", "deviance", "auc")) -> DataFrame:
    """keys, p, q, loss, value: the named losses over all pairs (i in fold p, j in fold q > p).

    left, right: keys, sub, node, x. Link "dot" predicts the clamped product of x_i and x_j (a degree-corrected block model is
    psi_i B[g_i, .] against psi_j e(g_j)); "latent" predicts logistic(b - |x_i - x_j|) with b the last entries' mean.
    held: rep, p, q, i, j. Nodes are dealt to tiles of about `tile` by hash; a tile pair is one group of bounded size, and
    only sums, bin counts and the scores of mixed bins leave it. Neither nodes nor pairs are collected. Without `exact`, the
    AUC is exact up to the width of a bin.
    """
    largest = left.groupBy(*keys, "sub").count().agg(F.max("count")).first()[0] or 1
    n = -(-largest // tile)
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    subs = [r[0] for r in left.select("sub").distinct().orderBy("sub").collect()]
    above = F.create_map(*[x for p in subs for x in (F.lit(p), F.array(*[F.lit(q) for q in subs if q > p]).cast("array<int>"))])
    below = F.create_map(*[x for q in subs for x in (F.lit(q), F.array(*[F.lit(p) for p in subs if p < q]).cast("array<int>"))])
    every = F.sequence(F.lit(0), F.lit(n - 1))
    empty = F.lit(None)
    a = left.select(*keys, F.col("sub").alias("p"), F.explode(F.element_at(above, F.col("sub"))).alias("q"), spot("node").alias("ti"), "node", "x").select("*", F.explode(every).alias("tj"))
    b = right.select(*keys, F.col("sub").alias("q"), F.explode(F.element_at(below, F.col("sub"))).alias("p"), spot("node").alias("tj"), "node", "x").select("*", F.explode(every).alias("ti"))
    groups = left.select(*keys).distinct()
    e = held.join(groups, [c for c in keys if c in held.columns]).select(*keys, "p", "q", spot("i").alias("ti"), spot("j").alias("tj"), "i", "j")
    on = [*keys, "p", "q", "ti", "tj"]
    rows = (
        a.select(*on, F.lit(0).alias("kind"), "node", empty.cast("long").alias("j"), "x")
        .unionByName(b.select(*on, F.lit(1).alias("kind"), "node", empty.cast("long").alias("j"), "x"))
        .unionByName(e.select(*on, F.lit(2).alias("kind"), F.col("i").alias("node"), "j", empty.cast("array<double>").alias("x")))
    )
    return _tile_losses(rows, on, [*keys, "p", "q"], link, False, exact, tuple(losses))


def tiled_own_loss(left: DataFrame, right: DataFrame, held: DataFrame, keys: tuple[str, ...] = ("fold", "cand"), tile: int = 1000, exact: bool = True) -> DataFrame:
    """keys, loss, value: sse, loglik and auc over all pairs i < j of the nodes of a group, phat the clamped product of x_i (left) and x_j
    (right), which is symmetric. left, right: keys, node, x; held: some of keys, src, dst. Tiles as in `tiled_pair_loss`, each pair of
    tiles once."""
    largest = left.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    n = -(-largest // tile)
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    a = left.select(*keys, spot("node").alias("ti"), "node", "x").select("*", F.explode(F.sequence("ti", F.lit(n - 1))).alias("tj"))
    b = right.select(*keys, spot("node").alias("tj"), "node", "x").select("*", F.explode(F.sequence(F.lit(0), "tj")).alias("ti"))
    groups = left.select(*keys).distinct()
    e = held.join(groups, [c for c in keys if c in held.columns]).withColumns({"s": spot("src"), "d": spot("dst")})
    first = (F.col("s") < F.col("d")) | ((F.col("s") == F.col("d")) & (F.col("src") < F.col("dst")))
    e = e.select(*keys, F.least("s", "d").alias("ti"), F.greatest("s", "d").alias("tj"), F.when(first, F.col("src")).otherwise(F.col("dst")).alias("node"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("j"))
    on, none = [*keys, "ti", "tj"], F.lit(None)
    rows = (
        a.select(*on, F.lit(0).alias("kind"), "node", none.cast("long").alias("j"), "x")
        .unionByName(b.select(*on, F.lit(1).alias("kind"), "node", none.cast("long").alias("j"), "x"))
        .unionByName(e.select(*on, F.lit(2).alias("kind"), "node", "j", none.cast("array<double>").alias("x")))
    )
    return _tile_losses(rows, on, list(keys), "dot", True, exact, ("sse", "loglik", "auc"))


def dcbm_vectors(labels: DataFrame, blocks: DataFrame, theta: DataFrame, keys: tuple[str, ...] = ("rep", "cand")) -> tuple[DataFrame, DataFrame]:
    """(left, right) for `tiled_pair_loss`: psi_i times the label's row of blocks, and psi_j at the label's place."""
    rows = blocks.groupBy(*keys, F.col("k").alias("g")).agg(F.transform(F.array_sort(F.collect_list(F.struct("l", "b"))), lambda c: c["b"]).alias("row"))
    met = labels.join(theta, [*keys, "node"])
    left = met.join(rows, [*keys, "g"]).select(*keys, "sub", "node", F.transform("row", lambda b: b * F.col("psi")).alias("x"))
    size = rows.select(*keys, "g", F.size("row").alias("m"))
    spot = lambda i: F.when(i == F.col("g"), F.col("psi")).otherwise(0.0)
    right = met.join(size, [*keys, "g"]).select(*keys, "sub", "node", F.transform(F.sequence(F.lit(1), F.col("m")), spot).alias("x"))
    return left, right


def tile_matvec(block: DataFrame, edges: DataFrame, entries, tile: int = 2000) -> DataFrame:
    """node, y (and piece, if `block` has it): dense symmetric matrices, never stored, times the columns x (array) of `block` (node, x,
    parameters of nodes), one matrix a piece.

    `entries(a, b, linked)` gives the entries between the rows `a` and `b` of `block` from their parameters and from which of
    them are linked. A tile holds some `tile` rows and columns; n * n / tile rows a piece are shuffled, for all pieces at once.
    """
    keys = ["piece"] if "piece" in block.columns else []
    sizes = block.groupBy(*keys).agg(F.count("*").alias("n"), F.max(F.size("x")).alias("w")).collect()  # a row a piece
    parts, width = max([1, *(-(-r["n"] // tile) for r in sizes)]), max([0, *(r["w"] or 0 for r in sizes)])
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    rows = block.select(part("node").alias("p"), every.alias("q"), F.lit(0).alias("side"), *block.columns)
    columns = block.select(every.alias("p"), part("node").alias("q"), F.lit(1).alias("side"), *block.columns)
    links = arcs(edges.select("src", "dst")).select(part("src").alias("p"), part("dst").alias("q"), "src", "dst")
    if keys:
        links = links.select(F.explode(F.array(*[F.lit(r["piece"]).cast(dict(block.dtypes)["piece"]) for r in sizes])).alias("piece"), "*") if sizes else links.select(F.lit(0).alias("piece"), "*")
    on = [*keys, "p", "q"]

    def product(both: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        both = both.sort_values("node")
        a, b = both[both["side"] == 0], both[both["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in (*keys, "node", "y")}, dtype=object)
        linked = np.zeros((len(a), len(b)))
        linked[np.searchsorted(a["node"], found["src"]), np.searchsorted(b["node"], found["dst"])] = 1.0
        return pd.DataFrame({**{c: a[c] for c in keys}, "node": a["node"], "y": list(entries(a, b, linked) @ np.stack(b["x"]))})

    types = dict(block.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), f"node {types['node']}, y array<double>"])
    products = rows.unionByName(columns).groupBy(*on).cogroup(links.groupBy(*on)).applyInPandas(product, schema)
    return products.groupBy(*keys, "node").agg(F.array(*[F.sum(F.col("y")[i]) for i in range(width)]).alias("y"))


def tile_eigenpairs(params: DataFrame, edges: DataFrame, entries, k: int, dense: int = 2500, tile: int = 2000, **options) -> tuple[DataFrame, dict[int, tuple[list[float], list[float]]]]:
    """(piece, node, x; piece -> eigenvalues and residuals): the k eigenpairs of largest magnitude of the matrices of `tile_matvec`.

    params: piece, node and what `entries` needs. Pieces of `dense` nodes at most are solved in a task each; larger ones by the
    rounds of `leading_eigenpairs` (its options), each a product in tiles that serves all pieces.
    """
    types, sizes = dict(params.dtypes), {r["piece"]: r["n"] for r in params.groupBy("piece").agg(F.count("*").alias("n")).collect()}  # a row a piece
    if not sizes:
        return params.select("piece", "node", F.array().cast("array<double>").alias("x")), {}
    if max(sizes.values()) <= dense:
        links = arcs(edges.select("src", "dst")).select(F.explode(F.array(*[F.lit(p).cast(types["piece"]) for p in sizes])).alias("piece"), "src", "dst")

        def solve(key, nodes: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            nodes = nodes.sort_values("node")
            linked = np.zeros((len(nodes), len(nodes)))
            linked[np.searchsorted(nodes["node"], found["src"]), np.searchsorted(nodes["node"], found["dst"])] = 1.0
            a = entries(nodes, nodes, linked)
            values, vectors = np.linalg.eigh(a)
            order = by_magnitude(values)[:k]
            left = np.linalg.norm(a @ vectors[:, order] - vectors[:, order] * values[order], axis=0)
            return pd.DataFrame({"piece": key[0], "node": nodes["node"], "x": list(largest_positive(vectors[:, order])), "v": [values[order]] * len(nodes), "r": [left] * len(nodes)})

        schema = f"piece {types['piece']}, node {types['node']}, x array<double>, v array<double>, r array<double>"
        out = written(params.groupBy("piece").cogroup(links.groupBy("piece")).applyInPandas(solve, schema), "tile-vectors")
        first = out.groupBy("piece").agg(F.first("v").alias("v"), F.first("r").alias("r")).collect()  # a row a piece
        return out.select("piece", "node", "x"), {r["piece"]: (list(r["v"]), list(r["r"])) for r in first}

    def multiply(table: DataFrame, xs: list[str], ys: list[str]) -> DataFrame:
        block = params.join(table.select("piece", "node", F.array(*xs).alias("x")), ["piece", "node"])
        found = tile_matvec(block, edges, entries, tile)
        return table.join(found, ["piece", "node"]).withColumns({y: F.get("y", F.lit(i)) for i, y in enumerate(ys)}).drop("y")

    return leading_eigenpairs(params.select("piece", "node", F.lit(1.0).alias("f")), None, {}, k, dense=0, multiply=multiply, **options)
