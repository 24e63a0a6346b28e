"""Losses of predicted links: pair by pair, and in closed form from counts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphcv.functions.columns import clamp, deviance
from graphcv.sources.shared import small, written

#: Loss name to an aggregate over the columns y (0 or 1) and phat.
LOSSES: dict[str, Callable[[Column, Column], Column]] = {
    "l2": lambda y, p: F.sqrt(F.sum((y - p) * (y - p))),
    "sse": lambda y, p: F.sum((y - p) * (y - p)),
    "mse": lambda y, p: F.avg((y - p) * (y - p)),
    "deviance": lambda y, p: F.sum(deviance(y, p)),
    "loglik": lambda y, p: F.sum(deviance(y, clamp(p))),
}


def register_loss(name: str, fn: Callable[[Column, Column], Column]) -> None:
    """Add a loss: `fn` takes the columns y and phat and gives an aggregate (built-in functions, or a grouped-agg pandas UDF)."""
    LOSSES[name] = fn


def pair_losses(scores: DataFrame, keys: tuple[str, ...], losses: list[str]) -> DataFrame:
    """keys, loss, value for the named losses, "auc" included; one pass for all that are plain aggregates."""
    y, p = F.col("y").cast("double"), F.col("phat")
    plain = [x for x in losses if x != "auc"]
    out = []
    if plain:
        wide = scores.groupBy(*keys).agg(*[LOSSES[x](y, p).alias(x) for x in plain])
        out.append(wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("loss"), F.col(x).alias("value")) for x in plain])).alias("v")).select(*keys, "v.loss", "v.value"))
    if "auc" in losses:
        points = scores.groupBy(*keys, F.round("phat", 12).alias("phat")).agg(F.sum("y").cast("double").alias("pos"), (F.count("*") - F.sum("y")).cast("double").alias("neg"))
        out.append(auc_loss(points, keys).select(*keys, F.lit("auc").alias("loss"), "value"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def auc_loss(points: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, value: minus the AUC from counts of edges and others (pos, neg) at each score phat; ties (to 12 digits) take the mean rank;
    null if one kind is absent. Scores are first cut into ranges, so that no group's scores are sorted as a whole."""
    cut = F.floor(F.greatest(F.least("phat", F.lit(1.0)), F.lit(0.0)) * 4096)
    ranged = points.withColumn("_range", cut)
    starts = ranged.groupBy(*keys, "_range").agg(F.sum("neg").alias("_neg"))
    starts = starts.withColumn("_below", F.coalesce(F.sum("_neg").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_neg")
    inner = F.coalesce(F.sum("neg").over(Window.partitionBy(*keys, "_range").orderBy("phat").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = ranged.withColumn("_inner", inner).join(starts, [*keys, "_range"])
    area = F.sum(F.col("pos") * (F.col("_below") + F.col("_inner") + F.col("neg") / 2))
    return placed.groupBy(*keys).agg((-F.try_divide(area, F.sum("pos") * F.sum("neg"))).alias("value"))


def held_ends(held: DataFrame, table: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """keys, p, q, a, b: every held-out edge (rep, p, q, i, j) in every group of keys, with the structs of `columns` of both ends. table:
    keys, node and columns. A node's groups travel as one array, so an edge is joined twice for all of them."""
    first = [c for c in keys if c in held.columns]
    rest = [c for c in keys if c not in first]
    each = table.groupBy(*first, "node").agg(F.array_sort(F.collect_list(F.struct(*rest, *columns))).alias("all"))
    each, wide = written(each, "ends"), 64 * (1 + len(rest) + len(columns))
    a, b = each.select(*first, F.col("node").alias("i"), F.col("all").alias("one")), each.select(*first, F.col("node").alias("j"), F.col("all").alias("two"))
    met = held.join(small(a, wide), [*first, "i"]).join(small(b, wide), [*first, "j"]).select(*first, "p", "q", F.explode("one").alias("a"), "two")
    same = lambda y: reduce(lambda s, t: s & t, [y[c] == F.col(f"a.{c}") for c in rest], F.lit(True))
    both = met.select(*first, "p", "q", "a", F.explode(F.filter("two", same)).alias("b"))
    return both.select(*[F.col(f"a.{c}").alias(c) if c in rest else F.col(c) for c in keys], "p", "q", "a", "b")


def fold_classes(labels: DataFrame, theta: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, sub, g, psi, n: how many nodes of a fold have a label and a psi. A psi that is a degree over a sum of its label takes fewer than
    2 sqrt(E) values for E edges, so all pairs of them are fewer than 4 E."""
    return labels.select(*keys, "sub", "node", "g").join(theta.select(*keys, "node", "psi"), [*keys, "node"]).groupBy(*keys, "sub", "g", "psi").agg(F.count("*").alias("n"))


def class_pairs(classes: DataFrame, blocks: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, p, q, k, psi, n1, n2, phat: the clamped b psi_i psi_j of n1 * n2 pairs, of all pairs of `fold_classes` of folds p < q."""
    folds = classes.select(*keys, "sub").distinct()
    over = folds.withColumnRenamed("sub", "p").join(folds.withColumnRenamed("sub", "q"), list(keys)).where("p < q")
    left = classes.select(*keys, F.col("sub").alias("p"), F.col("g").alias("k"), "psi", F.col("n").alias("n1")).join(over, [*keys, "p"]).join(blocks.select(*keys, "k", "l", "b"), [*keys, "k"])
    right = classes.select(*keys, F.col("sub").alias("q"), F.col("g").alias("l"), F.col("psi").alias("v"), F.col("n").alias("n2"))
    return left.join(right, [*keys, "q", "l"]).select(*keys, "p", "q", "k", "psi", "n1", "n2", clamp(F.col("b") * F.col("psi") * F.col("v")).alias("phat"))


def blockwise_points(held: DataFrame, labels: DataFrame, blocks: DataFrame, theta: DataFrame, keys: tuple[str, ...] = ("rep", "model", "cand")) -> DataFrame:
    """keys, p, q, phat, pos, neg: held-out edges and other pairs of every block by the corrected model's clamped prediction. No pair is
    made: nodes are counted by label and psi (`fold_classes`), edges by those of both ends."""
    pairs = class_pairs(fold_classes(labels, theta, keys), blocks, keys)
    pairs = pairs.select(*keys, "p", "q", "phat", F.lit(0).cast("long").alias("e"), (F.col("n1") * F.col("n2")).alias("n"))
    both = labels.select(*keys, "node", "g").join(theta.select(*keys, "node", "psi"), [*keys, "node"])
    ends = held_ends(held, both, keys, ("g", "psi")).groupBy(*keys, "p", "q", F.col("a.g").alias("k"), F.col("b.g").alias("l"), F.col("a.psi").alias("u"), F.col("b.psi").alias("v")).agg(F.count("*").alias("e"))
    edges = ends.join(blocks.select(*keys, "k", "l", "b"), [*keys, "k", "l"])
    edges = edges.select(*keys, "p", "q", clamp(F.col("b") * F.col("u") * F.col("v")).alias("phat"), "e", F.lit(0).cast("long").alias("n"))
    return pairs.unionByName(edges).groupBy(*keys, "p", "q", "phat").agg(F.sum("e").cast("double").alias("pos"), (F.sum("n") - F.sum("e")).cast("double").alias("neg"))


def own_points(inside: DataFrame, nodes: DataFrame, kinds: DataFrame, blocks: DataFrame, keys: tuple[str, ...] = ("fold", "cand")) -> DataFrame:
    """keys, phat, pos, neg: edges and other pairs inside a group's nodes by their clamped b psi_i psi_j. inside: fold, src, dst; nodes: keys,
    node, g, psi; kinds: keys, g, psi, m, how many nodes have a label and psi; blocks: keys, k, l, b, symmetric."""
    one, two = (kinds.select(*keys, F.struct("g", "psi").alias(c), F.col("m").alias(f"m{c}")) for c in "uv")
    same = F.col("u") == F.col("v")
    n = F.when(same, F.shiftright(F.col("mu") * (F.col("mu") - 1), 1)).otherwise(F.col("mu") * F.col("mv"))
    pairs = one.join(two, list(keys)).where(F.col("u") <= F.col("v")).select(*keys, "u", "v", F.lit(0).cast("long").alias("e"), n.alias("n"))
    a, b = (nodes.select(*keys, F.col("node").alias(end), F.struct("g", "psi").alias(c)) for end, c in (("src", "x"), ("dst", "y")))
    met = inside.join(small(a, 96), ["fold", "src"]).join(small(b, 96), [*keys, "dst"])
    ends = met.groupBy(*keys, F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).agg(F.count("*").alias("e")).select(*keys, "u", "v", "e", F.lit(0).cast("long").alias("n"))
    both = pairs.unionByName(ends).groupBy(*keys, "u", "v").agg(F.sum("e").alias("e"), F.sum("n").alias("n"))
    scored = both.join(blocks.select(*keys, F.col("k").alias("kk"), F.col("l").alias("ll"), "b"), [*keys]).where("kk = u.g and ll = v.g")
    points = scored.select(*keys, clamp(F.col("b") * F.col("u.psi") * F.col("v.psi")).alias("phat"), "e", "n")
    return points.groupBy(*keys, "phat").agg(F.sum("e").cast("double").alias("pos"), (F.sum("n") - F.sum("e")).cast("double").alias("neg"))


def point_losses(points: DataFrame, keys: tuple[str, ...], losses: list[str]) -> DataFrame:
    """keys, loss, value: l2, sse, mse, deviance, loglik and auc from counts of edges and others (pos, neg) at each score phat."""
    p, pos, neg = F.col("phat"), F.col("pos"), F.col("neg")
    sse = F.sum(pos * (1 - p) * (1 - p) + neg * p * p)
    parts = {"l2": F.sqrt(sse), "sse": sse, "mse": sse / F.sum(pos + neg)}
    for name, q in (("deviance", p), ("loglik", clamp(p))):
        parts[name] = F.sum(pos * deviance(F.lit(1.0), q) + neg * deviance(F.lit(0.0), q))
    out = []
    if plain := [x for x in losses if x != "auc"]:
        wide = points.groupBy(*keys).agg(*[parts[x].alias(x) for x in plain])
        out.append(wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(x).alias("loss"), F.col(x).alias("value")) for x in plain])).alias("v")).select(*keys, "v.loss", "v.value"))
    if "auc" in losses:
        ties = points.groupBy(*keys, F.round("phat", 12).alias("phat")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        out.append(auc_loss(ties, keys).select(*keys, F.lit("auc").alias("loss"), "value"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def blockwise_counts(held: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("rep", "model", "cand")) -> DataFrame:
    """keys, p, q, k, l, e, n: held-out edges and pairs of every block by labels. held: rep, p, q, i, j; labels: keys, sub, node, g
    of fold nodes. No pair is made: n is a product of label counts."""
    sizes = labels.groupBy(*keys, "sub", "g").agg(F.count("*").alias("n"))
    left = sizes.select(*keys, F.col("sub").alias("p"), F.col("g").alias("k"), F.col("n").alias("n1"))
    right = sizes.select(*keys, F.col("sub").alias("q"), F.col("g").alias("l"), F.col("n").alias("n2"))
    grid = left.join(right, list(keys)).where("p < q")
    edges = held_ends(held, labels, keys, ("g",)).groupBy(*keys, "p", "q", F.col("a.g").alias("k"), F.col("b.g").alias("l")).agg(F.count("*").alias("e"))
    met = grid.join(edges, [*keys, "p", "q", "k", "l"], "left")
    return met.select(*keys, "p", "q", "k", "l", F.coalesce("e", F.lit(0)).cast("double").alias("e"), (F.col("n1") * F.col("n2")).cast("double").alias("n"))


def blockwise_sbm_loss(counts: DataFrame, blocks: DataFrame, keys: tuple[str, ...] = ("rep", "model", "cand")) -> DataFrame:
    """keys, p, q, loss, value: l2, deviance and auc of every held-out block in closed form from `blockwise_counts`."""
    met = counts.join(blocks.select(*keys, "k", "l", "b"), [*keys, "k", "l"])
    e, n, b = F.col("e"), F.col("n"), F.col("b")
    sums = met.groupBy(*keys, "p", "q").agg(F.sqrt(F.sum(e * (1 - b) * (1 - b) + (n - e) * b * b)).alias("l2"), F.sum(F.when((b <= 0) | (b >= 1), 0.0).otherwise(-e * F.log(b) - (n - e) * F.log(1 - b))).alias("deviance"))
    long = sums.select(*keys, "p", "q", F.explode(F.array(*[F.struct(F.lit(x).alias("loss"), F.col(x).alias("value")) for x in ("l2", "deviance")])).alias("v")).select(*keys, "p", "q", "v.loss", "v.value")
    points = met.groupBy(*keys, "p", "q", F.round("b", 12).alias("phat")).agg(F.sum("e").alias("pos"), F.sum(n - e).alias("neg"))
    return long.unionByName(auc_loss(points, (*keys, "p", "q")).select(*keys, "p", "q", F.lit("auc").alias("loss"), "value"))
