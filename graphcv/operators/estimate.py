"""Block-model estimates as grouped aggregations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphcv.sources.shared import small, written


def label_sizes(labels: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, k, n_k."""
    return labels.groupBy(*keys, F.col("g").alias("k")).agg(F.count("*").alias("n_k"))


def full_grid(groups: DataFrame, keys: tuple[str, ...], size: str = "cand") -> DataFrame:
    """keys, k, l for all labels 1..size of every group."""
    some = groups.select(*keys).distinct().withColumn("k", F.explode(F.sequence(F.lit(1), F.col(size).cast("int"))))
    return some.withColumn("l", F.explode(F.sequence(F.lit(1), F.col(size).cast("int"))))


def block_sums(edges: DataFrame, labels: DataFrame, keys: tuple[str, ...], edge_keys: tuple[str, ...] | None = None, size: str = "cand") -> DataFrame:
    """keys, k, l, s: edge ends between labels, all size x size cells; an edge inside a label counts twice.

    edges: edge_keys (some of `keys`), src, dst. Each edge is joined once, with all the labels of its ends, and counted in both orders by aggregation.
    """
    edge_keys = keys if edge_keys is None else edge_keys
    rest = [c for c in keys if c not in edge_keys]
    each = written(labels.groupBy(*edge_keys, "node").agg(F.array_sort(F.collect_list(F.struct(*rest, "g"))).alias("all")), "ends")
    wide = 64 * (2 + len(rest))
    a, b = each.select(*edge_keys, F.col("node").alias("src"), F.col("all").alias("one")), each.select(*edge_keys, F.col("node").alias("dst"), F.col("all").alias("two"))
    met = edges.select(*edge_keys, "src", "dst").join(small(a, wide), [*edge_keys, "src"]).join(small(b, wide), [*edge_keys, "dst"])
    pairs = met.groupBy(*edge_keys, "one", "two").agg(F.count("*").alias("n"))  # a row for each two lists of labels
    pairs = pairs.select(*edge_keys, "n", F.explode("one").alias("a"), "two")
    same = lambda y: reduce(lambda s, t: s & t, [y[c] == F.col(f"a.{c}") for c in rest], F.lit(True))
    once = pairs.select(*edge_keys, "n", "a", F.explode(F.filter("two", same)).alias("b")).select(*[F.col(f"a.{c}").alias(c) if c in rest else F.col(c) for c in keys], F.col("a.g").alias("k"), F.col("b.g").alias("l"), "n")
    once = once.groupBy(*keys, "k", "l").agg(F.sum("n").alias("n"))
    both = once.unionByName(once.select(*keys, F.col("l").alias("k"), F.col("k").alias("l"), "n")).groupBy(*keys, "k", "l").agg(F.sum("n").alias("s"))
    return full_grid(labels, keys, size).join(both, [*keys, "k", "l"], "left").select(*keys, "k", "l", F.coalesce("s", F.lit(0)).cast("long").alias("s"))


def _with_sizes(sums: DataFrame, sizes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    met = sums.join(sizes.withColumnRenamed("n_k", "nk"), [*keys, "k"], "left").join(sizes.withColumnsRenamed({"k": "l", "n_k": "nl"}), [*keys, "l"], "left")
    return met.na.fill(0, ["nk", "nl"])


def sbm_blocks(sums: DataFrame, sizes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, k, l, b: link probabilities; pairs of a node with itself are left out; what is not finite is 1e-6."""
    s, nk, nl = F.col("s").cast("double"), F.col("nk"), F.col("nl")
    b = F.when(F.col("k") == F.col("l"), F.try_divide(s, nk * (nk - 1))).otherwise(F.try_divide(s, nk * nl))
    return _with_sizes(sums, sizes, keys).select(*keys, "k", "l", F.coalesce(b, F.lit(1e-6)).alias("b"))


def dcbm_fit(sums: DataFrame, labels: DataFrame, degree: DataFrame, keys: tuple[str, ...], degree_keys: tuple[str, ...] | None = None, share: float = 1.0, eps: float = 1e-4, size: str = "cand", one_eps: float = 1e-3, omitted: bool = True):
    """(blocks, theta): keys, k, l, b = sum + eps over `share`; keys, node, psi = degree over the row sum of its label.

    With one label eps is `one_eps`, and psi is 1e-4 more unless some nodes are `omitted` from it.
    """
    degree_keys = keys if degree_keys is None else degree_keys
    one = F.col(size) == 1
    plus = F.col("s") + F.when(one, one_eps).otherwise(eps)
    blocks = sums.select(*keys, "k", "l", (plus / share).alias("b"))
    rows = sums.select(*keys, "k", plus.alias("b")).groupBy(*keys, "k").agg(F.sum("b").alias("row"))
    met = labels.select(*keys, "node", F.col("g").alias("k")).join(rows, [*keys, "k"]).join(degree, [*degree_keys, "node"])
    more = F.when(one, 0.0 if omitted else 1e-4).otherwise(0.0)
    return blocks, met.select(*keys, "node", (F.col("degree") / F.col("row") + more).alias("psi"))


def dcbm_eigen_fit(sums: DataFrame, labels: DataFrame, norms: DataFrame, keys: tuple[str, ...]):
    """(blocks, theta): psi is the norm of a node's row of singular vectors (keys.., node, psi); b = sum / (Psi_k Psi_l)."""
    on = [c for c in keys if c in norms.columns] + ["node"]
    theta = labels.join(norms, on).select(*keys, "node", "g", "psi")
    mass = theta.groupBy(*keys, F.col("g").alias("k")).agg(F.sum("psi").alias("n_k"))
    b = F.try_divide(F.col("s").cast("double"), F.col("nk") * F.col("nl"))
    return _with_sizes(sums, mass, keys).select(*keys, "k", "l", F.coalesce(b, F.lit(0.0)).alias("b")), theta.select(*keys, "node", "psi")


def average_blocks(blocks: DataFrame, s: int, keys: tuple[str, ...] = ("rep", "model", "cand")) -> DataFrame:
    """keys, k, l, b: the sum over pieces divided by `s`."""
    return blocks.groupBy(*keys, "k", "l").agg((F.sum("b") / s).alias("b"))


def role_counts(tagged: DataFrame, labels: DataFrame, folds: DataFrame, keys: tuple[str, ...] = ("fold", "cand")) -> DataFrame:
    """keys, k, l, e11, e12: edge ends inside the training nodes (ordered), and edges from a training node of label k to a
    held-out node of label l. tagged: fold, src, dst, part; labels: keys, node, g; folds: node, fold."""
    own = folds.withColumnRenamed("fold", "own")
    near = labels.join(own, "node").withColumn("held", F.col("own") == F.col("fold"))
    a = near.select(*keys, F.col("node").alias("src"), F.col("g").alias("k"), F.col("held").alias("h1"))
    b = near.select(*keys, F.col("node").alias("dst"), F.col("g").alias("l"), F.col("held").alias("h2"))
    met = tagged.where("part <> 'held'").join(a, ["fold", "src"]).join(b, [*keys, "dst"])
    train = met.where("part = 'train'").groupBy(*keys, "k", "l").agg(F.count("*").alias("n"))
    e11 = train.unionByName(train.select(*keys, F.col("l").alias("k"), F.col("k").alias("l"), "n")).groupBy(*keys, "k", "l").agg(F.sum("n").alias("e11"))
    cross = met.where("part = 'cross'").select(*keys, F.when(F.col("h1"), F.col("l")).otherwise(F.col("k")).alias("k"), F.when(F.col("h1"), F.col("k")).otherwise(F.col("l")).alias("l"))
    e12 = cross.groupBy(*keys, "k", "l").agg(F.count("*").alias("e12"))
    grid = full_grid(labels, keys)
    return grid.join(e11, [*keys, "k", "l"], "left").join(e12, [*keys, "k", "l"], "left").na.fill(0, ["e11", "e12"])


def role_mass(labels: DataFrame, folds: DataFrame, keys: tuple[str, ...] = ("fold", "cand"), weight: Column | None = None) -> DataFrame:
    """keys, k, m1, m2: how many training and held-out nodes a label has, or the sums of their weights."""
    near = labels.join(folds.withColumnRenamed("fold", "own"), "node")
    w = F.lit(1) if weight is None else weight
    held = F.col("own") == F.col("fold")
    return near.groupBy(*keys, F.col("g").alias("k")).agg(F.sum(F.when(held, 0).otherwise(w)).alias("m1"), F.sum(F.when(held, w).otherwise(0)).alias("m2"))


def own_block_counts(inside: DataFrame, labels: DataFrame, folds: DataFrame, keys: tuple[str, ...] = ("fold", "cand")) -> DataFrame:
    """keys, edge, k, l, n (k <= l): all pairs inside the held-out fold (edge = 0), a product of label sizes, and their edges (edge = 1,
    from inside: fold, src, dst)."""
    sizes = labels.join(folds.select("fold", "node"), ["fold", "node"]).groupBy(*keys, F.col("g").alias("k")).agg(F.count("*").alias("m"))
    pairs = sizes.join(sizes.withColumnsRenamed({"k": "l", "m": "m2"}), list(keys)).where("k <= l")
    n = F.when(F.col("k") == F.col("l"), F.shiftright(F.col("m") * (F.col("m") - 1), 1)).otherwise(F.col("m") * F.col("m2"))
    a, b = (labels.select(*keys, F.col("node").alias(end), F.col("g").alias(name)) for end, name in (("src", "g1"), ("dst", "g2")))
    met = inside.join(a, ["fold", "src"]).join(b, [*keys, "dst"]).groupBy(*keys, F.least("g1", "g2").alias("k"), F.greatest("g1", "g2").alias("l")).agg(F.count("*").alias("n"))
    return pairs.select(*keys, F.lit(0).alias("edge"), "k", "l", n.alias("n")).unionByName(met.select(*keys, F.lit(1).alias("edge"), "k", "l", "n"))


def _ncv(counts: DataFrame, mass: DataFrame, keys: tuple[str, ...], inside: Column, eps: float = 1.0) -> DataFrame:
    other = counts.select(*keys, F.col("k").alias("l"), F.col("l").alias("k"), F.col("e12").alias("e21"))
    met = counts.join(other, [*keys, "k", "l"]).join(mass.withColumnsRenamed({"m1": "k1", "m2": "k2"}), [*keys, "k"], "left")
    met = met.join(mass.withColumnsRenamed({"k": "l", "m1": "l1", "m2": "l2"}), [*keys, "l"], "left").na.fill(0, ["k1", "k2", "l1", "l2"])
    c = F.col
    across = F.try_divide(c("e11") + c("e12") + c("e21") + eps, c("k1") * c("l1") + c("l1") * c("k2") + c("k1") * c("l2") + eps)
    same = F.try_divide(c("e11") / 2 + c("e12") + eps, inside)
    return met.select(*keys, "k", "l", F.when(c("k") == c("l"), same).otherwise(across).alias("b"))


def ncv_sbm_blocks(counts: DataFrame, mass: DataFrame, keys: tuple[str, ...] = ("fold", "cand")) -> DataFrame:
    """keys, k, l, b from training and cross edges, one added to both numbers."""
    c = F.col
    return _ncv(counts, mass, keys, c("k1") * (c("k1") - 1) / 2 + c("k1") * c("k2") + 1)


def ncv_dcbm_blocks(counts: DataFrame, labels: DataFrame, folds: DataFrame, psi: DataFrame, keys: tuple[str, ...] = ("fold", "cand")) -> DataFrame:
    """As `ncv_sbm_blocks` with sums of psi (some of keys, node, psi) for counts; on the diagonal the squares of all nodes' psi are taken
    off. With one label it is the density of the corrected model."""
    met = labels.join(psi, [*[c for c in keys if c in psi.columns], "node"])
    mass = role_mass(met, folds, keys, F.col("psi"))
    squares = met.groupBy(*keys).agg(F.sum(F.col("psi") * F.col("psi")).alias("squares"))
    c = F.col
    return _ncv(counts.join(squares, list(keys)), mass, keys, c("k1") * c("k1") / 2 + c("k1") * c("k2") - c("squares") + 1)


def ncv_dcbm_degree_fit(tagged: DataFrame, labels: DataFrame, keys: tuple[str, ...] = ("fold", "cand")):
    """(blocks, theta) with the held-out block missing: b = sum + 0.01, psi = observed degree over the column sum."""
    seen = tagged.where("part <> 'held'").select("fold", "src", "dst")
    return _missing_fit(seen, labels, keys, 1.0)


def _missing_fit(seen: DataFrame, labels: DataFrame, keys: tuple[str, ...], share: float):
    from graphcv.operators.graph import degrees

    sums = written(block_sums(seen, labels, keys, ("fold",)), "sums")
    degree = degrees(labels.select("fold", "node").distinct(), seen, ("fold",))
    return dcbm_fit(sums, labels, degree, keys, ("fold",), share, 0.01, one_eps=0.01)


def ecv_sbm_blocks(seen: DataFrame, holdout: DataFrame | None, labels: DataFrame, keys: tuple[str, ...] = ("fold", "cand"), counts: DataFrame | None = None) -> DataFrame:
    """keys, k, l, b = (sum + 1) / (observed ordered pairs + 1), without the diagonal of the matrix. The held-out pairs are given as a
    list (fold, src, dst), or as `counts` of them by labels: keys, k <= l, n."""
    sums, sizes = block_sums(seen, labels, keys, ("fold",)), label_sizes(labels, keys)
    if counts is None:
        gone = block_sums(holdout, labels, keys, ("fold",)).withColumnRenamed("s", "gone")
    else:
        both = counts.select(*keys, "k", "l", "n").unionByName(counts.select(*keys, F.col("l").alias("k"), F.col("k").alias("l"), "n"))
        gone = both.groupBy(*keys, "k", "l").agg(F.sum("n").alias("gone"))
    met = _with_sizes(sums.join(gone, [*keys, "k", "l"], "left").na.fill(0, ["gone"]), sizes, keys)
    cells = F.col("nk") * F.col("nl") - F.when(F.col("k") == F.col("l"), F.col("nk")).otherwise(0) - F.col("gone")
    return met.select(*keys, "k", "l", ((F.col("s") + 1) / (cells + 1)).alias("b"))


def ecv_dcbm_fit(seen: DataFrame, labels: DataFrame, share: float, keys: tuple[str, ...] = ("fold", "cand")):
    """(blocks, theta) from observed edges: b = (sum + 0.01) / share, psi = observed degree over the column sum of sums."""
    return _missing_fit(seen, labels, keys, share)


def pair_density(seen: DataFrame, holdout: DataFrame | None, n: int, held: dict[int, int] | None = None) -> DataFrame:
    """fold, b: (ordered edges + 1) / (observed ordered pairs + 1), clamped: the one-block fit of pair hold-out. The held-out pairs are given
    as a list (fold, src, dst), or by `held`, their number by fold."""
    from graphcv.functions.columns import clamp

    e = seen.groupBy("fold").agg(F.count("*").alias("e"))
    if held is None:
        h = holdout.groupBy("fold").agg(F.count("*").alias("h"))
    else:
        h = seen.sparkSession.createDataFrame([(f, m) for f, m in held.items() if m], "fold int, h long")
    return h.join(e, "fold", "left").select("fold", clamp((2 * F.coalesce("e", F.lit(0)) + 1) / (F.lit(float(n)) * (n - 1) - 2 * F.col("h") + 1)).alias("b"))


def node_density(tagged: DataFrame, folds: DataFrame) -> DataFrame:
    """fold, b: ordered training edges over the squared number of training nodes, clamped: the one-block fit of node hold-out."""
    from graphcv.functions.columns import clamp

    n = folds.count()
    held = folds.groupBy("fold").agg((F.lit(n) - F.count("*")).alias("train"))
    e = tagged.where("part = 'train'").groupBy("fold").agg(F.count("*").alias("e"))
    return held.join(e, "fold", "left").select("fold", clamp(F.try_divide(2.0 * F.coalesce("e", F.lit(0)), F.col("train") * F.col("train"))).alias("b"))


def scale_within_group(theta: DataFrame, by: tuple[str, ...], value: str = "psi") -> DataFrame:
    """`theta` with the value divided by its largest in the group; groups meet their maximum by aggregation."""
    most = theta.groupBy(*by).agg(F.max(value).alias("_most"))
    return theta.join(most, list(by)).withColumn(value, F.try_divide(value, "_most")).drop("_most")
