"""Cross-validation jobs: number of communities, degree correction, rank, dimension, regularisation, consensus labels."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphcv.functions.columns import clamp, norm
from graphcv.operators import choose as A
from graphcv.operators import estimate as M
from graphcv.operators import labels as L
from graphcv.operators import loss as S
from graphcv.operators import split as P
from graphcv.operators.cluster import cluster_labels, graph_labels, spectral_labels
from graphcv.operators.graph import arcs, degrees, isolated_labels
from graphcv.operators.krylov import leading_eigenpairs
from graphcv.operators.latent import fit_latent
from graphcv.operators.pairs import PairSplit, held_losses
from graphcv.operators.spectral import adjacency_embedding, each_tau_eigenvectors, fold_row_svd, graph_eigenvectors, procrustes_align, sub_eigenvectors
from graphcv.operators.tiles import dcbm_vectors, tile_eigenpairs, tile_matvec, tiled_own_loss, tiled_pair_loss
from graphcv.sources.shared import written

KEYS = ("rep", "cand")
PIECE = ("rep", "cand", "sub")
LOSSES = ("l2", "deviance", "auc")
#: Held-out nodes of a fold with so many different labels and psi at most are paired by those instead of in tiles.
KINDS = 1000


class Overlap:
    """One overlapping split of a graph, shared by all candidates."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, s: int, o: int, reps: int, seed: int = 42):
        self.nodes, self.edges, self.s, self.n = nodes, edges, s, nodes.count()
        self.partition = written(P.overlap_partition(nodes, o, s, reps, seed, self.n), "partition")
        self.members = written(P.sub_members(self.partition, s), "members")
        placed = written(P.placed_edges(edges, self.partition), "placed")
        self.pieces, self.held = P.sub_edges(placed, s), P.test_edges(placed)
        self.degrees = degrees(self.members, self.pieces, ("rep", "sub"))

    def labels(self, cands: list[int], corrected: bool, tau: float, laplace: bool, scale: str = "graph", method: str = "kmeans", lone: bool = False) -> DataFrame:
        """rep, cand, sub, node, shared, g, every piece aligned to the first. With `lone`, and tau = 0, only nodes with edges in their
        piece are clustered; the others get seeded labels."""
        if lone and tau == 0:
            some = self.degrees.where("degree > 0").select("rep", "sub", "node")
            found = spectral_labels(some, self.pieces, cands, corrected, tau, laplace, scale=scale, n_graph=self.n, method=method)
            for c in cands:
                found = found.unionByName(isolated_labels(self.degrees, c, keys=("rep", "sub")).select("rep", "sub", F.lit(c).alias("cand"), "node", "g"))
        else:
            found = spectral_labels(self.members, self.pieces, cands, corrected, tau, laplace, scale=scale, n_graph=self.n, method=method)
        return written(L.align_subs(found.join(self.members, ["rep", "sub", "node"]), KEYS), "aligned")

    def sums(self, labels: DataFrame) -> DataFrame:
        return written(M.block_sums(self.pieces, labels, PIECE, ("rep", "sub")), "sums")

    def sbm_losses(self, labels: DataFrame, losses: tuple[str, ...] = LOSSES, clamped: bool = False) -> DataFrame:
        """From counts of held-out edges and pairs by labels; a loss that counts do not give is taken in tiles."""
        blocks = M.average_blocks(M.sbm_blocks(self.sums(labels), M.label_sizes(labels, PIECE), PIECE), self.s, KEYS)
        if set(losses) <= set(LOSSES):
            blocks = blocks.withColumn("b", clamp(F.col("b"))) if clamped else blocks
            found = S.blockwise_sbm_loss(S.blockwise_counts(self.held, labels.where(~F.col("shared")), KEYS), blocks, KEYS).where(F.col("loss").isin(*losses))
        else:
            own = labels.where(~F.col("shared")).select(*PIECE, "node", "g")
            left, right = dcbm_vectors(own, blocks, own.select(*KEYS, "node", F.lit(1.0).alias("psi")), KEYS)
            found = tiled_pair_loss(left, right, self.held, KEYS, losses=losses)
        return A.rep_loss(found, self.s, keys=(*KEYS, "loss")).withColumn("model", F.lit("sbm"))

    def norms(self, k: int, cands: list[int]) -> DataFrame:
        """rep, sub, cand, node, psi: norms of the rows of every piece's leading eigenvectors (adjacency), for the eigen fit."""
        found = written(sub_eigenvectors(self.members, self.pieces, k), "norms")
        return found.withColumn("cand", F.explode(F.array(*map(F.lit, cands)))).select(*PIECE, "node", norm(F.slice("x", 1, F.col("cand"))).alias("psi"))

    def dcbm_losses(self, labels: DataFrame, losses: tuple[str, ...] = LOSSES, norms: DataFrame | None = None) -> DataFrame:
        """Degrees over block sums, or with `norms` the eigen fit."""
        if norms is None:
            blocks, theta = M.dcbm_fit(self.sums(labels), labels, self.degrees, PIECE, ("rep", "sub"))
        else:
            blocks, theta = M.dcbm_eigen_fit(self.sums(labels), labels, norms, PIECE)
        own = labels.where(~F.col("shared")).select(*PIECE, "node", "g")
        psi = theta.join(own.select(*PIECE, "node"), [*PIECE, "node"]).select(*KEYS, "node", "psi")
        left, right = dcbm_vectors(own, M.average_blocks(blocks, self.s, KEYS), psi, KEYS)
        return A.rep_loss(tiled_pair_loss(left, right, self.held, KEYS, losses=losses), self.s, keys=(*KEYS, "loss")).withColumn("model", F.lit("dcbm"))


def _by_cand(cands: list, one) -> DataFrame:
    return reduce(DataFrame.unionByName, [one(c) for c in cands])


def overlap_cv_blockmodel(
    nodes: DataFrame, edges: DataFrame, cands: list[int], s: int, o: int, reps: int, tau: float = 0.0, laplace: bool = False, labels: DataFrame | None = None, losses: tuple[str, ...] = LOSSES, method: str = "kmedoids", dc_est: int = 2
) -> tuple[DataFrame, DataFrame]:
    """(losses, choices): the block model and its number of communities. choices: loss, choice over reps.

    labels: supplied labels of the pieces (rep, cand, sub, node, shared, g), for both models; without them they are fitted.
    dc_est: 2 fits the corrected model by degrees, another by eigenvectors. losses may name registered ones.
    """
    cut = Overlap(nodes, edges, s, o, reps)
    if labels is not None:
        plain = corrected = written(L.align_subs(labels, KEYS), "aligned")
    else:
        plain, corrected = (cut.labels(cands, c, tau, laplace, method=method) for c in (False, True))
    found = cut.sbm_losses(plain, losses).unionByName(cut.dcbm_losses(corrected, losses, None if dc_est == 2 else cut.norms(max(cands), cands)))
    found = written(found.select("rep", "model", "cand", "loss", "value"), "losses")
    return found, A.mode_over_reps(A.choose_model(found))


def overlap_cv_rank(nodes: DataFrame, edges: DataFrame, cands: list[int], s: int, o: int, reps: int, laplace: bool = False, losses: tuple[str, ...] = LOSSES, positions: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(losses, choices): the rank of a random-dot-product model; pieces are aligned at the largest rank and then cut. positions: supplied
    aligned ones (rep, sub, node, x); without them they are fitted. losses may name registered ones."""
    cut = Overlap(nodes, edges, s, o, reps)
    if positions is None:
        positions = procrustes_align(adjacency_embedding(cut.members, cut.pieces, max(cands), laplace), cut.partition.where("sub = 0"))
    own = written(positions, "positions").join(cut.partition.where("sub > 0"), ["rep", "sub", "node"])
    each = own.withColumn("cand", F.explode(F.array(*[F.lit(c) for c in cands]))).withColumn("x", F.slice("x", 1, F.col("cand")))
    found = written(A.rep_loss(tiled_pair_loss(each, each, cut.held, KEYS, losses=losses), s, keys=(*KEYS, "loss")), "losses")
    best = A.argmin_candidate(found, ("rep", "loss"))
    return found, A.mode_over_reps(best, ("loss",), "cand")


def overlap_cv_latent(nodes: DataFrame, edges: DataFrame, cands: list[int], s: int, o: int, reps: int, losses: tuple[str, ...] = LOSSES) -> tuple[DataFrame, DataFrame]:
    """(losses, choices): the dimension of a latent-distance model. losses may name registered ones."""
    cut = Overlap(nodes, edges, s, o, reps)
    found = written(fit_latent(cut.members, cut.pieces, cands), "latent")
    parts = []
    for c in cands:
        moved = procrustes_align(found.where(F.col("cand") == c).drop("cand", "beta"), cut.partition.where("sub = 0"), True)
        level = found.where(F.col("cand") == c).select("rep", "sub", "node", "beta")
        parts.append(moved.join(level, ["rep", "sub", "node"]).select("rep", F.lit(c).alias("cand"), "sub", "node", F.array_append("x", F.col("beta")).alias("x")))
    own = [written(p.join(cut.partition.where("sub > 0"), ["rep", "sub", "node"]), "positions") for p in parts]
    tiles = reduce(DataFrame.unionByName, [tiled_pair_loss(x, x, cut.held, KEYS, "latent", losses=losses) for x in own])
    found = written(A.rep_loss(tiles, s, keys=(*KEYS, "loss")), "losses")
    return found, A.mode_over_reps(A.argmin_candidate(found, ("rep", "loss")), ("loss",), "cand")


def tune_tau_by_loss(nodes: DataFrame, edges: DataFrame, k: int, taus: list[float], s: int, o: int, reps: int, corrected: bool = True, laplace: bool = True, dc_est: int = 2, losses: tuple[str, ...] = LOSSES, labels: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(losses, choices): losses by tau, and for each loss the mean over reps of the best tau. Predictions of both models are clamped.

    labels: supplied labels of the pieces (tau, rep, cand, sub, node, shared, g); without them they are fitted. dc_est: 2 fits the
    corrected model by degrees, another by eigenvectors. losses may name registered ones.
    """
    cut, norms = Overlap(nodes, edges, s, o, reps), None

    def one(tau):
        nonlocal norms
        if labels is None:
            own = cut.labels([k], corrected, tau, laplace, "piece", lone=True)
        else:
            own = written(L.align_subs(labels.where(F.col("tau") == F.lit(float(tau))).drop("tau"), KEYS), "aligned")
        if not corrected:
            return cut.sbm_losses(own, losses, True).withColumn("tau", F.lit(float(tau)))
        if dc_est != 2 and norms is None:
            norms = cut.norms(k, [k])
        return cut.dcbm_losses(own, losses, norms).withColumn("tau", F.lit(float(tau)))

    found = written(_by_cand(taus, one).select("rep", "tau", "loss", "value"), "losses")
    return found, A.mean_over_reps(A.argmin_candidate(found, ("rep", "loss"), "tau"), ("loss",), "tau")


def each_tau_labels(nodes: DataFrame, edges: DataFrame, k: int, taus: list[float], laplace: bool = True, corrected: bool = False, scale: str = "piece", lone: bool = True) -> DataFrame:
    """tau, node, g of the whole graph at every tau, all taus solved in the same rounds. With `lone`, at tau = 0 only nodes with edges are
    clustered; the others get seeded labels."""
    taus = [float(t) for t in taus]
    found, _ = each_tau_eigenvectors(nodes, edges, k, taus, laplace, scale, lone=not lone)
    labels = fold_labels(written(found.withColumnRenamed("piece", "fold"), "tau-vectors"), [k], corrected)
    named = labels.select(F.element_at(F.array(*map(F.lit, taus)), F.col("fold") + 1).alias("tau"), "node", "g")
    if lone and 0.0 in taus:
        named = named.unionByName(isolated_labels(degrees(nodes, edges), k).select(F.lit(0.0).alias("tau"), "node", "g"))
    return written(named, "graph-labels")


def whole_graph_labels(nodes: DataFrame, edges: DataFrame, k: int, tau: float, laplace: bool = True, corrected: bool = False) -> DataFrame:
    """node, g of the whole graph at one tau. At tau = 0 only nodes with edges are clustered; the others get seeded labels."""
    return each_tau_labels(nodes, edges, k, [tau], laplace, corrected).select("node", "g")


def clipped(a, b, linked):
    """Entries l_i . r_j in [0, 1]; a and b have l and r (arrays)."""
    return np.clip(np.stack(a["l"]) @ np.stack(b["r"]).T, 0.0, 1.0)


def clipped_laplacian(a, b, linked):
    """The clipped entries and the constant c, scaled by fh on both sides."""
    return np.outer(a["fh"], b["fh"]) * (clipped(a, b, linked) + a["c"].to_numpy()[:, None])


def laplacian_gap(a, b, linked):
    """The distance of the graph's regularised Laplacian (scale f) from the fitted one."""
    return np.abs(np.outer(a["f"], b["f"]) * (linked + a["c"].to_numpy()[:, None]) - clipped_laplacian(a, b, linked))


def row_sums(params: DataFrame, edges: DataFrame, entries) -> DataFrame:
    """piece, node, total: sums of the rows of the matrices of `tile_matvec`."""
    return tile_matvec(params.withColumn("x", F.array(F.lit(1.0))), edges, entries).select("piece", "node", F.col("y")[0].alias("total"))


def spectral_gap_tau(nodes: DataFrame, edges: DataFrame, k: int, taus: list[float], corrected: bool = True, dc_fit: str = "degree", labels: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(ratios: tau, value; choice: tau, value): the largest singular value of abs(L - Lhat) over the k-th eigenvalue of Lhat, per
    tau, and the tau of the least ratio. L is the regularised Laplacian, Lhat that of the fitted model, both with the constant
    tau dbar / n in entries and degrees; nodes without weight have zeros. A zero eigenvalue gives null, ranked last. `labels`
    (tau, node, g) replace the fitted ones. All taus are solved in the same rounds, a product in tiles serving all of them
    (options: see `tile_eigenpairs`).
    """
    taus = [float(t) for t in taus]
    degree = written(degrees(nodes, edges), "degrees")
    n, mean = degree.agg(F.count("*"), F.avg("degree")).first()
    if labels is None:
        labels = each_tau_labels(nodes, edges, k, taus, True, corrected, "dk", lone=False)
    number = F.element_at(F.create_map(*[x for i, t in enumerate(taus) for x in (F.lit(t), F.lit(i))]), F.col("tau"))
    own = labels.where(F.col("tau").isin(*taus)).select(number.alias("rep"), F.lit(k).alias("cand"), F.lit(1).alias("sub"), "node", "g")
    own = written(own, "gap-labels")
    sums = written(M.block_sums(edges, own, PIECE, ()), "sums")
    if not corrected:
        blocks, theta = M.sbm_blocks(sums, M.label_sizes(own, PIECE), PIECE), own.select(*PIECE, "node", F.lit(1.0).alias("psi"))
    elif dc_fit == "eigen":
        blocks, theta = M.dcbm_eigen_fit(sums, own, graph_eigenvectors(nodes, edges, k)[0].select("node", norm("x").alias("psi")), PIECE)
    else:
        blocks, theta = M.dcbm_fit(sums, own, degree, PIECE, (), omitted=False)
    left, right = dcbm_vectors(own, blocks.drop("sub"), theta.drop("sub"), KEYS)
    both = left.select("rep", "node", F.col("x").alias("l")).join(right.select("rep", "node", F.col("x").alias("r")), ["rep", "node"])
    const = F.element_at(F.array(*[F.lit(t * (mean or 0.0) / max(1, n)) for t in taus]), F.col("piece") + 1)
    both = written(both.join(degree, "node").withColumnRenamed("rep", "piece").withColumn("c", const), "gap-vectors")
    scale = lambda d: F.when(F.col(d) + F.col("c") > 0, 1 / F.sqrt(F.col(d) + F.col("c"))).otherwise(0.0)
    met = both.join(row_sums(both, edges, clipped), ["piece", "node"])
    params = written(met.select("piece", "node", "l", "r", "c", scale("degree").alias("f"), scale("total").alias("fh")), "gap-params")
    top, low = tile_eigenpairs(params, edges, laplacian_gap, 1, **options)[1], tile_eigenpairs(params, edges, clipped_laplacian, k, **options)[1]
    ratios = [(t, abs(top[i][0][0] / low[i][0][-1]) if len(low[i][0]) == k and abs(low[i][0][-1]) > 1e-12 else None) for i, t in enumerate(taus) if i in top]
    found = edges.sparkSession.createDataFrame(ratios, "tau double, value double")  # a row for each tau
    return found, A.argmin_candidate(found, (), "tau")


def refit_at_mean_tau(nodes: DataFrame, edges: DataFrame, k: int, choices: DataFrame, truth: DataFrame, laplace: bool = True, corrected: bool = False) -> DataFrame:
    """loss, mean_tau, accuracy: the whole graph labelled anew at the mean tau of each loss (choices: loss, mean_tau), against the
    truth (node, g). Losses with one mean are labelled once."""
    means = {}
    for r in choices.select("loss", "mean_tau").collect():  # a row a loss
        means.setdefault(float(r["mean_tau"]), []).append(r["loss"])
    labels = each_tau_labels(nodes, edges, k, sorted(means), laplace, corrected)
    found = L.label_accuracy(labels, truth, ("tau",))
    return _by_cand(sorted(means), lambda tau: found.where(F.col("tau") == tau).select(F.explode(F.array(*map(F.lit, means[tau]))).alias("loss"), F.col("tau").alias("mean_tau"), "accuracy"))


def tune_tau_by_agreement(nodes: DataFrame, edges: DataFrame, k: int, taus: list[float], s: int, o: int, reps: int, corrected: bool = False, laplace: bool = True, losses: tuple[str, ...] = ("nmi", "hamming"), labels: DataFrame | None = None, whole: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(losses, choices): minus the NMI ("nmi") and the share of differing ("hamming") pair codes between piece labels and
    whole-graph labels, summed over fold pairs, and the mean over reps of the best tau.

    labels, whole: supplied labels of the pieces (tau, rep, cand, sub, node, shared, g) and of the whole graph (tau, node, g, and cand
    if it matters); without them they are fitted, the whole graph's for all taus at once.
    """
    cut = Overlap(nodes, edges, s, o, reps) if labels is None else None
    whole = each_tau_labels(nodes, edges, k, taus, laplace, corrected) if whole is None else whole
    kinds = {"nmi": L.pair_nmi_loss, "hamming": L.pair_hamming_loss}

    def one(tau):
        at = F.col("tau") == F.lit(float(tau))
        own = cut.labels([k], corrected, tau, laplace, "piece", lone=True) if labels is None else written(L.align_subs(labels.where(at).drop("tau"), KEYS), "aligned")
        counts = written(L.fold_confusion(own, whole.where(at).drop("tau"), KEYS), "fold-confusion")
        return reduce(DataFrame.unionByName, [kinds[x](counts, KEYS).select("rep", F.lit(float(tau)).alias("tau"), "p", "q", F.lit(x).alias("loss"), "value") for x in losses])

    found = written(A.rep_loss(_by_cand(taus, one), s, "sum", ("rep", "tau", "loss")), "losses")
    return found, A.mean_over_reps(A.argmin_candidate(found, ("rep", "loss"), "tau"), ("loss",), "tau")


def consensus_labels(nodes: DataFrame, edges: DataFrame, k: int, tau: float, s: int, o: int, reps: int, laplace: bool = False, corrected: bool = False, aligned: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """cand, node, g: piece labels stitched in each rep, reps aligned to the first unless told otherwise, and the majority over reps.
    labels: supplied labels of the pieces (rep, cand, sub, node, shared, g); without them they are fitted."""
    if labels is None:
        pieces = Overlap(nodes, edges, s, o, reps).labels([k], corrected, tau, laplace, "piece", lone=True)
    else:
        pieces = L.align_subs(labels, KEYS)
    stitched = written(L.combine_labels(pieces, KEYS), "stitched")
    stitched = L.align_reps(stitched, ("cand",)) if aligned else stitched
    return L.majority_label(stitched, ("cand",))


def lowrank_impute(nodes: DataFrame, observed: DataFrame, pairs: DataFrame, k: int, share: float) -> DataFrame:
    """pairs (src, dst, y) with cand = 1..k and phat: entries of the rank-cand approximation of the zero-filled matrix over `share`."""
    found, values, _ = graph_eigenvectors(nodes, observed, k)
    scaled = found.select("node", F.array(*[F.element_at("x", c + 1) * (v / share) for c, v in enumerate(values)]).alias("sx"), "x")
    met = pairs.join(scaled.select(F.col("node").alias("src"), "sx"), "src").join(scaled.select(F.col("node").alias("dst"), "x"), "dst")
    each = met.withColumn("cand", F.explode(F.sequence(F.lit(1), F.lit(len(values)))))
    part = F.aggregate(F.zip_with(F.slice("sx", 1, F.col("cand")), F.slice("x", 1, F.col("cand")), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return each.select("src", "dst", "y", "cand", part.alias("phat"))


def fold_eigenvectors(split: PairSplit, k: int) -> tuple[DataFrame, dict[int, list[float]]]:
    """(fold, node, x; fold -> eigenvalues) of the observed edges of every fold, all folds in the same rounds."""
    rows = split.places.select(F.explode(F.sequence(F.lit(1), F.lit(split.folds))).alias("piece"), "node", F.lit(1.0).alias("f"))
    found, solved = leading_eigenpairs(rows, written(arcs(split.seen.withColumnRenamed("fold", "piece")), "seen-arcs"), {}, k)
    return written(found.withColumnRenamed("piece", "fold"), "fold-vectors"), {f: v for f, (v, _) in solved.items()}


def imputed_vectors(found: DataFrame, values: dict[int, list[float]], share: float, edges: DataFrame, tau: float, cands: list[int], **options) -> DataFrame:
    """fold, cand, node, x: leading eigenvectors of D^-1/2 (A + tau dbar / n) D^-1/2 for the imputed A of every fold and rank: the
    low-rank matrix over `share`, clipped to [0, 1], dbar its mean row sum. A is computed in tiles and never stored."""
    scale = F.create_map(*[x for f, v in values.items() for x in (F.lit(f), F.array(*[F.lit(float(e) / share) for e in v]))])
    each = found.select("fold", "node", F.explode(F.array(*map(F.lit, cands))).alias("cand"), "x", F.zip_with("x", F.element_at(scale, F.col("fold")), lambda u, e: u * e).alias("sx"))
    piece = F.col("fold") * (max(cands) + 1) + F.col("cand")
    parts = written(each.select(piece.cast("int").alias("piece"), "fold", "cand", "node", F.slice("sx", F.lit(1), F.col("cand")).alias("l"), F.slice("x", F.lit(1), F.col("cand")).alias("r")), "imputed")
    none = edges.limit(0)
    sums = written(parts.join(row_sums(parts, none, clipped), ["piece", "node"]), "imputed-sums")
    stats = sums.groupBy("piece").agg((tau * F.avg("total") / F.count("*")).alias("c"), F.count("*").alias("n"))
    heavy = F.col("total") + F.col("c") * F.col("n")
    params = sums.join(F.broadcast(stats), "piece").select("piece", "node", "l", "r", "c", F.when(heavy > 0, 1 / F.sqrt(heavy)).otherwise(0.0).alias("fh"))
    vectors, _ = tile_eigenpairs(written(params, "imputed-params"), none, clipped_laplacian, max(cands), **options)
    return vectors.join(parts.select("piece", "fold", "cand").distinct(), "piece").select("fold", "cand", "node", F.slice("x", F.lit(1), F.col("cand")).alias("x"))


def pair_cv_rank(nodes: DataFrame, edges: DataFrame, max_k: int, folds: int = 3, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(losses, choices): the rank by imputation of held-out pairs: sse, mse and auc by candidate.

    Held-out pairs are drawn by number (`PairSplit`); entries of the low-rank matrices are made for them alone.
    """
    split = PairSplit(nodes, edges, share, folds)
    found, values = fold_eigenvectors(split, max_k)
    k = min(max_k, *(len(v) for v in values.values())) if values else max_k
    scale = F.create_map(*[x for f, v in values.items() for x in (F.lit(f), F.array(*[F.lit(float(e) / split.seen_share) for e in v]))])
    table = found.select("fold", "node", "x", F.zip_with("x", F.element_at(scale, F.col("fold")), lambda u, e: u * e).alias("sx"))

    def score(a, b):
        part = lambda c: F.aggregate(F.zip_with(F.slice(a["sx"], 1, c), F.slice(b["x"], 1, c), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
        return F.array(*[F.struct(F.lit(c).alias("cand"), part(c).alias("phat")) for c in range(1, k + 1)])

    found = written(held_losses(split.scored(table, ["x", "sx"], score), ("fold", "cand"), ["sse", "mse", "auc"]), "fold-losses")
    losses = A.fold_loss(found, keys=("cand", "loss"))
    return losses, A.argmin_candidate(losses, ("loss",))


def fold_labels(found: DataFrame, cands: list[int], normalize: bool, most: int = 200_000) -> DataFrame:
    """fold, cand, node, g from the first entries of x (fold, node, x): a fold is clustered in one task where it has `most` nodes at
    most, else by the library's distributed k-means."""
    largest = found.groupBy("fold").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return cluster_labels(found, cands, ("fold",), normalize)
    each = []
    for f in [r[0] for r in found.select("fold").distinct().collect()]:  # a row a fold
        for c in cands:
            own = found.where(F.col("fold") == f).select("node", F.slice("x", 1, c).alias("x"))
            each.append(graph_labels(own, c, normalize).select(F.lit(f).alias("fold"), F.lit(c).alias("cand"), "node", F.col("g").cast("int").alias("g")))
    return reduce(DataFrame.unionByName, each)


def pair_cv_blockmodel(nodes: DataFrame, edges: DataFrame, max_k: int, folds: int = 3, share: float = 0.1, cv: int | None = None, labels: DataFrame | None = None, dc_est: int = 2, tau: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(losses, choices): block model and number of communities by held-out pairs; each pair counts twice in sums.

    With tau > 0, two and more communities are those of the regularised Laplacian of the imputed matrix (`imputed_vectors`).

    Pairs are held out in `folds` draws of a `share`, or with `cv` in as many folds that cover all pairs. Both models are scored by
    counts of held-out pairs and edges between classes of nodes of equal labels and psi (`class_counts`), of which there are few. With
    one community the corrected model's squared error is that of the density. labels: supplied (fold, cand, node, g) for
    both models. losses: model, cand, loss, value. dc_est: 2 alone (degrees over block sums).
    """
    if dc_est != 2:
        raise ValueError("pair hold-out has the degree fit (dc_est = 2) alone")
    split, keys = PairSplit(nodes, edges, share, folds, cv), ("fold", "cand")
    seen = split.seen
    if labels is not None:
        plain = corrected = written(labels.select(*keys, "node", "g"), "labels")
    else:
        found, values = fold_eigenvectors(split, max_k)
        cands = list(range(1, max_k + 1))
        if tau > 0 and max_k > 1:
            bent = written(imputed_vectors(found, values, split.seen_share, edges, tau, cands[1:]), "imputed-vectors")
            fit = lambda c: reduce(DataFrame.unionByName, [fold_labels(found, [1], c), *(fold_labels(bent.where(F.col("cand") == k), [k], c) for k in cands[1:])])
        else:
            fit = lambda c: fold_labels(found, cands, c)
        plain, corrected = (written(fit(c), "labels") for c in (False, True))
    each, theta = M.ecv_dcbm_fit(seen, corrected, split.seen_share)
    both = plain.join(corrected.withColumnRenamed("g", "h"), [*keys, "node"]).join(theta, [*keys, "node"])
    kinds = written(both.groupBy(*keys, "g", "h", "psi").agg(F.count("*").alias("m")), "kinds")  # psi: a degree over a sum of its label
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("g", "h", "psi")) - 1
    kinds = written(kinds.select(*keys, "g", "h", "psi", place.alias("c")), "kinds")
    own = written(both.join(kinds, [*keys, "g", "h", "psi"]).select(*keys, "node", "c"), "classes")
    one, two = (kinds.select(*keys, *[F.col(x).alias(f"{x}{i}") for x in ("g", "h", "psi")], F.col("c").alias(end)) for i, end in ((1, "c"), (2, "d")))
    paired = written(split.class_counts(own).join(one, [*keys, "c"]).join(two, [*keys, "d"]), "held-classes")
    counts = written(paired.groupBy(*keys, "edge", F.least("g1", "g2").alias("k"), F.greatest("g1", "g2").alias("l")).agg(F.sum("n").alias("n")), "held-counts")
    blocks = written(M.ecv_sbm_blocks(seen, None, plain, keys, counts.where("edge = 0")), "blocks")
    sbm = held_losses(counts.join(blocks.withColumnRenamed("b", "phat"), [*keys, "k", "l"]), keys, ["sse", "loglik", "auc"], "n")
    met = paired.join(each.select(*keys, F.col("k").alias("h1"), F.col("l").alias("h2"), "b"), [*keys, "h1", "h2"])
    scores = met.select(*keys, "edge", "n", (F.col("b") * F.col("psi1") * F.col("psi2")).alias("phat"))
    dcbm = held_losses(scores, keys, ["sse", "loglik", "auc"], "n")
    density = counts.where("cand = 1").join(blocks.select(*keys, "k", "l", clamp(F.col("b")).alias("phat")), [*keys, "k", "l"])
    dcbm = dcbm.where("cand > 1 or loss <> 'sse'").unionByName(held_losses(density, keys, ["sse"], "n"))
    found = written(sbm.withColumn("model", F.lit("sbm")).unionByName(dcbm.withColumn("model", F.lit("dcbm"))), "fold-losses")
    twice = found.withColumn("value", F.col("value") * F.when(F.col("loss") == "auc", 1).otherwise(2))
    losses = written(A.fold_loss(twice, ("loglik",)), "losses")
    return losses, A.choose_model(losses, ("loss",))


def node_cv_blockmodel(nodes: DataFrame, edges: DataFrame, max_k: int, cv: int = 3, labels: DataFrame | None = None, dc_est: int = 1, corrected_labels: DataFrame | None = None, psi: DataFrame | None = None, tile: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(losses, choices): block model and number of communities by node folds: what training rows say of pairs inside the fold held out.

    The block model comes from training and cross edges, with one community from the training edges' density. The corrected one
    (dc_est = 1) has the clusters of normalised rows and psi, the rows' norms over the largest; with dc_est = 2 it has the
    block model's clusters, and degrees over block sums, but for one community. labels, corrected_labels: supplied (fold,
    cand, node, g); psi: supplied (fold, cand, node, psi); what is not supplied is fitted, for all folds at once. Held-out pairs are
    never listed: the block model's are counted by labels, the corrected one's by labels and psi if those are few (KINDS), else scored in
    tiles. losses: model, cand, loss, value.
    """
    keys, cands = ("fold", "cand"), list(range(1, max_k + 1))
    folds = written(P.node_folds(nodes, cv), "folds")
    tagged = written(P.node_holdout_edges(edges, folds, cv), "tagged")
    if labels is None:
        found, _ = fold_row_svd(folds, edges, max_k, cv, 0.001)
        labels = fold_labels(found, cands, False)
    plain = written(labels.select(*keys, "node", "g"), "node-labels")
    if psi is None or (corrected_labels is None and dc_est == 1):
        rows = written(fold_row_svd(folds, edges, max_k, cv, 0.0)[0], "row-vectors")
        if psi is None:
            sizes = rows.withColumn("cand", F.explode(F.array(*map(F.lit, cands)))).select(*keys, "node", norm(F.slice("x", 1, F.col("cand"))).alias("psi"))
            psi = M.scale_within_group(sizes, keys)
        if corrected_labels is None and dc_est == 1:
            corrected_labels = fold_labels(rows, cands, True)
    corrected = written(corrected_labels.select(*keys, "node", "g"), "corrected-labels") if dc_est == 1 else plain
    psi = written(psi.select(*keys, "node", "psi"), "psi")

    roles = written(M.role_counts(tagged, plain, folds), "roles")
    density = M.node_density(tagged, folds).select("fold", F.lit(1).alias("cand"), F.lit(1).alias("k"), F.lit(1).alias("l"), "b")
    blocks = M.ncv_sbm_blocks(roles, M.role_mass(plain, folds)).where("cand > 1").unionByName(density)
    inside = tagged.where("part = 'held'").select("fold", "src", "dst")
    counts = M.own_block_counts(inside, plain, folds)
    sbm = held_losses(counts.join(blocks.withColumn("phat", clamp(F.col("b"))), [*keys, "k", "l"]), keys, ["sse", "loglik", "auc"], "n")

    own = lambda table: table.join(folds.select("fold", "node"), ["fold", "node"])
    one = F.lit(True) if dc_est == 1 else F.col("cand") == 1  # where the corrected model is that of psi
    bent = M.ncv_dcbm_blocks(written(M.role_counts(tagged, corrected, folds), "roles") if dc_est == 1 else roles, corrected, folds, psi).where(one)
    weights = psi.where(one)
    if dc_est != 1:
        more, theta = M.ncv_dcbm_degree_fit(tagged, plain)
        bent, weights = bent.unionByName(more.where(~one)), weights.unionByName(theta.where(~one))
    bent = bent.withColumn("b", F.coalesce("b", F.lit(0.0)))  # no pairs of these labels were seen: clamped, as in SQL
    held = own(corrected).withColumn("sub", F.col("fold"))
    sized = written(held.join(own(weights), [*keys, "node"]).select(*keys, "node", "g", "psi"), "held-nodes")
    kinds = written(sized.groupBy(*keys, "g", "psi").agg(F.count("*").alias("m")), "kinds")
    if (kinds.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= KINDS:
        dcbm = S.point_losses(written(S.own_points(inside, sized, kinds, bent, keys), "points"), keys, ["sse", "loglik", "auc"])
    else:
        left, right = dcbm_vectors(held, bent, own(weights), keys)
        dcbm = tiled_own_loss(left.drop("sub"), right.drop("sub"), inside, keys, tile)
    found = written(sbm.withColumn("model", F.lit("sbm")).unionByName(dcbm.withColumn("model", F.lit("dcbm"))), "fold-losses")
    losses = written(A.fold_loss(found), "losses")
    return losses, A.choose_model(losses, ("loss",))
