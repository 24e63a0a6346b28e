"""Queries of the jobs that fit labels and positions themselves; SQL does not express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphcv.jobs import tuning
from graphcv.jobs.study import tau_study
from graphcv.operators.cluster import cluster_labels, spectral_labels
from graphcv.operators.report import method_accuracy
from graphcv.operators.spectral import adjacency_embedding, graph_eigenvectors, procrustes_align, sub_eigenvectors, train_row_svd

KEYS = ("rep", "cand")


def _e2(x):
    return sub_eigenvectors(x.members, x.pieces, 3, 0.5, True).select("rep", "sub", "node", "x")


def _e3(x):
    found, values, residuals = graph_eigenvectors(x.nodes, x.edges, 2, 0.5, True, dense=0)  # by rounds, however small the graph
    return found.select("node", "x", F.array(*map(F.lit, values)).alias("values"), F.array(*map(F.lit, residuals)).alias("residuals"))


def _h3(x):
    found = adjacency_embedding(x.members, x.pieces, 2)
    return procrustes_align(found, x.partition.where("sub = 0"))


def _planted(job, *args, **options):
    """A job over the planted graph of the suppliers' tables is small; over parts it needs all pairs, so suppliers stand in."""

    def run(x):
        nodes, edges = x.suppliers
        n = nodes.count()
        return job(nodes, edges, *(a(n) if callable(a) else a for a in args), **options)

    return run


def _e4(x):
    found, values = train_row_svd(x.nodes, x.edges, x.folds.where("fold <> 1"), 2)
    return found.select("node", "x", F.array(*map(F.lit, values)).alias("values"))


def _e7(x):
    return tuning.lowrank_impute(x.suppliers[0], x.observed.where("fold = 1").select("src", "dst"), x.supplier_pairs.where("fold = 1"), 3, 0.8)


def _r3(x):
    nodes, edges = x.suppliers
    choices = tuning.tune_tau_by_agreement(nodes, edges, 2, [0.0, 1.0], 2, nodes.count() // 5, 2)[1]
    return tuning.refit_at_mean_tau(nodes, edges, 2, choices, nodes.select("node", (F.col("node") % 2 + 1).cast("int").alias("g")))


def _r2(x):
    """Methods' accuracies from what W4, W5, W9 and the consensus jobs wrote, a run for each line status."""
    return method_accuracy(*tau_study(x.supplier_runs, 2, [0.0, 1.0], 2, 0.2, 2))


FITTED = {
    "r2_tuned_accuracy": _r2,
    "e4_train_row_svd": _e4,
    "e7_lowrank_impute": _e7,
    "c3_spectral_labels": lambda x: spectral_labels(x.members, x.pieces, [2, 3], True, 0.5, True),
    "c4_whole_graph_labels": lambda x: tuning.whole_graph_labels(x.nodes, x.edges, 2, 0.5),
    "w5_tune_tau_by_agreement": _planted(lambda nodes, edges, o: tuning.tune_tau_by_agreement(nodes, edges, 2, [0.0, 1.0], 2, o, 2)[1], lambda n: n // 5),
    "w6_pair_cv_blockmodel": _planted(lambda nodes, edges: tuning.pair_cv_blockmodel(nodes, edges, 2)[1]),
    "w7_node_cv_blockmodel": _planted(lambda nodes, edges: tuning.node_cv_blockmodel(nodes, edges, 2, 2)[1]),
    "w8_pair_cv_rank": _planted(lambda nodes, edges: tuning.pair_cv_rank(nodes, edges, 2)[1]),
    "w9_spectral_gap_tau": _planted(lambda nodes, edges: tuning.spectral_gap_tau(nodes, edges, 2, [0.5, 1.0])[0]),
    "r3_refit_at_mean_tau": _r3,
    "e2_sub_eigenvectors": _e2,
    "e3_graph_eigenvectors": _e3,
    "e6_adjacency_embedding": lambda x: adjacency_embedding(x.members, x.pieces, 3),
    "c1_kmedoids": lambda x: cluster_labels(adjacency_embedding(x.members, x.pieces, 3), [2, 3], method="kmedoids"),
    "c2_kmeans": lambda x: cluster_labels(adjacency_embedding(x.members, x.pieces, 3), [2, 3], normalize=True),
    "h3_procrustes_align": _h3,
    "w1_overlap_cv_blockmodel": lambda x: tuning.overlap_cv_blockmodel(x.nodes, x.edges, [1, 2, 3], 3, x.o, 2)[1],
    "w2_overlap_cv_rank": lambda x: tuning.overlap_cv_rank(x.nodes, x.edges, [1, 2, 3], 3, x.o, 2)[1],
    "w3_overlap_cv_latent": _planted(lambda nodes, edges, o: tuning.overlap_cv_latent(nodes, edges, [1, 2], 2, o, 2)[1], lambda n: n // 5),
    "w4_tune_tau_by_loss": lambda x: tuning.tune_tau_by_loss(x.nodes, x.edges, 2, [0.0, 1.0], 3, x.o, 2)[1],
    "w10_consensus_labels": lambda x: tuning.consensus_labels(x.nodes, x.edges, 2, 0.5, 3, x.o, 2),
}
