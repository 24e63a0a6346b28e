"""Eigenpairs of pieces in a task, and by packed links on the cluster, against dense matrices; no block is left behind."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphcv.operators import krylov
from graphcv.operators.spectral import train_row_svd
from graphcv.sources.shared import shared_path


def folders(spark):
    top = os.path.dirname(shared_path(spark, "x").removeprefix("file://"))
    return {f for f in os.listdir(top) if "block" in f or "half-step" in f or "packed" in f}


def graph(spark, n, seed):
    a = np.triu(np.random.default_rng(seed).random((n, n)) < 0.1, 1)
    i, j = np.nonzero(a)
    return a + a.T, spark.createDataFrame([(int(u), int(v)) for u, v in zip(i, j, strict=True)], "src long, dst long")


def test_sums_over_links():
    rng = np.random.default_rng(1)
    target, source, x = rng.integers(0, 50, 3000), rng.integers(0, 40, 3000), rng.random((40, 3))
    target[target == 7] = 8  # a target without sources
    m = np.zeros((50, 40))
    np.add.at(m, (target, source), 1)
    for cells in (1, 100, 10**6):
        assert np.allclose(krylov.link_sums(*krylov.grouped(target, source, 50), x, cells), m @ x)
    assert not krylov.link_sums(*krylov.grouped(target[:0], source[:0], 50), x).any()


@pytest.mark.parametrize("dense", [0, 1])
def test_both_ways_equal_dense(spark, dense, monkeypatch):
    """dense = 0: on the cluster, in several parts; 1: in a task. With constants and scales, and the rows of training nodes."""
    monkeypatch.setattr(krylov, "PACK_NODES", 40)
    before = folders(spark)
    a, edges = graph(spark, 120, 2)
    f = 1.0 + np.arange(120) % 3
    rows = spark.range(120).select(F.lit(0).alias("piece"), F.col("id").alias("node"), (1.0 + F.col("id") % 3).alias("f"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.lit(0).alias("piece"), "src", "dst")
    found, solved = krylov.leading_eigenpairs(rows, both, {0: 0.01}, 3, dense=dense)
    values, vectors = np.linalg.eigh(np.outer(f, f) * (a + 0.01))
    order = krylov.by_magnitude(values)[:3]
    x = np.array([r.x for r in found.orderBy("node").collect()])
    assert solved[0][0] == pytest.approx(values[order], rel=1e-9) and np.allclose(np.abs((x * vectors[:, order]).sum(0)), 1, atol=1e-6)
    found, values = train_row_svd(rows.select("node"), edges, rows.select("node").where("node >= 30"), 2, dense=dense)
    _, s, v = np.linalg.svd(a[30:] + 0.001)
    x = np.array([r.x for r in found.orderBy("node").collect()])
    assert values == pytest.approx(s[:2], rel=1e-6) and np.allclose(np.abs((x * v[:2].T).sum(0)), 1, atol=1e-5)
    assert folders(spark) == before
