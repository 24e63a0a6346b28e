"""Node hold-out with few different psi is scored from counts, as in tiles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphcv.jobs import tuning


def test_kinds_equal_tiles(spark, monkeypatch):
    rng = np.random.default_rng(8)
    n = 30
    edges = spark.createDataFrame([(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.3], "src long, dst long")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    labels = spark.createDataFrame([(f, k, i, i % k + 1) for f in (1, 2) for k in (1, 2) for i in range(n)], "fold int, cand int, node long, g int")
    psi = labels.select("fold", "cand", "node", (F.col("node") % 4 / 3).alias("psi"))
    found, used = [], []
    whole = tuning.tiled_own_loss
    monkeypatch.setattr(tuning, "tiled_own_loss", lambda *a: used.append(1) or whole(*a))
    for most in (1000, 0):
        monkeypatch.setattr(tuning, "KINDS", most)
        losses, _ = tuning.node_cv_blockmodel(nodes, edges, 2, 2, labels, 1, labels, psi, tile=8)
        found.append({(r.model, r.cand, r.loss): r.value for r in losses.collect()})
    assert found[0] == pytest.approx(found[1]) and len(found[0]) == 12 and used == [1]
