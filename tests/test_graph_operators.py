"""Hand cases, slow against fast paths, and properties of the numeric helpers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphcv.operators import choose as A
from graphcv.operators import estimate as M
from graphcv.operators import graph as G
from graphcv.operators import labels as L
from graphcv.operators import loss as S
from graphcv.operators import split as P
from graphcv.operators.cluster import kmeans, kmedoids
from graphcv.operators.krylov import leading_eigenpairs
from graphcv.operators.spectral import graph_eigenvectors, procrustes_align, sub_eigenvectors
from graphcv.operators.tiles import dcbm_vectors, tiled_pair_loss

TRIANGLES = [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4)]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_graph_shaping(spark):
    raw = frame(spark, [(2, 1), (1, 2), (3, 3), (None, 1), (2, 3)], "u long, v long")
    edges = G.canonical_edges(raw, "u", "v")
    assert sorted(map(tuple, edges.collect())) == [(1, 2), (2, 3)]
    nodes = frame(spark, [(i,) for i in range(1, 5)], "node long")
    degree = {r.node: r.degree for r in G.degrees(nodes, edges).collect()}
    assert degree == {1: 1, 2: 2, 3: 1, 4: 0}
    lone = G.isolated_labels(G.degrees(nodes, edges), 3).collect()
    assert [r.node for r in lone] == [4] and 1 <= lone[0].g <= 3
    assert G.canonical_edges(raw.limit(0), "u", "v").count() == 0


def test_partition_covers_all_nodes(spark):
    nodes = spark.range(97).select(F.col("id").alias("node"))
    parts = P.overlap_partition(nodes, 20, 3, 2).collect()
    for rep in (1, 2):
        own = [r for r in parts if r.rep == rep]
        sizes = [sum(r.sub == q for r in own) for q in range(4)]
        assert {r.node for r in own} == set(range(97)) and sizes[0] == 20 and max(sizes[1:]) - min(sizes[1:]) <= 1
    folds = P.node_folds(nodes, 5).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == [17, 20, 20, 20, 20]


def test_matching():
    assert L.match_table({(1, 1): 5, (1, 2): 5, (2, 1): 1, (2, 2): 5, (3, 3): 1, (2, 3): 1}, 3) == {1: 1, 2: 2, 3: 3}
    assert L.match_table({(1, 1): 5, (1, 2): 5}, 2) == {1: 1, 2: 2}  # half differ: no swap
    assert L.match_table({(1, 2): 6, (1, 1): 5}, 2) == {1: 2, 2: 1}
    assert L.match_table({(1, 1): 3}, 1) == {1: 1}
    assert L.match_table({(1, 2): 4, (2, 3): 4, (3, 1): 4}, 3) == {1: 2, 2: 3, 3: 1}


def test_nmi_of_itself(spark):
    labels = frame(spark, [(i, i % 3 + 1) for i in range(30)], "node long, g int").withColumn("one", F.lit(1))
    assert L.nmi(L.confusion(labels, labels, ("one",)), ("one",)).first().nmi == pytest.approx(1)


def test_blocks_by_hand(spark):
    edges = frame(spark, [(*e, 2) for e in TRIANGLES], "src long, dst long, cand int")
    labels = frame(spark, [(i, 1 if i < 4 else 2, 2) for i in range(1, 7)], "node long, g int, cand int")
    sums = M.block_sums(edges, labels, ("cand",))
    assert {(r.k, r.l): r.s for r in sums.collect()} == {(1, 1): 6, (2, 2): 6, (1, 2): 1, (2, 1): 1}
    b = {(r.k, r.l): r.b for r in M.sbm_blocks(sums, M.label_sizes(labels, ("cand",)), ("cand",)).collect()}
    assert b == pytest.approx({(1, 1): 1.0, (2, 2): 1.0, (1, 2): 1 / 9, (2, 1): 1 / 9})
    empty = labels.withColumn("cand", F.lit(3))
    sums = M.block_sums(edges.withColumn("cand", F.lit(3)), empty, ("cand",))
    b = {(r.k, r.l): r.b for r in M.sbm_blocks(sums, M.label_sizes(empty, ("cand",)), ("cand",)).collect()}
    assert b[3, 3] == b[1, 3] == 1e-6 and len(b) == 9


def test_auc(spark):
    rng = np.random.default_rng(0)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    rows = frame(spark, [(1, int(a), float(b)) for a, b in zip(y, p, strict=True)] + [(2, 1, 0.5)], "k int, y int, phat double")
    found = {r.k: r.value for r in S.pair_losses(rows, ("k",), ["auc"]).collect()}
    pos, neg = p[y == 1], p[y == 0]
    assert found[1] == pytest.approx(-np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))) and found[2] is None


def test_choices(spark):
    losses = frame(spark, [(1, "sbm", 1, "l2", 2.0), (1, "sbm", 2, "l2", 1.0), (1, "dcbm", 1, "l2", 1.0), (1, "dcbm", 2, "l2", None), (2, "sbm", 1, "l2", 3.0), (2, "dcbm", 1, "l2", 2.0)], "rep int, model string, cand int, loss string, value double")
    chosen = A.choose_model(losses)
    assert {(r.rep, r.choice) for r in chosen.collect()} == {(1, "SBM-2"), (2, "DCSBM-1")}
    assert A.mode_over_reps(chosen).first().choice == "SBM-2"  # a tie: the earliest rep


def test_tiles_equal_pairs(spark):
    rng = np.random.default_rng(1)
    n, rows, links = 40, [], []
    for i in range(n):
        rows.append((1, 2, 1 + i % 2, i, 1 + int(rng.integers(2)), float(rng.random())))
    sub = {r[3]: r[2] for r in rows}
    for i in range(n):
        for j in range(n):
            if sub[i] == 1 and sub[j] == 2 and rng.random() < 0.3:
                links.append((1, 1, 2, i, j))
    nodes = frame(spark, rows, "rep int, cand int, sub int, node long, g int, psi double")
    held = frame(spark, links, "rep int, p int, q int, i long, j long")
    blocks = frame(spark, [(1, 2, k, m, 0.5 / k / m) for k in (1, 2) for m in (1, 2)], "rep int, cand int, k int, l int, b double")
    labels, theta = nodes.drop("psi"), nodes.select("rep", "cand", "node", "psi")
    found = {r.loss: r.value for r in tiled_pair_loss(*dcbm_vectors(labels, blocks, theta), held, tile=7).collect()}
    b, edges = lambda k, m: 0.5 / k / m, {(e[3], e[4]) for e in links}
    y, p = [], []
    for _, _, s1, i, g1, t1 in rows:
        for _, _, s2, j, g2, t2 in rows:
            if s1 == 1 and s2 == 2:
                y.append((i, j) in edges)
                p.append(min(max(b(g1, g2) * t1 * t2, 1e-6), 1 - 1e-6))
    y, p = np.array(y), np.array(p)
    assert found["l2"] == pytest.approx(np.sqrt(((y - p) ** 2).sum()))
    assert found["deviance"] == pytest.approx(-np.where(y, np.log(p), np.log(1 - p)).sum())
    assert found["auc"] == pytest.approx(-np.mean((p[y][:, None] > p[~y]) + 0.5 * (p[y][:, None] == p[~y])), abs=1e-12)


def leading(matrix, k):
    """Values of largest magnitude, of equals the positive one first, and their vectors."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.lexsort((values < 0, -np.round(np.abs(values), 9)))[:k]
    return values[order], vectors[:, order]


@pytest.mark.parametrize("dense", [0, 1500])
def test_pieces_of_many_sizes(spark, dense):
    """All pieces at once, on the cluster and as dense matrices: a random graph with a constant, one without edges, one of two nodes."""
    rng = np.random.default_rng(2)
    a = np.triu(rng.random((120, 120)) < 0.1, 1)
    i, j = np.nonzero(a)
    rows = [(0, v, 1.0 + v % 3) for v in range(120)] + [(1, v, 1.0) for v in range(30)] + [(2, 5, 1.0), (2, 7, 1.0)]
    links = [(0, int(u), int(v)) for u, v in zip(i, j, strict=True)] + [(2, 5, 7)]
    links += [(p, v, u) for p, u, v in links]
    f = 1.0 + np.arange(120) % 3
    full = np.outer(f, f) * (a + a.T + 0.01)
    found, solved = leading_eigenpairs(frame(spark, rows, "piece int, node long, f double"), frame(spark, links, "piece int, src long, dst long"), {0: 0.01}, 3, dense=dense)
    values, vectors = leading(full, 3)
    assert solved[0][0] == pytest.approx(values, rel=1e-9) and max(solved[0][1]) < 1e-6 * values[0]
    x = np.array([r.x for r in found.where("piece = 0").orderBy("node").collect()])
    assert np.allclose(np.abs((x * vectors).sum(0)), 1, atol=1e-6) and (x[np.abs(np.round(x, 9)).argmax(0), range(3)] > 0).all()
    assert solved[1][0] == pytest.approx([0, 0, 0]) and solved[2][0][:2] == pytest.approx([1, -1]) and found.count() == 152


def test_eigenvectors_that_do_not_settle_raise(spark):
    rng = np.random.default_rng(3)
    i, j = np.nonzero(np.triu(rng.random((60, 60)) < 0.3, 1))
    edges = frame(spark, [(int(u), int(v)) for u, v in zip(i, j, strict=True)], "src long, dst long")
    with pytest.raises(RuntimeError, match="did not settle"):
        graph_eigenvectors(spark.range(60).select(F.col("id").alias("node")), edges, 2, dense=0, extra=1, most_rounds=2)


@pytest.mark.parametrize("dense", [0, 1500])
def test_graph_eigenvectors(spark, dense):
    """The two triangles have the values +-1.732: the positive one is the second."""
    nodes = frame(spark, [(i,) for i in range(1, 7)], "node long")
    found, values, residuals = graph_eigenvectors(nodes, frame(spark, TRIANGLES, "src long, dst long"), 3, dense=dense)
    a = np.zeros((7, 7))
    for i, j in TRIANGLES:
        a[i, j] = a[j, i] = 1
    assert values == pytest.approx([1 + np.sqrt(2), np.sqrt(3), -np.sqrt(3)], abs=1e-9) and max(residuals) < 1e-6
    x = np.array([r.x for r in found.orderBy("node").collect()])
    assert np.allclose(a[1:, 1:] @ x, x * values, atol=1e-6)


def test_pieces_equal_dense(spark):
    """Eigenvectors of overlapping pieces, regularised, the same on the cluster as in a task."""
    rng = np.random.default_rng(8)
    i, j = np.nonzero(np.triu(rng.random((80, 80)) < 0.2, 1))
    edges = frame(spark, [(1, s, int(u), int(v)) for u, v in zip(i, j, strict=True) for s in (1, 2) if (u + v) % 3 != s], "rep int, sub int, src long, dst long")
    members = spark.range(80).select(F.lit(1).alias("rep"), F.explode(F.array(F.lit(1), F.lit(2))).alias("sub"), F.col("id").alias("node"))
    one, two = ({(r["sub"], r.node): (r.x, r["values"]) for r in sub_eigenvectors(members, edges, 2, 0.5, True, dense=d).collect()} for d in (0, 1500))
    assert one.keys() == two.keys() and all(one[k][0] == pytest.approx(two[k][0], abs=1e-5) and one[k][1] == pytest.approx(two[k][1]) for k in one)


@pytest.mark.parametrize("n", [2, 3, 8, 9, 40])
def test_pair_numbers(spark, n):
    """Every pair has a number, the permutation moves all of them, and comes back."""
    from graphcv.operators.pairs import pair_number, pair_places, permuted

    rows = spark.range(n * (n - 1) // 2).select(F.col("id"), permuted(F.col("id"), n, F.lit("k")).alias("t"), F.inline(F.array(pair_places(F.col("id")))))
    found = rows.select("*", permuted(F.col("t"), n, F.lit("k"), back=True).alias("back"), pair_number(F.col("u"), F.col("v")).alias("num")).collect()
    assert sorted(r.t for r in found) == list(range(n * (n - 1) // 2)) and all(r.back == r.id == r.num for r in found)
    assert {(r.u, r.v) for r in found} == {(u, v) for v in range(n) for u in range(v)}


def test_clusters():
    x = np.vstack([np.random.default_rng(3).normal(c, 0.1, (30, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    for labels in (kmeans(x, 3), kmedoids(x, 3)):
        assert all(len(set(labels[s : s + 30])) == 1 for s in (0, 30, 60)) and len(set(labels)) == 3


@pytest.mark.parametrize("move", [False, True])
def test_procrustes(spark, move):
    rng = np.random.default_rng(4)
    x, (c, s) = rng.normal(size=(20, 2)), (np.cos(0.7), np.sin(0.7))
    turned = x @ np.array([[c, -s], [s, c]]) + (np.array([1.0, -2.0]) if move else 0)
    rows = [(1, 1, i, [float(v) for v in x[i]]) for i in range(20)] + [(1, 2, i, [float(v) for v in turned[i]]) for i in range(20)]
    positions = frame(spark, rows, "rep int, sub int, node long, x array<double>")
    shared = frame(spark, [(1, i) for i in range(12)], "rep int, node long")
    out = {r.node: r.x for r in procrustes_align(positions, shared, move).where("sub = 2").collect()}
    assert np.allclose([out[i] for i in range(20)], x, atol=1e-8)


def test_hamming_equals_expansion(spark):
    rng = np.random.default_rng(5)
    rows = [(1, 2, q, 10 * q + i, int(rng.integers(1, 3)), int(rng.integers(1, 3))) for q in (1, 2) for i in range(8)]
    counts = frame(spark, rows, "rep int, cand int, sub int, node long, lab int, fixed int").groupBy("rep", "cand", "sub", "lab", "fixed").agg(F.count("*").alias("n"))
    found = L.pair_hamming_loss(counts).first().value
    one, two = [r for r in rows if r[2] == 1], [r for r in rows if r[2] == 2]
    m, n = max(r[4] for r in two), max(r[5] for r in two)
    codes = [((a[4] - 1) * m + b[4], (a[5] - 1) * n + b[5]) for a in one for b in two]
    cells = {}
    for c in codes:
        cells[c] = cells.get(c, 0) + 1
    to = L.match_table(cells, max(max(c) for c in cells))
    assert found == pytest.approx(np.mean([to[a] != b for a, b in codes]))


def test_medoids_come_from_all_rows():
    import numpy as np

    from graphcv.operators.cluster import kmedoids

    x = np.random.default_rng(1).normal(size=(2600, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    chosen = [int(d.sum(0).argmin())]
    for _ in range(2):
        chosen.append(int(np.minimum(d, d[chosen].min(0)[:, None]).sum(0).argmin()))
    expected = d[chosen].argmin(0) + 1
    assert (kmedoids(x, 3) == expected).all() and (kmedoids(x, 3, cells=10_000) == expected).all()


def test_row_vectors(spark):
    from graphcv.operators.spectral import train_row_svd

    nodes = frame(spark, [(i,) for i in range(1, 7)], "node long")
    found, values = train_row_svd(nodes, frame(spark, TRIANGLES, "src long, dst long"), nodes.where("node <> 6"), 2, 0.001)
    a = np.full((7, 7), 0.001)
    for i, j in TRIANGLES:
        a[i, j] += 1
        a[j, i] += 1
    _, s, v = np.linalg.svd(a[1:6, 1:])
    x = np.array([r.x for r in found.orderBy("node").collect()])
    assert values == pytest.approx(s[:2], abs=1e-5) and np.allclose(np.abs(x), np.abs(v[:2].T), atol=1e-3)


def test_node_cv_with_supplied_labels(spark):
    """The labels of two dense blocks beat one block and a wrong labelling."""
    from graphcv.jobs.tuning import node_cv_blockmodel

    rng = np.random.default_rng(6)
    n = 40
    edges = [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.7 if i % 2 == j % 2 else 0.05)]
    nodes = frame(spark, [(i,) for i in range(n)], "node long")
    labels = frame(spark, [(f, k, i, i % k + 1) for f in (1, 2) for k in (1, 2, 3) for i in range(n)], "fold int, cand int, node long, g int")
    losses, choices = node_cv_blockmodel(nodes, frame(spark, edges, "src long, dst long"), 3, 2, labels, 2)
    assert {r.loss: r.choice[-1] for r in choices.collect()} == {"sse": "2", "loglik": "2", "auc": "2"} and losses.count() == 18


@pytest.mark.parametrize(("corrected", "options"), [(False, {}), (True, {}), (True, {"dense": 0, "tile": 25})])
def test_spectral_gap_equals_dense(spark, corrected, options):
    """The ratio of supplied labels, against dense matrices of a graph in three tiles or one."""
    from graphcv.jobs.tuning import spectral_gap_tau

    rng = np.random.default_rng(7)
    n, k, tau = 60, 2, 0.5
    a = np.triu(rng.random((n, n)) < np.where(np.add.outer(np.arange(n), np.arange(n)) % 2 == 0, 0.6, 0.1), 1).astype(float)
    a, g = a + a.T, np.arange(n) % k
    z, d = np.eye(k)[g], a.sum(1)
    s = z.T @ a @ z
    if corrected:
        b = s + 1e-4
        psi = d / b.sum(1)[g]
        p = b[np.ix_(g, g)] * np.outer(psi, psi)
    else:
        size = z.sum(0)
        p = (s / (np.outer(size, size) - np.diag(size)))[np.ix_(g, g)]
    p, c = np.clip(p, 0, 1), tau * d.mean() / n
    f, fh = 1 / np.sqrt(d + c), 1 / np.sqrt(p.sum(1) + c)
    fit = np.outer(fh, fh) * (p + c)
    top = np.linalg.svd(np.abs(np.outer(f, f) * (a + c) - fit), compute_uv=False)[0]
    low = np.sort(np.abs(np.linalg.eigvalsh(fit)))[-k]
    edges = frame(spark, [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(a)), strict=True)], "src long, dst long")
    labels = frame(spark, [(tau, i, int(g[i]) + 1) for i in range(n)], "tau double, node long, g int")
    found, choice = spectral_gap_tau(frame(spark, [(i,) for i in range(n)], "node long"), edges, k, [tau], corrected, labels=labels, **options)
    assert found.first()["value"] == pytest.approx(top / low, rel=1e-5) and choice.first()["tau"] == tau


def test_tiles_multiply(spark):
    """A matrix in many tiles times two columns."""
    from graphcv.operators.tiles import tile_matvec

    n = 30
    links = [(i, j) for i in range(n) for j in range(i + 1, n) if (i * j) % 7 == 1]
    a = np.zeros((n, n))
    for i, j in links:
        a[i, j] = a[j, i] = 1.0
    x = np.stack([np.arange(n) % 5, np.arange(n) % 3], 1).astype(float)
    block = frame(spark, [(i, float(i % 4), x[i].tolist()) for i in range(n)], "node long, t double, x array<double>")
    found = tile_matvec(block, frame(spark, links, "src long, dst long"), lambda p, q, linked: linked + np.outer(p["t"], q["t"]), tile=7)
    t = np.arange(n) % 4
    assert np.allclose([r.y for r in found.orderBy("node").collect()], (a + np.outer(t, t)) @ x)


def test_medoids_by_tiles(spark):
    """Medoids chosen by tiles are those of one task."""
    from graphcv.operators.cluster import cluster_labels

    rng = np.random.default_rng(9)
    rows = [(1, s, i, [float(v) for v in rng.normal(size=3)]) for s in (1, 2) for i in range(90)]
    table = frame(spark, rows, "rep int, sub int, node long, x array<double>")
    one, two = ({(r["sub"], r.cand, r.node): r.g for r in cluster_labels(table, [1, 2, 3], method="kmedoids", most=m).collect()} for m in (10, 10_000))
    assert one == two and len(one) == 540


def test_latent_positions(spark):
    """Steps by tiles equal those in a task; the planted distances are found."""
    from graphcv.operators.latent import fit_latent

    rng = np.random.default_rng(10)
    n = 60
    z = rng.normal(size=(n, 2)) * 1.5
    far = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    links = [(1, 1, i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < 1 / (1 + np.exp(-(2.5 - 1.5 * far[i, j])))]
    members, edges = frame(spark, [(1, 1, i) for i in range(n)], "rep int, sub int, node long"), frame(spark, links, "rep int, sub int, src long, dst long")
    get = lambda **o: {(r.cand, r.node): (*r.x, r.beta) for r in fit_latent(members, edges, [1, 2], **o).collect()}
    one, two = get(steps=3, most_nodes=10, tile=25), get(steps=3)
    assert one.keys() == two.keys() and all(one[k] == pytest.approx(two[k], abs=1e-9) for k in one)
    full = get()
    x = np.array([full[2, i][:2] for i in range(n)])
    found = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    some = np.triu_indices(n, 1)
    assert np.corrcoef(found[some], far[some])[0, 1] > 0.8


def test_registered_losses_and_eigen_fit(spark):
    """Losses of a caller's own and the eigen fit, in the jobs of overlapping pieces."""
    from graphcv.jobs.tuning import overlap_cv_blockmodel, overlap_cv_rank, tune_tau_by_loss

    rng = np.random.default_rng(11)
    n = 60
    edges = frame(spark, [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.6 if i % 2 == j % 2 else 0.05)], "src long, dst long")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    S.register_loss("total", lambda y, p: F.sum(F.abs(y - p)))
    losses, choices = overlap_cv_blockmodel(nodes, edges, [1, 2], 2, 20, 1, losses=("l2", "total"), dc_est=1)
    assert {r.loss: r.choice.split("-")[1] for r in choices.collect()} == {"l2": "2", "total": "2"} and losses.count() == 8
    assert {r.loss for r in tune_tau_by_loss(nodes, edges, 2, [0.5], 2, 20, 1, dc_est=1, losses=("total", "auc"))[0].collect()} == {"total", "auc"}
    assert {r.loss for r in overlap_cv_rank(nodes, edges, [1, 2], 2, 20, 1, losses=("total",))[0].collect()} == {"total"}
    del S.LOSSES["total"]


@pytest.mark.parametrize("options", [{}, {"dense": 0, "tile": 25}])
def test_imputed_laplacian_equals_dense(spark, options):
    """Eigenvectors of the regularised Laplacian of a clipped low-rank matrix, against the dense one, for two folds and two ranks."""
    from graphcv.jobs.tuning import imputed_vectors

    rng = np.random.default_rng(12)
    n, share, tau = 60, 0.9, 0.7
    rows, values, expected = [], {}, {}
    for fold in (1, 2):
        a = np.triu(rng.random((n, n)) < np.where(np.add.outer(np.arange(n), np.arange(n)) % 2 == 0, 0.6, 0.15), 1).astype(float)
        v, x = leading(a + a.T, 3)
        values[fold] = v.tolist()
        rows += [(fold, i, x[i].tolist()) for i in range(n)]
        for k in (2, 3):
            p = np.clip((x[:, :k] * v[:k] / share) @ x[:, :k].T, 0, 1)
            p = p + tau * p.sum(1).mean() / n
            d = 1 / np.sqrt(p.sum(1))
            expected[fold, k] = leading(p * np.outer(d, d), k)[1]
    found = imputed_vectors(frame(spark, rows, "fold int, node long, x array<double>"), values, share, frame(spark, [(0, 1)], "src long, dst long"), tau, [2, 3], **options)
    got = {(r.fold, r.cand, r.node): r.x for r in found.collect()}
    for (fold, k), x in expected.items():
        assert np.allclose(np.abs((np.array([got[fold, k, i] for i in range(n)]) * x).sum(0)), 1, atol=1e-6)


def test_pair_cv_of_two_blocks(spark):
    """Two dense blocks are found from held-out pairs, in draws and in folds, with and without regularisation."""
    from graphcv.jobs.tuning import pair_cv_blockmodel, pair_cv_rank

    rng = np.random.default_rng(13)
    n = 50
    edges = frame(spark, [(i, j) for i in range(n) for j in range(i + 1, n) if rng.random() < (0.7 if i % 2 == j % 2 else 0.05)], "src long, dst long")
    nodes = spark.range(n).select(F.col("id").alias("node"))
    for options in ({"folds": 2}, {"cv": 4, "tau": 0.5}):
        choices = {r.loss: r.choice for r in pair_cv_blockmodel(nodes, edges, 3, **options)[1].collect()}
        assert choices["loglik"][-1] == "2"
    assert {r.loss for r in pair_cv_rank(nodes, edges, 3, 2)[0].collect()} == {"sse", "mse", "auc"}


PLANTED = "/root/testdata/sf0.001"
JOBS = {
    "w1": lambda t, n, e: {r.choice for r in t.overlap_cv_blockmodel(n, e, [2, 3, 4], 2, 60, 1, losses=("l2", "deviance"))[1].collect()} <= {"SBM-3", "DCSBM-3"},
    "w4": lambda t, n, e: t.tune_tau_by_loss(n, e, 3, [0.0, 0.5], 2, 60, 1)[1].count() == 3,
    "w5": lambda t, n, e: all(r.value == pytest.approx(-1 if r.loss == "nmi" else 0, abs=0.1) for r in t.tune_tau_by_agreement(n, e, 3, [0.5, 1.0], 2, 60, 1)[0].collect()),
    "w6": lambda t, n, e: {r.loss: r.choice[-1] for r in t.pair_cv_blockmodel(n, e, 4, 2)[1].collect()}["loglik"] == "3",
    "w7": lambda t, n, e: {r.loss: r.choice[-1] for r in t.node_cv_blockmodel(n, e, 4, 2)[1].collect()}["loglik"] == "3",
    "w8": lambda t, n, e: {r.loss: r.cand for r in t.pair_cv_rank(n, e, 5, 2)[1].collect()}["mse"] == 3,
}


@pytest.mark.parametrize("name", JOBS)
def test_planted_communities_are_found(spark, name):
    """Three planted blocks of 200 nodes."""
    from graphcv.jobs import tuning
    from graphcv.sources.graphs import planted
    from graphcv.sources.shared import written

    nodes, edges = planted(spark, PLANTED)
    assert JOBS[name](tuning, nodes.select("node"), written(edges, "planted"))


def test_planted_labels_of_the_whole_graph(spark):
    from graphcv.jobs.tuning import consensus_labels, each_tau_labels
    from graphcv.sources.graphs import planted
    from graphcv.sources.shared import written

    nodes, edges = planted(spark, PLANTED)
    edges = written(edges, "planted")
    found = L.label_accuracy(each_tau_labels(nodes.select("node"), edges, 3, [0.0, 0.5]), nodes, ("tau",)).collect()
    assert {r.tau for r in found} == {0.0, 0.5} and all(r.accuracy > 0.97 for r in found)
    stitched = consensus_labels(nodes.select("node"), edges, 3, 0.5, 2, 60, 2).select("node", "g")
    assert L.label_accuracy(stitched, nodes).first().accuracy > 0.95


def test_study_of_planted_runs(spark):
    """Two runs on planted graphs: every method finds the blocks, and R2's rows are those that plain Python picks from the jobs' tables."""
    from graphcv.jobs.study import tau_study
    from graphcv.operators.report import accuracy_summary, method_accuracy
    from graphcv.sources.graphs import planted
    from graphcv.sources.shared import written

    runs = []
    for run, across in ((1, "0ccccc"), (2, "199999")):
        nodes, edges = planted(spark, PLANTED, across=across)
        runs.append((run, nodes.select("node"), written(edges, "planted"), nodes))
    tables = tau_study(runs, 3, [0.0, 0.5], 2, 0.2, 2)
    by_tau, choices, gap = ([r.asDict() for r in t.collect()] for t in tables)
    assert {(r["run"], r["kind"], r["tau"]) for r in by_tau} == {(n, k, t) for n in (1, 2) for k in ("whole", "consensus") for t in (0.0, 0.5)}
    assert {(r["run"], r["loss"], r["rep"]) for r in choices} == {(n, c, r) for n in (1, 2) for c in ("l2", "auc", "nmi") for r in (1, 2)}
    assert sorted(r["run"] for r in gap) == [1, 2]
    accuracy = {(r["run"], r["kind"], r["tau"]): r["accuracy"] for r in by_tau}
    expected = {}
    for run in (1, 2):
        for kind in ("whole", "consensus"):
            at = {t: accuracy[run, kind, t] for t in (0.0, 0.5)}
            expected |= {(run, f"{kind}-zero"): at[0.0], (run, f"{kind}-best"): max(at.values()), (run, f"{kind}-gap"): at[next(r["tau"] for r in gap if r["run"] == run)]}
            for loss in ("l2", "auc", "nmi"):
                taus = [r["tau"] for r in sorted(choices, key=lambda r: r["rep"]) if r["run"] == run and r["loss"] == loss]
                expected |= {(run, f"{kind}-{loss}-first"): at[taus[0]], (run, f"{kind}-{loss}-mode"): at[max(taus, key=taus.count)]}
    found = written(method_accuracy(*tables), "methods")
    assert {(r.run, r.method): r.accuracy for r in found.collect()} == expected
    assert all(v > 0.9 for v in expected.values())
    summary = accuracy_summary(found, True).collect()
    assert len(summary) == 18 and all(r.n_runs == 2 and r.mean > 90 for r in summary)
