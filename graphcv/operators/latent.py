"""Latent-distance positions of pieces by maximum likelihood."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.operators.graph import arcs
from graphcv.operators.krylov import leading_eigenpairs
from graphcv.sources.shared import written


def pull(za: np.ndarray, zb: np.ndarray, linked: np.ndarray, level: float, off: np.ndarray | float) -> tuple[np.ndarray, np.ndarray]:
    """What the pairs of two sets of nodes add to the gradient of the positions of the first, and the sums of their errors; `off` is 0
    for a node with itself."""
    far = np.sqrt(np.maximum((za * za).sum(1)[:, None] - 2 * za @ zb.T + (zb * zb).sum(1), 1e-12))
    e = (linked - 1 / (1 + np.exp(-(level - far)))) * off
    w = e / far
    return -2 * (w.sum(1)[:, None] * za - w @ zb), e.sum(1)


def step(z: np.ndarray, m: np.ndarray, s: np.ndarray, g: np.ndarray, t: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and both moments of their gradients after step t (from 1)."""
    m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
    return z + rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8), m, s


def fit_latent(members: DataFrame, edges: DataFrame, cands: list[int], keys: tuple[str, ...] = ("rep", "sub"), most_nodes: int = 4000, steps: int = 200, rate: float = 0.05, tile: int = 2000) -> DataFrame:
    """keys, cand, node, x, beta for every dimension of `cands`: positions z and intercept b of P(link) = logistic(b - |z_i - z_j|), by
    gradient steps from a spectral start, all pieces and dimensions in the same steps.

    Pieces of `most_nodes` nodes at most are fitted in a task each. If one is larger, every step sums the gradients of all
    over tiles of nodes, which bounds a group by `tile` nodes on either side; the steps are the same.
    """
    types, found = dict(members.dtypes), sorted(tuple(r) for r in members.select(*keys).distinct().collect())  # a row a piece
    names = ", ".join(f"{c} {types[c]}" for c in keys)
    if not found:
        return members.select(*keys, F.lit(0).alias("cand"), "node", F.array().cast("array<double>").alias("x"), F.lit(0.0).alias("beta"))
    named = F.broadcast(members.sparkSession.createDataFrame([(*key, p) for p, key in enumerate(found)], f"{names}, piece int"))
    rows = members.select(*keys, "node").join(named, list(keys)).select("piece", "node", F.lit(1.0).alias("f"))
    links = written(arcs(edges.select(*keys, "src", "dst").join(named, list(keys)).select("piece", "src", "dst")), "latent-arcs")
    vectors, solved = leading_eigenpairs(rows, links, {}, max(cands) + 1)
    roots = F.create_map(*[x for p, (v, _) in solved.items() for x in (F.lit(p), F.array(*[F.lit(float(np.sqrt(abs(e)))) for e in v]))])
    scaled = written(vectors.select("piece", "node", F.zip_with("x", F.element_at(roots, F.col("piece")), lambda u, e: u * e).alias("x")), "latent-start")
    parts = []
    for d in cands:
        z = scaled.select("piece", "node", F.slice("x", 2, d).alias("z"))
        spread = z.select("piece", F.explode("z").alias("v")).groupBy("piece").agg(F.greatest(F.stddev_pop("v"), F.lit(1e-9)).alias("sd"))
        parts.append(z.join(F.broadcast(spread), "piece").select("piece", F.lit(d).alias("cand"), "node", F.transform("z", lambda v: v / F.col("sd")).alias("z")))
    start = parts[0]
    for p in parts[1:]:
        start = start.unionByName(p)
    start = written(start, "latent-start")
    large = (start.groupBy("piece", "cand").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > most_nodes
    each = links.withColumn("cand", F.explode(F.array(*map(F.lit, cands))))
    placed = _in_tiles(start, each, steps, rate, tile) if large else _in_tasks(start, each, steps, rate)
    middle = placed.groupBy("piece", "cand", F.size("x").alias("d")).agg(*[F.avg(F.get("x", F.lit(i))).alias(f"c{i}") for i in range(max(cands))])
    centre = F.broadcast(middle.select("piece", "cand", F.slice(F.array(*[f"c{i}" for i in range(max(cands))]), F.lit(1), F.col("d")).alias("c")))
    moved = placed.join(centre, ["piece", "cand"]).select("piece", "cand", "node", F.zip_with("x", "c", lambda u, v: u - v).alias("x"), "beta")
    return moved.join(named, "piece").select(*keys, "cand", "node", "x", "beta")


def _in_tasks(start: DataFrame, links: DataFrame, steps: int, rate: float) -> DataFrame:
    def fit(key, nodes: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node")
        ids, z, b = nodes["node"].to_numpy(), np.stack(nodes["z"].to_numpy()), 0.0
        n, linked = len(ids), np.zeros((len(ids), len(ids)))
        linked[np.searchsorted(ids, found["src"].to_numpy()), np.searchsorted(ids, found["dst"].to_numpy())] = 1.0
        m, s, off = np.zeros_like(z), np.zeros_like(z), 1 - np.eye(n)
        for t in range(1, steps + 1):
            g, e = pull(z, z, linked, b, off)
            z, m, s = step(z, m, s, g, t, rate)
            b += rate * 20 * e.sum() / (n * max(n - 1, 1))
        return pd.DataFrame({"piece": key[0], "cand": key[1], "node": ids, "x": list(z), "beta": float(b)})

    kind = dict(start.dtypes)["node"]
    return written(start.groupBy("piece", "cand").cogroup(links.groupBy("piece", "cand")).applyInPandas(fit, f"piece int, cand int, node {kind}, x array<double>, beta double"), "latent-positions")


def _in_tiles(start: DataFrame, links: DataFrame, steps: int, rate: float, tile: int) -> DataFrame:
    """Every step is a job: gradients by tiles, summed by node, and the nodes' step. Only sums of errors of a piece come to the driver."""
    on = ["piece", "cand"]
    sizes = {(r["piece"], r["cand"]): r["n"] for r in start.groupBy(*on).agg(F.count("*").alias("n")).collect()}  # a row a piece and dimension
    tiles = max(1, -(-max(sizes.values()) // tile))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(tiles)).cast("int")
    every, kind = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))), dict(start.dtypes)["node"]
    found = written(links.select(*on, part("src").alias("ti"), part("dst").alias("tj"), "src", "dst"), "latent-tiles")
    zero = F.transform("z", lambda v: F.lit(0.0))
    state = written(start.select(*on, "node", "z", zero.alias("m"), zero.alias("s"), F.lit(0.0).alias("e")), "latent-state")
    levels = dict.fromkeys(sizes, 0.0)
    for t in range(1, steps + 1):
        rows = state.select(*on, part("node").alias("ti"), every.alias("tj"), F.lit(0).alias("side"), "node", "z").unionByName(state.select(*on, every.alias("ti"), part("node").alias("tj"), F.lit(1).alias("side"), "node", "z"))

        def pulls(key, both: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            both = both.sort_values("node")
            a, b = both[both["side"] == 0], both[both["side"] == 1]
            if not len(a) or not len(b):
                return pd.DataFrame({"piece": [], "cand": [], "node": [], "g": [], "e": []}, dtype=object)
            i, j, linked = a["node"].to_numpy(), b["node"].to_numpy(), np.zeros((len(a), len(b)))
            linked[np.searchsorted(i, own["src"].to_numpy()), np.searchsorted(j, own["dst"].to_numpy())] = 1.0
            g, e = pull(np.stack(a["z"].to_numpy()), np.stack(b["z"].to_numpy()), linked, levels[int(key[0]), int(key[1])], (i[:, None] != j).astype(float))
            return pd.DataFrame({"piece": key[0], "cand": key[1], "node": i, "g": list(g), "e": e})

        def moves(batches, t=t):
            for pdf in batches:
                for _, own in pdf.groupby(on):
                    z, m, s = step(*(np.stack(own[c].to_numpy()) for c in ("z", "m", "s", "g")), t, rate)
                    yield pd.DataFrame({**{c: own[c].to_numpy() for c in (*on, "node")}, "z": list(z), "m": list(m), "s": list(s), "e": own["e"].to_numpy()})

        parts = rows.groupBy(*on, "ti", "tj").cogroup(found.groupBy(*on, "ti", "tj")).applyInPandas(pulls, f"piece int, cand int, node {kind}, g array<double>, e double")
        entries = parts.select(*on, "node", "e", F.posexplode("g").alias("at", "v")).groupBy(*on, "node", "at").agg(F.sum("v").alias("v"), F.sum("e").alias("e"))
        sums = entries.groupBy(*on, "node").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda c: c["v"]).alias("g"), F.max("e").alias("e"))
        state = written(state.drop("e").join(sums, [*on, "node"]).mapInPandas(moves, f"piece int, cand int, node {kind}, z array<double>, m array<double>, s array<double>, e double"), "latent-state")
        for r in state.groupBy(*on).agg(F.sum("e").alias("e")).collect():  # a row a piece and dimension
            n = sizes[r["piece"], r["cand"]]
            levels[r["piece"], r["cand"]] += rate * 20 * r["e"] / (n * max(n - 1, 1))
    table = start.sparkSession.createDataFrame([(p, c, float(b)) for (p, c), b in levels.items()], "piece int, cand int, beta double")
    return state.select(*on, "node", F.col("z").alias("x")).join(F.broadcast(table), on)
