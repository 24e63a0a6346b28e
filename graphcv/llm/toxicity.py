"""Toxicity by a factorization machine over hashed terms.

Terms are lower-case words hashed into 2**30 places. On a bounded sample of labelled rows, the machine learns a weight for
each place and a short vector whose products weigh pairs of places (an insult together with the mention of a group).
It learns the places that go with the label more than chance gives, alone or in a pair: a term that tells nothing by
itself stays if it does together with another. It scores every document from the set of learnt places that its whole
text holds.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphcv.llm.shared import ship, written

WORD = re.compile(r"\w+")
PLACES = 1 << 30


def places(text: str | None) -> set[int]:
    """Hashed distinct terms of a whole text; none of a null."""
    return {zlib.crc32(w.encode("utf-8", "replace")) % PLACES for w in set(WORD.findall((text or "").lower()))}


def loss_gradient(x: np.ndarray, y: np.ndarray, p: list[np.ndarray], weight: float = 1.0) -> tuple[float, list[np.ndarray]]:
    """Mean logistic loss of the machine p = [bias, w, v] on rows x of zeros and ones, with small ridge terms, and its gradient.
    weight: of a row with label 1."""
    b, w, v = p
    q = x @ v
    z = b[0] + x @ w + 0.5 * ((q * q).sum(1) - x @ (v * v).sum(1))
    of = np.where(y > 0, weight, 1.0) / len(y)
    loss = float((of * (np.logaddexp(0, z) - y * z)).sum() + 0.5e-5 * (w * w).sum() + 0.5e-4 * (v * v).sum())
    g = (of * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)).astype(x.dtype)
    xg = x.T @ g
    return loss, [np.array([g.sum()]), xg + 1e-5 * w, x.T @ (g[:, None] * q) - xg[:, None] * v + 1e-4 * v]


def fit_machine(rows: list[np.ndarray], labels: np.ndarray, n_features: int, rank: int = 8, steps: int = 300, batch: int = 1_024, weight: float = 2.0, seed: int = 7):
    """Weights (bias, w, v) by Adam on batches of rows. rows: feature numbers. `weight` counts a toxic row more than another, as a
    missed one costs more than a false alarm."""
    y = labels.astype(np.float32)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    rng = np.random.default_rng(seed)
    p = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(n_features, np.float32), rng.normal(0, 0.01, (n_features, rank)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    order = np.arange(len(rows))
    for t in range(1, steps + 1):
        at = (t - 1) * batch % max(1, len(rows))
        if at < batch:
            rng.shuffle(order)
        own = order[at : at + batch]
        x = dense([rows[i] for i in own], n_features)  # some 16 MB for 4,000 features
        _, grads = loss_gradient(x, y[own], p, weight)
        rate = 0.05 * (1 - 0.9 * t / steps)
        for a, d, i in zip(p, grads, range(3), strict=True):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.999 * s[i] + 0.001 * d * d
            a -= (rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return float(p[0][0]), p[1], p[2]


def dense(rows: list[np.ndarray], n_features: int) -> np.ndarray:
    x = np.zeros((len(rows), n_features), dtype=np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    return x


def paired(rows: list[np.ndarray], labels: np.ndarray, n_features: int, least: int = 20) -> np.ndarray:
    """Which features tell the label in a pair: rows with both are toxic more (or less) often than what each of the two adds alone,
    by more than the best of so many pairs does by chance."""
    y = labels.astype(np.float32)
    both, bad = np.zeros((n_features, n_features), np.float32), np.zeros((n_features, n_features), np.float32)
    for i in range(0, len(rows), 1_024):
        x = dense(rows[i : i + 1_024], n_features)
        both += x.T @ x
        bad += x.T @ (x * y[i : i + 1_024, None])
    n, a = np.diag(both).astype(float), np.diag(bad).astype(float)
    base, tells = y.mean(), np.zeros(n_features, bool)
    own = a / np.maximum(n, 1) - base
    for i in range(n_features):  # a row of pairs at a time
        expected = np.clip(base + own[i] + own, 0.5 * base, 1 - 0.5 * base)
        gain = (bad[i] - both[i] * expected) ** 2 / np.maximum(both[i] * expected * (1 - expected), 1e-9)
        gain[both[i] < least] = 0
        gain[i] = 0
        tells[i] = gain.max(initial=0) > 4 * np.log(max(2, n_features)) + 10
    return np.flatnonzero(tells)


def machine_score(found: list[int], model) -> float:
    b, w, v = model
    q = v[found].sum(0)
    z = b + float(w[found].sum()) + 0.5 * float((q * q).sum() - (v[found] ** 2).sum())
    return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def train_toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = 40_000, common: float = 0.02):
    """Learn from rows of `labels` (doc_id, toxic) joined to `docs` whose crc32(doc_id) mod 5 is not 0.

    At most `max_rows` labelled rows are used, those whose doc_id has the least hash, so the joined side may be broadcast and
    one task can fit the machine. Places in three rows or more are learnt if they go with the label by chi-square above
    chance, or if they are in a share `common` of the rows and tell in a pair (see `paired`); their number is bounded by
    the sample alone. Null labels and ids are left out. Returns (kept places, (bias, w, v)); without usable rows of both
    labels the score is the share of toxic ones.
    """
    ship(docs.sparkSession)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic is not null and doc_id is not null").where(fold != 0)
    sample = written(marked.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows), "toxic-sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")

    def terms(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "terms": [sorted(places(t)) for t in b["text"]]})

    found = written(rows.mapInPandas(terms, "doc_id long, toxic int, terms array<int>"), "toxic-terms")
    totals = found.agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("int")).alias("pos")).first()
    n, pos = totals["n"], totals["pos"] or 0
    nothing = np.zeros(0, np.float32), np.zeros((0, 8), np.float32)
    if not pos or pos == n:
        return [], (30.0 if pos else -30.0, *nothing)
    seen = found.select((F.col("toxic") > 0).cast("int").alias("y"), F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("y").alias("a"))
    a, c = F.col("a").cast("double"), F.col("c").cast("double")
    expected = c * (pos / n)
    chi = (a - expected) * (a - expected) / (expected * (1 - pos / n) * F.greatest(1 - c / n, F.lit(1e-9)))
    rated = written(seen.where("c >= 3").select("term", "c", chi.alias("chi")), "toxic-places")
    chance = 2 * np.log(max(2, rated.count()))  # about what the best of as many places reaches by chance
    best = rated.where((F.col("chi") >= float(chance)) | (F.col("c") >= common * n)).select("term", (F.col("chi") >= float(chance)).alias("alone"), (F.col("c") >= common * n).alias("common")).toArrow().sort_by("term")
    known = best["term"].to_numpy()

    def numbered(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "terms": [np.flatnonzero(np.isin(known, t, assume_unique=True)).astype(np.int32).tobytes() for t in b["terms"]]})

    common_places = best["common"].to_numpy()
    alone = best["alone"].to_numpy()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        """The whole bounded sample in one task: max_rows at most but for repeated ids."""
        pdf = pdf.sort_values(["doc_id", "toxic", "terms"])[:max_rows]
        lists, y = [np.frombuffer(t, dtype=np.int32) for t in pdf["terms"]], pdf["toxic"].to_numpy() > 0
        often, keep = np.flatnonzero(common_places), alone.copy()
        if len(often):
            keep[often[paired(_renumbered(lists, often, len(known)), y, len(often))]] = True
        kept = np.flatnonzero(keep)
        b, w, v = fit_machine(_renumbered(lists, kept, len(known)), y, len(kept)) if len(kept) else (float(np.log(pos / (n - pos))), *nothing)
        return pd.DataFrame({"kept": [known[kept]], "b": [b], "w": [w], "v": [v.ravel()]})

    sample = found.mapInPandas(numbered, "doc_id long, toxic int, terms binary").withColumn("one", F.lit(0)).groupBy("one").applyInPandas(fit, "kept array<int>, b double, w array<float>, v array<float>")
    r = sample.first()
    w = np.array(r["w"], np.float32)
    return list(r["kept"]), (r["b"], w, np.array(r["v"], np.float32).reshape(len(w), -1) if len(w) else nothing[1])


def _renumbered(lists: list[np.ndarray], chosen: np.ndarray, n: int) -> list[np.ndarray]:
    """The numbers of each list that are `chosen`, by their place there."""
    to = np.full(n, -1)
    to[chosen] = np.arange(len(chosen))
    return [(t := to[r])[t >= 0].astype(np.int32) for r in lists]


def score_toxicity(docs: DataFrame, trained) -> DataFrame:
    """All columns of `docs` and `score` (0 to 1), from the whole `text` alone.

    Null and empty texts get the score of a text without terms; repeated rows stay; an empty table stays empty. A column
    `score` that `docs` already has is replaced. No shuffle; the machine has some ten numbers for each learnt place.
    """
    ship(docs.sparkSession)
    kept, model = trained
    number = {t: i for i, t in enumerate(kept)}
    keep = frozenset(kept)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([machine_score(sorted(number[t] for t in places(x) & keep), model) for x in texts], dtype="float64")

    return docs.withColumn("score", score(F.col("text")))
