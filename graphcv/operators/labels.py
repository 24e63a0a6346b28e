"""Aligning labelings and measuring their agreement."""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, lab, fixed, n: how many shared nodes have label `lab` in `a` and `fixed` in `b`."""
    met = a.select(*keys, "node", F.col("g").alias("lab")).join(b.select(*keys, "node", F.col("g").alias("fixed")), [*keys, "node"])
    return met.groupBy(*keys, "lab", "fixed").agg(F.count("*").alias("n"))


def match_table(cells: dict[tuple[int, int], int], k: int) -> dict[int, int]:
    """One-to-one map of labels: again and again the largest cell, of equals the least fixed, then the least lab.

    One label keeps itself; of two labels both keep themselves unless more than half of the nodes differ; equal
    labelings keep all.
    """
    if k == 1 or all(a == b for (a, b), n in cells.items() if n):
        return {i: i for i in range(1, k + 1)}
    if k == 2:
        differ = sum(n for (a, b), n in cells.items() if a != b)
        return {1: 1, 2: 2} if 2 * differ <= sum(cells.values()) else {1: 2, 2: 1}
    labs, fixed, out = set(range(1, k + 1)), set(range(1, k + 1)), {}
    for a, b in sorted(product(labs, fixed), key=lambda c: (-cells.get(c, 0), c[1], c[0])):
        if a in labs and b in fixed:
            out[a] = b
            labs.remove(a)
            fixed.remove(b)
    return out


def greedy_match(counts: DataFrame, keys: tuple[str, ...], k: str | None = None) -> DataFrame:
    """keys, lab, to: the map of `match_table` for each group of a confusion table. `k` names a key that holds the number of
    labels; without it the largest label counts. A group is a k x k table, however many nodes it stands for."""

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = {(int(a), int(b)): int(n) for a, b, n in zip(pdf["lab"], pdf["fixed"], pdf["n"], strict=True)}
        size = max([int(pdf[k].iloc[0])] if k else [0]) or max(max(c) for c in cells)
        found = match_table(cells, max(size, *(max(c) for c in cells)))
        out = pd.DataFrame({"lab": list(found), "to": list(found.values())})
        for i, name in enumerate(keys):
            out.insert(i, name, pdf[name].iloc[0])
        return out

    types = dict(counts.dtypes)
    schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "lab int", "to int"])
    return counts.groupBy(*keys).applyInPandas(match, schema)


def relabel(labels: DataFrame, mapping: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """`labels` with g replaced where the mapping (keys, lab, to) has it. The mapping has a row for each label of a group."""
    met = labels.join(mapping.withColumnRenamed("lab", "g"), [*keys, "g"], "left")
    return met.withColumn("g", F.coalesce("to", "g").cast("int")).select(*labels.columns)


def align_subs(labels: DataFrame, keys: tuple[str, ...] = ("rep", "model", "cand"), k: str = "cand") -> DataFrame:
    """Labels of every piece renamed to agree best with piece 1 on the shared nodes. labels: keys, sub, node, shared, g."""
    shared = labels.where("shared")
    first = shared.where("sub = 1").select(*keys, "node", F.col("g").alias("fixed"))
    met = shared.where("sub > 1").select(*keys, "sub", "node", F.col("g").alias("lab")).join(first, [*keys, "node"])
    counts = met.groupBy(*keys, "sub", "lab", "fixed").agg(F.count("*").alias("n"))
    return relabel(labels, greedy_match(counts, (*keys, "sub"), k if k in keys else None), (*keys, "sub"))


def combine_labels(labels: DataFrame, keys: tuple[str, ...] = ("rep", "model", "cand")) -> DataFrame:
    """keys, node, g: shared nodes take piece 1's label, the others their fold's."""
    return labels.where(~F.col("shared") | (F.col("sub") == 1)).select(*keys, "node", "g")


def majority_label(labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, node, g: the most frequent label over reps; of equals the one seen in the earliest rep."""
    votes = labels.groupBy(*keys, "node", "g").agg(F.count("*").alias("n"), F.min("rep").alias("first"))
    return votes.groupBy(*keys, "node").agg(F.max_by("g", F.struct("n", -F.col("first"))).alias("g"))


def label_accuracy(labels: DataFrame, truth: DataFrame, keys: tuple[str, ...] = (), k: str | None = None) -> DataFrame:
    """keys, accuracy: the share of nodes whose matched label equals the truth (node, g)."""
    met = labels.select(*keys, "node", F.col("g").alias("lab")).join(truth.select("node", F.col("g").alias("fixed")), "node")
    counts = met.groupBy(*keys, "lab", "fixed").agg(F.count("*").alias("n"))
    one = keys or ("_all",)
    counts = counts if keys else counts.withColumn("_all", F.lit(1))
    met = counts.join(greedy_match(counts, one, k), [*one, "lab"])
    return met.groupBy(*one).agg((F.sum(F.when(F.col("to") == F.col("fixed"), F.col("n")).otherwise(0)) / F.sum("n")).alias("accuracy")).select(*keys, "accuracy")


def _entropy(counts: DataFrame, keys: tuple[str, ...], by: tuple[str, ...], name: str) -> DataFrame:
    sums = counts.groupBy(*keys, *by).agg(F.sum("n").cast("double").alias("n"))
    total = F.sum("n")
    return sums.groupBy(*keys).agg((F.log(total) - F.sum(F.col("n") * F.log("n")) / total).alias(name))


def nmi(counts: DataFrame, keys: tuple[str, ...], norm: str = "mean") -> DataFrame:
    """keys, nmi: mutual information of the confusion table over the mean (or "max", "min", "sqrt") of both entropies; 1 if both are 0."""
    counts = counts.where("n > 0")
    met = _entropy(counts, keys, ("lab",), "h1").join(_entropy(counts, keys, ("fixed",), "h2"), list(keys)).join(_entropy(counts, keys, ("lab", "fixed"), "h12"), list(keys))
    h1, h2 = F.col("h1"), F.col("h2")
    base = {"mean": (h1 + h2) / 2, "max": F.greatest(h1, h2), "min": F.least(h1, h2), "sqrt": F.sqrt(h1 * h2)}[norm]
    return met.select(*keys, F.when(base > 1e-12, (h1 + h2 - F.col("h12")) / base).otherwise(1.0).alias("nmi"))


def fold_confusion(labels: DataFrame, whole: DataFrame, keys: tuple[str, ...] = ("rep", "cand")) -> DataFrame:
    """keys, sub, lab, fixed, n on the nodes of each fold: piece labels against whole-graph labels (keys of `whole` besides node, g join)."""
    on = [c for c in keys if c in whole.columns] + ["node"]
    own = labels.where(~F.col("shared")).select(*keys, "sub", "node", F.col("g").alias("lab"))
    return own.join(whole.withColumnRenamed("g", "fixed"), on).groupBy(*keys, "sub", "lab", "fixed").agg(F.count("*").alias("n"))


def _pair_tables(counts: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, p, q and the joint table of pair codes: products of two folds' tables, no pair of nodes is made."""
    largest = counts.groupBy(*keys, "sub").agg(F.max("lab").alias("max_lab"), F.max("fixed").alias("max_fixed"))
    one = counts.select(*keys, F.col("sub").alias("p"), F.col("lab").alias("l1"), F.col("fixed").alias("f1"), F.col("n").alias("n1"))
    two = counts.join(largest, [*keys, "sub"]).select(*keys, F.col("sub").alias("q"), F.col("lab").alias("l2"), F.col("fixed").alias("f2"), F.col("n").alias("n2"), "max_lab", "max_fixed")
    met = one.join(two, list(keys)).where("p < q")
    code = lambda a, b, m: ((F.col(a) - 1) * F.col(m) + F.col(b)).cast("int")
    return met.groupBy(*keys, "p", "q", code("l1", "l2", "max_lab").alias("lab"), code("f1", "f2", "max_fixed").alias("fixed")).agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))


def pair_nmi_loss(counts: DataFrame, keys: tuple[str, ...] = ("rep", "cand"), norm: str = "mean") -> DataFrame:
    """keys, p, q, value: minus the NMI of the pair codes of folds p < q; counts: see `fold_confusion`."""
    return nmi(_pair_tables(counts, keys), (*keys, "p", "q"), norm).select(*keys, "p", "q", (-F.col("nmi")).alias("value"))


def pair_hamming_loss(counts: DataFrame, keys: tuple[str, ...] = ("rep", "cand")) -> DataFrame:
    """keys, p, q, value: the share of pair codes that differ after matching the codes."""
    table, on = _pair_tables(counts, keys), (*keys, "p", "q")
    met = table.join(greedy_match(table, on), [*on, "lab"])
    return met.groupBy(*on).agg((1 - F.sum(F.when(F.col("to") == F.col("fixed"), F.col("n")).otherwise(0)) / F.sum("n")).alias("value"))


def align_reps(labels: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Labels (rep, keys, node, g) of all reps renamed to agree best with rep 1."""
    first = labels.where("rep = 1").select(*keys, "node", F.col("g").alias("fixed"))
    met = labels.where("rep > 1").select("rep", *keys, "node", F.col("g").alias("lab")).join(first, [*keys, "node"])
    counts = met.groupBy("rep", *keys, "lab", "fixed").agg(F.count("*").alias("n"))
    return relabel(labels, greedy_match(counts, ("rep", *keys)), ("rep", *keys))
