"""From losses to choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rep_loss(losses: DataFrame, s: int, how: str = "mean", keys: tuple[str, ...] = ("rep", "model", "cand", "loss")) -> DataFrame:
    """keys, value: the mean over the s (s - 1) / 2 held-out blocks, or their sum."""
    total = F.sum("value")
    return losses.groupBy(*keys).agg((total / (s * (s - 1) / 2) if how == "mean" else total).alias("value"))


def fold_loss(losses: DataFrame, summed: tuple[str, ...] = (), keys: tuple[str, ...] = ("model", "cand", "loss")) -> DataFrame:
    """keys, value: the mean over folds, for the losses named in `summed` the sum."""
    return losses.groupBy(*keys).agg(F.when(F.first("loss").isin(*summed) if summed else F.lit(False), F.sum("value")).otherwise(F.avg("value")).alias("value"))


def argmin_candidate(losses: DataFrame, keys: tuple[str, ...], cand: str = "cand") -> DataFrame:
    """keys, cand, value: the least loss, the first candidate of equals; a null loss comes last. Equal to 12 digits is equal."""
    order = F.struct(F.col("value").isNull().alias("none"), F.round("value", 12).alias("value"), F.col(cand).alias("cand"))
    best = losses.groupBy(*keys).agg(F.min(order).alias("best"))
    return best.select(*keys, F.col("best.cand").alias(cand), F.col("best.value").alias("value"))


def choose_model(losses: DataFrame, keys: tuple[str, ...] = ("rep", "loss")) -> DataFrame:
    """keys, choice: "SBM-K", or "DCSBM-K" where the degree-corrected model is strictly better."""
    best = argmin_candidate(losses, (*keys, "model"))
    pick = lambda m: [F.max(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{c}") for c in ("cand", "value")]
    wide = best.groupBy(*keys).agg(*pick("sbm"), *pick("dcbm"))
    better = F.coalesce(F.col("dcbm_value") < F.col("sbm_value"), F.col("sbm_value").isNull() & F.col("dcbm_value").isNotNull())
    name = F.when(better, F.concat(F.lit("DCSBM-"), F.col("dcbm_cand").cast("string"))).otherwise(F.concat(F.lit("SBM-"), F.col("sbm_cand").cast("string")))
    return wide.select(*keys, name.alias("choice"))


def mode_over_reps(choices: DataFrame, keys: tuple[str, ...] = ("loss",), value: str = "choice") -> DataFrame:
    """keys, value: the most frequent choice over reps, of equals the one of the earliest rep."""
    votes = choices.groupBy(*keys, value).agg(F.count("*").alias("n"), F.min("rep").alias("first"))
    return votes.groupBy(*keys).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))


def mean_over_reps(choices: DataFrame, keys: tuple[str, ...] = ("loss",), value: str = "cand") -> DataFrame:
    return choices.groupBy(*keys).agg(F.avg(value).alias(f"mean_{value}"))


def loss_table(losses: DataFrame, reps: int, names: list[str]) -> DataFrame:
    """model, cand and a column "<loss>-Rep=<r>" for each loss and rep."""
    cells = losses.withColumn("cell", F.concat("loss", F.lit("-Rep="), F.col("rep").cast("string")))
    return cells.groupBy("model", "cand").pivot("cell", [f"{x}-Rep={r}" for r in range(1, reps + 1) for x in names]).agg(F.first("value"))
