"""Calibration, prior correction and decision analysis."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ordering import running_totals

EPS = 1e-12


def clip_probability(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS))


def logit(p: Column) -> Column:
    q = clip_probability(p)
    return F.log(q / (F.lit(1.0) - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def prior_correction(p: Column, pi_train: Column | float, pi_real: float = 0.015) -> Column:
    """Move a probability from the training prevalence to the real one in log-odds."""
    train = pi_train if isinstance(pi_train, Column) else F.lit(float(pi_train))
    shift = F.lit(math.log(pi_real / (1.0 - pi_real))) - F.log(train / (F.lit(1.0) - train))
    return sigmoid(logit(p) + shift)


def predictive_value(sensitivity: Column, specificity: Column, prevalence: Column | float = 0.015) -> Column:
    prev = prevalence if isinstance(prevalence, Column) else F.lit(float(prevalence))
    tp = sensitivity * prev
    fp = (F.lit(1.0) - specificity) * (F.lit(1.0) - prev)
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))


def edges(n_bins: int) -> list[float]:
    return [float(x) for x in np.linspace(0.0, 1.0, n_bins + 1)]


def bin_index(value: Column, cuts: Sequence[float]) -> Column:
    """0-based bin with right-open bins; the last bin is closed."""
    below = F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda e: e <= value)
    return F.greatest(F.least(F.size(below) - 1, F.lit(len(cuts) - 2)), F.lit(0))


def _bins(df: DataFrame, label: str, prob: str, n_bins: int, keys: Sequence[str]) -> DataFrame:
    return (
        df.where(F.col(prob).isNotNull())
        .groupBy(*keys, bin_index(F.col(prob), edges(n_bins)).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.col(label).cast("double")).alias("observed"),
            F.avg(prob).alias("predicted"),
        )
    )


def reliability_curve(df: DataFrame, label: str, prob: str, n_bins: int = 10) -> DataFrame:
    """One row per bin, empty bins included, with the ECE on every row."""
    cuts = edges(n_bins)
    grid = df.sparkSession.createDataFrame(
        [(i, (cuts[i] + cuts[i + 1]) / 2.0) for i in range(n_bins)], "bin int, midpoint double"
    )
    found = _bins(df, label, prob, n_bins, [])
    total = found.agg(
        (F.sum(F.col("n") * F.abs(F.col("observed") - F.col("predicted"))) / F.sum("n")).alias("ece")
    )
    rows = F.broadcast(grid).join(found, "bin", "left").select(
        "bin", "observed", F.coalesce("predicted", "midpoint").alias("predicted"),
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
    )
    return rows.withColumn("ece", total.scalar())


def brier_decomposition(df: DataFrame, label: str, prob: str, n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """Brier score and its reliability / resolution / uncertainty parts, one pass.

    Everything follows from per-bin sums, so the bins are the only shuffle.
    """
    y, p = F.col(label).cast("double"), F.col(prob)
    bins = (
        df.where(p.isNotNull())
        .groupBy(*keys, bin_index(p, edges(n_bins)).alias("bin"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum(y).alias("sy"), F.sum(p).alias("sp"),
            F.sum(y * y).alias("syy"), F.sum((p - y) * (p - y)).alias("sq"),
        )
        .withColumn("yb", F.col("sy") / F.col("n"))
        .withColumn("pb", F.col("sp") / F.col("n"))
    )
    n, sy = F.sum("n"), F.sum("sy")
    gap = F.col("pb") - F.col("yb")
    # sum((pb - y)^2) within a bin from its sums
    binned = F.col("n") * F.col("pb") * F.col("pb") - 2 * F.col("pb") * F.col("sy") + F.col("syy")
    mean = sy / n
    return bins.groupBy(*keys).agg(
        (F.sum("sq") / n).alias("brier"),
        (F.sum(binned) / n).alias("brier_binned"),
        (F.sum(F.col("n") * gap * gap) / n).alias("reliability"),
        (F.sum(F.col("n") * F.col("yb") * F.col("yb")) / n - mean * mean).alias("resolution"),
        (mean * (F.lit(1.0) - mean)).alias("uncertainty"),
    )


def decision_curve(df: DataFrame, label: str, prob: str, thresholds: Sequence[float], prevalence: float | None = None) -> DataFrame:
    """Net benefit of the model, of treating all and of treating none.

    A row counts for every threshold at or below its score, so each row is put
    into the bin of its highest threshold and the bins (one per threshold) are
    summed from the top: one aggregate, no row is copied per threshold.
    """
    cuts = sorted(float(t) for t in thresholds)
    tree = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(prob)))
    y = F.col(label)
    per_bin = df.where(F.col(prob).isNotNull()).groupBy(tree.alias("bin")).agg(
        F.sum(F.when(y == 1, 1).otherwise(0)).alias("tp"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("fp")
    )
    grid = df.sparkSession.createDataFrame(
        [(i, cuts[i - 1] if i else None) for i in range(len(cuts) + 1)],
        T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("threshold", T.DoubleType())]),
    )
    full = F.broadcast(grid).join(per_bin, "bin", "left").na.fill(0, ["tp", "fp"]).withColumn("one", F.lit(1))
    cum = running_totals(
        full, ["one"], "bin",
        {"tp": F.sum("tp"), "fp": F.sum("fp"), "t": F.max("threshold")},
        descending=True, bounded=True,
    )
    totals = per_bin.agg(F.struct(F.sum("tp").alias("p"), F.sum("fp").alias("q"))).scalar()
    n = (totals["p"] + totals["q"]).cast("double")
    w = F.col("t") / (F.lit(1.0) - F.col("t"))
    prev = totals["p"] / n if prevalence is None else F.lit(float(prevalence))
    return cum.where("t IS NOT NULL").select(
        F.col("t").alias("threshold"),
        (F.col("cum_tp") / n - F.col("cum_fp") / n * w).alias("net_benefit_model"),
        (prev - (F.lit(1.0) - prev) * w).alias("net_benefit_all"),
        F.lit(0.0).alias("net_benefit_none"),
    )
