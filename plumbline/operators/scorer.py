"""A scorer that is fitted by one aggregate: diagonal Gaussian log odds.

Fitting needs only count, mean and squared deviation per (cell, fold, class,
feature). Training statistics of a fold are the totals of its cell with the fold
taken out again, so K folds cost one pass. Mean and deviation are merged and taken
out with the pairwise update formula, which does not cancel like raw squares.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FLOOR = 1e-9


def moments(df: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """``keys, n, m_<f>, q_<f>``: count, mean and squared deviation."""
    aggs = [F.count(F.lit(1)).cast("double").alias("n")]
    for f in features:
        aggs += [F.avg(f).alias(f"m_{f}"), (F.var_pop(f) * F.count(F.lit(1))).alias(f"q_{f}")]
    return df.groupBy(*keys).agg(*aggs)


def class_moments(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label") -> DataFrame:
    """Moments of both classes in one row: ``n<y>, m<y>_<f>, q<y>_<f>``; an empty class is 0."""
    aggs = []
    for y in (0, 1):
        here = F.col(label) == y
        n = F.count_if(here).cast("double")
        aggs.append(n.alias(f"n{y}"))
        for f in features:
            x = F.when(here, F.col(f))
            aggs += [
                F.coalesce(F.avg(x), F.lit(0.0)).alias(f"m{y}_{f}"),
                F.coalesce(F.var_pop(x) * n, F.lit(0.0)).alias(f"q{y}_{f}"),
            ]
    return df.groupBy(*keys).agg(*aggs)


def merge(parts: DataFrame, keys: Sequence[str], features: Sequence[str], label: str, n_keys: int) -> DataFrame:
    """Class moments of the union of disjoint parts ``label, n, m_<f>, q_<f>``.

    Two levels: the merged mean first, then deviations around it. ``n_keys`` is the
    number of distinct keys by design and decides how the means travel back.
    """
    def w(y):
        return F.when(F.col(label) == y, F.col("n")).otherwise(0.0)

    means = parts.groupBy(*keys).agg(*[
        F.coalesce(F.try_divide(F.sum(w(y) * F.col(f"m_{f}")), F.sum(w(y))), F.lit(0.0)).alias(f"_M{y}_{f}")
        for y in (0, 1) for f in features
    ])
    joined = attach(parts, means, keys, n_keys, len(features))
    aggs = []
    for y in (0, 1):
        aggs.append(F.sum(w(y)).alias(f"n{y}"))
        for f in features:
            gap = F.col(f"m_{f}") - F.col(f"_M{y}_{f}")
            spread = F.when(F.col(label) == y, F.col(f"q_{f}") + F.col("n") * gap * gap).otherwise(0.0)
            aggs += [F.max(f"_M{y}_{f}").alias(f"m{y}_{f}"), F.sum(spread).alias(f"q{y}_{f}")]
    return joined.groupBy(*keys).agg(*aggs)


def held_out_models(per_fold: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One model per ``(keys, fold)``, trained on the other folds.

    ``per_fold`` holds class moments per ``(keys, fold)``: the windows below are over
    the handful of folds of a key.
    """
    w = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    pairs = [(y, f) for y in (0, 1) for f in features]
    total = per_fold.select("*", *[F.sum(f"n{y}").over(w).alias(f"_N{y}") for y in (0, 1)])
    total = total.select("*", *[
        F.coalesce(F.try_divide(F.sum(F.col(f"n{y}") * F.col(f"m{y}_{f}")).over(w), F.col(f"_N{y}")), F.lit(0.0)).alias(f"_M{y}_{f}")
        for y, f in pairs
    ])

    def spread(y, f):
        gap = F.col(f"m{y}_{f}") - F.col(f"_M{y}_{f}")
        return F.col(f"q{y}_{f}") + F.col(f"n{y}") * gap * gap

    total = total.select("*", *[F.sum(spread(y, f)).over(w).alias(f"_Q{y}_{f}") for y, f in pairs])
    cols = [(F.col(f"_N{y}") - F.col(f"n{y}")).alias(f"n{y}") for y in (0, 1)]
    for y, f in pairs:
        n, big = F.col(f"n{y}"), F.col(f"_N{y}")
        mean = F.try_divide(big * F.col(f"_M{y}_{f}") - n * F.col(f"m{y}_{f}"), big - n)
        gap = F.col(f"m{y}_{f}") - mean
        left = F.col(f"_Q{y}_{f}") - F.col(f"q{y}_{f}") - gap * gap * n * F.try_divide(big - n, big)
        cols += [mean.alias(f"m{y}_{f}"), F.greatest(left, F.lit(0.0)).alias(f"q{y}_{f}")]
    return to_models(total.select(*keys, "fold", *cols), [*keys, "fold"], features)


def to_models(stats: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Class moments to model parameters ``_prior, _<f>_{m,v,l}{0,1}``; ``l`` is log variance."""
    both = (F.col("n0") > 0) & (F.col("n1") > 0)
    cols = [F.when(both, F.log("n1") - F.log("n0")).alias("_prior")]
    for f in features:
        for y in (0, 1):
            var = F.try_divide(F.col(f"q{y}_{f}"), F.col(f"n{y}")) + F.lit(FLOOR)
            cols += [F.col(f"m{y}_{f}").alias(f"_{f}_m{y}"), var.alias(f"_{f}_v{y}"), F.log(var).alias(f"_{f}_l{y}")]
    return stats.select(*keys, *cols)


def log_odds(features: Sequence[str]) -> Column:
    """Log posterior odds of class 1; NULL when training lacked a class."""
    total = F.col("_prior")
    for f in features:
        x = F.col(f)
        for y, sign in ((1, -1.0), (0, 1.0)):
            m, v = F.col(f"_{f}_m{y}"), F.col(f"_{f}_v{y}")
            total = total + F.lit(sign) * (F.col(f"_{f}_l{y}") + (x - m) * (x - m) / v) / 2
    return total


def summed_log_odds(features: Sequence[str]) -> Column:
    """Sum of the log odds over a group given only by its moments ``n, m_, q_``.

    The log odds are quadratic in the features, so a participant's total follows
    from its count, mean and squared deviation.
    """
    n = F.col("n")
    total = n * F.col("_prior")
    for f in features:
        for y, sign in ((1, -1.0), (0, 1.0)):
            m, v = F.col(f"_{f}_m{y}"), F.col(f"_{f}_v{y}")
            gap = F.col(f"m_{f}") - m
            total = total + F.lit(sign) * (n * F.col(f"_{f}_l{y}") + (F.col(f"q_{f}") + n * gap * gap) / v) / 2
    return total


#: Models that are sent to every task at once.
MODEL_BYTES = 32 * 1024 * 1024


def attach(rows: DataFrame, models: DataFrame, keys: Sequence[str], n_models: int, n_features: int) -> DataFrame:
    """Rows with the model of their keys; rows are never shuffled for it.

    ``n_models`` is cells times arms times repeats times folds, known before any data is
    read. Models that would be too large to send at once are sent in parts by a hash of
    their keys; each part meets the rows of its keys.
    """
    parts = -(-n_models * (1 + 6 * n_features) * 16 // MODEL_BYTES)
    keys = list(keys)
    if parts <= 1:
        return rows.join(F.broadcast(models), keys)
    here = F.pmod(F.xxhash64(*keys), F.lit(parts))
    met = [rows.where(here == i).join(F.broadcast(models.where(here == i)), keys) for i in range(parts)]
    return reduce(DataFrame.unionByName, met)
