"""AUROC and what is built on it, keyed by any experiment cell."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import is_small
from .ordering import running_totals, window, with_ranges

#: Means are rounded to this many places before they are ranked: the order in which
#: Spark adds numbers may change the last bit, and that must not break a tie.
PLACES = 9


def auroc(
    df: DataFrame,
    keys: Sequence[str],
    label: str = "label",
    score: str = "score",
    weight: str | None = None,
    fanout: float = 1.0,
) -> DataFrame:
    """``keys, n_pos, n_neg, auroc``; ties count half, NULL for a single class.

    Rows are first compressed to one per distinct score. On large inputs the
    scores are cut into ranges: a range contributes its own pairs plus its
    positives times the negatives of all lower ranges.
    """
    w = F.col(weight) if weight else F.lit(1)
    comp = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("_p"),
        F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("_n"),
    )
    small = is_small(df, fanout)
    part = [*keys] if small else [*keys, "_range"]
    if not small:
        comp = with_ranges(comp, [score])
    lower = window(part).orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(lower), F.lit(0))
    out = comp.select(*part, "_p", "_n", (F.col("_p") * (below + F.col("_n") / 2)).alias("_u"))
    if not small:
        out = out.groupBy(*part).agg(*[F.sum(c).alias(c) for c in ("_p", "_n", "_u")])
        out = add_lower_ranges(out, keys)
    return out.groupBy(*keys).agg(
        F.sum("_p").cast("bigint").alias("n_pos"), F.sum("_n").cast("bigint").alias("n_neg"),
        F.try_divide(F.sum("_u"), (F.sum("_p") * F.sum("_n")).cast("double")).alias("auroc"),
    )


def add_lower_ranges(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Credit each range's positives with the negatives of all lower ranges."""
    lower = window(keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(lower), F.lit(0))
    return ranges.withColumn("_u", F.col("_u") + F.col("_p") * below)


def direction_free(a: Column) -> Column:
    """0.02 is as informative as 0.98."""
    return F.greatest(a, F.lit(1.0) - a)


def to_participants(
    df: DataFrame, keys: Sequence[str] = (), subject: str = "subject_id", label: str = "label", score: str = "score"
) -> DataFrame:
    """One row per participant; conflicting labels stop the query."""
    message = F.concat(F.lit("participant with more than one label: "), F.col(subject).cast("string"))
    agg = df.groupBy(*keys, subject).agg(
        F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.round(F.avg(score), PLACES).alias("score")
    )
    return agg.select(
        *keys, subject,
        F.when(F.col("_lo") == F.col("_hi"), F.col("_hi")).otherwise(F.raise_error(message).cast("int")).alias("label"),
        "score",
    )


def univariate_screen(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str = "label") -> DataFrame:
    """``keys, feature, auroc`` (direction-free) for every feature in one plan."""
    long = df.select(*keys, label, *features).unpivot([*keys, label], list(features), "feature", "score")
    a = auroc(long, [*keys, "feature"], label, "score", fanout=len(features))
    return a.select(*keys, "feature", direction_free(F.col("auroc")).alias("auroc"))


def best_control(df: DataFrame, corpus: str, features: Sequence[str]) -> DataFrame:
    """Best single feature per corpus at participant grain, never below 0.5."""
    per_subject = df.groupBy(corpus, "subject_id").agg(
        F.max("label").alias("label"), *[F.round(F.avg(f), PLACES).alias(f) for f in features]
    )
    screen = univariate_screen(per_subject, [corpus], features)
    return screen.groupBy(corpus).agg(
        F.greatest(F.lit(0.5), F.max("auroc")).alias("best_auroc"),
        F.max_by("feature", F.struct(F.coalesce("auroc", F.lit(0.0)), F.col("feature"))).alias("best_feature"),
    )


def roc_points(df: DataFrame, keys: Sequence[str], label: str = "label", score: str = "score") -> DataFrame:
    """``keys, threshold, fpr, tpr`` at every distinct score."""
    y = F.col(label)
    rows = df.where(F.col(score).isNotNull())
    cum = running_totals(
        rows, keys, score,
        {"p": F.sum(F.when(y == 1, 1).otherwise(0)), "n": F.sum(F.when(y == 0, 1).otherwise(0))}, descending=True,
    )
    totals = rows.groupBy(*keys).agg(
        F.count_if(y == 1).alias("_P"), F.count_if(y == 0).alias("_N")
    )
    return cum.join(totals, [*keys]).select(
        *keys, F.col(score).alias("threshold"),
        F.try_divide(F.col("cum_n"), F.col("_N")).alias("fpr"), F.try_divide(F.col("cum_p"), F.col("_P")).alias("tpr"),
    )
