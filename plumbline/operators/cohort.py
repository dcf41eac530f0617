"""Cohorts and the descriptive tables of an audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import first_per_key

COHORTS = ("full", "batch_matched")


def with_cohort_flags(df: DataFrame, groups: Sequence[str], batch: int) -> DataFrame:
    full = F.col("group").isin(*groups)
    return df.withColumn("cohort_full", full).withColumn("cohort_batch_matched", full & (F.col("batch") == batch))


def select_cohort(df: DataFrame, cohort: str) -> DataFrame:
    if cohort not in COHORTS:
        raise KeyError(f"unknown cohort {cohort!r}; expected one of {sorted(COHORTS)}")
    return df.where(F.col(f"cohort_{cohort}"))


def exclude_in_several(df: DataFrame, subject: str, value: str) -> DataFrame:
    from .identity import in_several

    return df.join(in_several(df, subject, value), subject, "left_anti")


def stratum(df: DataFrame, subject: str, known: Column, proxy: str, threshold: float) -> DataFrame:
    """Rows of subjects selected by metadata or by the mean of a proxy value."""
    by_metadata = df.where(known).select(subject)
    by_proxy = df.groupBy(subject).agg(F.avg(proxy).alias("_m")).where(F.col("_m") > threshold).select(subject)
    return df.join(by_metadata.union(by_proxy).distinct(), subject, "left_semi")


def pivot_distinct(df: DataFrame, index: Sequence[str], column: str, values: Sequence, distinct: str | None = None) -> DataFrame:
    """Zero-filled cross-tab with an explicit value list (one job)."""
    agg = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    out = df.groupBy(*index).pivot(column, list(values)).agg(agg)
    return out.na.fill(0)


def cohort_table(df: DataFrame) -> DataFrame:
    """One row per group: participants, age, sex, recordings, directories."""
    person = first_per_key(df, ["subject_id"], [F.col("recording_id")], ["group", "age", "sex"])
    people = person.groupBy("group").agg(
        F.count(F.lit(1)).alias("participants"),
        F.avg("age").alias("age_mean"), F.stddev_samp("age").alias("age_sd"),
        F.min("age").alias("age_min"), F.max("age").alias("age_max"),
        F.count_if(F.col("sex") == "M").alias("male"),
        (F.avg((F.col("sex") == "M").cast("double")) * 100).alias("pct_male"),
    )
    counts = df.groupBy("group").agg(
        F.count(F.lit(1)).alias("recordings"), F.countDistinct("folder_path").alias("directories")
    )
    return people.join(counts, "group")


def completion_rate(df: DataFrame, tasks: Sequence[str]) -> DataFrame:
    """Percent of a group's participants with at least one recording per task."""
    hit = pivot_distinct(df, ["group"], "task", tasks, "subject_id")
    total = df.groupBy("group").agg(F.countDistinct("subject_id").alias("_n"))
    return hit.join(total, "group").select("group", *[(F.col(f"`{t}`") * 100.0 / F.col("_n")).alias(t) for t in tasks])


def repeats_histogram(df: DataFrame) -> DataFrame:
    per = df.groupBy("group", "subject_id").agg(
        F.count(F.lit(1)).alias("readings"), F.countDistinct("session_date").alias("sessions")
    )
    return per.groupBy("group", "readings", "sessions").agg(F.count(F.lit(1)).alias("participants"))


def first_two(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """``keys, first, second`` readings in order; keys with one reading are left out.

    The second is the minimum among the rows after the first: two map-side
    aggregates instead of a sort of each key.
    """
    row = F.struct(*order, value)
    first = df.groupBy(*keys).agg(F.min(row).alias("_a"))
    rest = df.join(first, list(keys)).where(F.struct(*order) > F.struct(*[F.col("_a")[c].alias(c) for c in order]))
    second = rest.groupBy(*keys).agg(F.min(row).alias("_b"), F.min("_a").alias("_a"))
    return second.select(*keys, F.col("_a")[value].alias("first"), F.col("_b")[value].alias("second"))


def missingness(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(
        F.countDistinct("subject_id").alias("participants"), F.count(F.lit(1)).alias("recordings"),
        *[F.count(c).alias(f"has_{c}") for c in columns],
    )


def minimum_evidence(df: DataFrame, keys: Sequence[str], rule: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejected)`` groups by a rule over the group's rows."""
    judged = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), rule.alias("_ok"))
    kept = judged.where("_ok").drop("_ok")
    return kept, judged.where("NOT coalesce(_ok, false)").drop("_ok").withColumn("reason", F.lit(reason))


def histogram(df: DataFrame, by: Sequence[str], value: str, cuts: Sequence[float]) -> DataFrame:
    from .calibrate import bin_index

    inside = df.where(F.col(value).between(float(cuts[0]), float(cuts[-1])))
    return inside.groupBy(*by, bin_index(F.col(value), cuts).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
