"""Data-quality gates as rows ``(check, n_bad, passed)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _is_missing(df: DataFrame, c: str) -> Column:
    floating = dict(df.dtypes)[c] in ("double", "float")
    return F.col(c).isNull() | F.isnan(c) if floating else F.col(c).isNull()


def _clean(df: DataFrame, c: str) -> Column:
    return F.when(~_is_missing(df, c), F.col(c))


def missing_counts(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``feature, n_missing`` in one pass over the table."""
    wide = df.agg(*[F.count_if(_is_missing(df, c)).alias(c) for c in features])
    return wide.unpivot([], list(features), "feature", "n_missing")


def constant_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features with at most one distinct value; extremes tell, no distinct needed."""
    flags = df.agg(
        *[F.coalesce(F.min(_clean(df, c)) == F.max(_clean(df, c)), F.lit(True)).alias(c) for c in features]
    )
    return flags.unpivot([], list(features), "feature", "is_constant")


def empty_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    counts = df.agg(*[F.count(_clean(df, c)).alias(c) for c in features]).first()
    return [c for c in features if counts[c] == 0]


def drop_empty_columns(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.drop(*empty_columns(df, features))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def conflicting(df: DataFrame, subject: str, value: str) -> DataFrame:
    return df.groupBy(subject).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi")


def unscored(expected: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Expected keys without a score."""
    return expected.select(*keys).join(scored.where("score IS NOT NULL").select(*keys).distinct(), list(keys), "left_anti")


def value_set_difference(df: DataFrame, column: str, expected: Sequence) -> DataFrame:
    """Values that are unexpected or missing; empty means the sets are equal."""
    have = df.select(column).distinct()
    want = df.sparkSession.createDataFrame([(v,) for v in expected], f"{column} {dict(df.dtypes)[column]}")
    return have.exceptAll(want).withColumn("side", F.lit("unexpected")).unionByName(
        want.exceptAll(have).withColumn("side", F.lit("missing"))
    )


def quality_report(df: DataFrame, table_name: str, features: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """All five table checks as rows."""
    one_pass = df.agg(
        reduce(lambda a, b: a + b, [F.count_if(_is_missing(df, c)) for c in features]).alias("missing_values"),
        reduce(
            lambda a, b: a + b,
            [F.coalesce(F.min(_clean(df, c)) == F.max(_clean(df, c)), F.lit(True)).cast("bigint") for c in features],
        ).alias("constant_columns"),
        F.when(F.min("label") != F.max("label"), 0).otherwise(1).cast("bigint").alias("single_class"),
    ).unpivot([], ["missing_values", "constant_columns", "single_class"], "check", "n_bad")
    duplicates = duplicate_keys(df, row_key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_bad"))
    labels = conflicting(df, "subject_id", "label").agg(F.count(F.lit(1)).alias("n_bad"))
    rows = one_pass.unionByName(duplicates.withColumn("check", F.lit("duplicate_rows"))).unionByName(
        labels.withColumn("check", F.lit("conflicting_labels"))
    )
    return rows.select(
        F.lit(table_name).alias("table"), "check", F.col("n_bad").cast("bigint").alias("n_bad"), (F.col("n_bad") == 0).alias("passed")
    )
