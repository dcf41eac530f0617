"""Parquet and CSV sinks, and the partitioned feature table that fills on demand."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from ..session import checkpoint_folder


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder on the storage that all executors share."""
    return f"{checkpoint_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "errorifexists") -> DataFrame:
    """Write and read back, so later steps start from files instead of lineage.

    One partition value may hold a third of the rows, so tasks write whatever
    values they hold instead of being gathered by value.
    """
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(_reordered(df.schema, partition_by)).parquet(path)


def _reordered(schema: T.StructType, partition_by: Sequence[str]) -> T.StructType:
    last = [f for f in schema.fields if f.name in partition_by]
    return T.StructType([f for f in schema.fields if f.name not in partition_by] + last)


def write_csv_rounded(df: DataFrame, path: str, places: int = 4) -> None:
    """CSV with header; floating columns rounded."""
    rounded = [
        F.round(c.name, places).alias(c.name) if isinstance(c.dataType, (T.DoubleType, T.FloatType)) else F.col(c.name)
        for c in df.schema.fields
    ]
    df.select(*rounded).write.option("header", True).csv(path)


def read_or_compute(
    spark: SparkSession,
    path: str,
    wanted: DataFrame,
    keys: Sequence[str],
    compute: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Feature table partitioned by ``keys``: only missing partitions are computed.

    ``wanted`` lists rows with ``keys``; partitions already on disk are left out by
    an anti join, ``compute`` runs on the rest and its result is appended.
    """
    try:
        present = spark.read.parquet(path).select(*keys).distinct()
        todo = wanted.join(present, list(keys), "left_anti")
    except AnalysisException:
        todo = wanted
    compute(todo).write.mode("append").partitionBy(*keys).parquet(path)
    return spark.read.parquet(path)


def manifest(features: DataFrame, keys: Sequence[str], feature_names: Sequence[str], subject: str = "subject_id") -> DataFrame:
    return features.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("recordings"),
        F.countDistinct(subject).alias("participants"),
    ).withColumn("features", F.lit(len(feature_names)).cast("bigint"))
