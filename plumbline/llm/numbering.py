"""Places in a total order, without ordering a key in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

#: ``monotonically_increasing_id`` keeps the row number of a partition in this many bits.
ROW_BITS = 33


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Adds ``_place`` (from 0) and ``_size`` of each row's key, in ascending ``order``.

    Rows are range-partitioned and sorted by keys and order, so a key may lie in many
    partitions; a run of a key in a partition learns how many rows of the key lie in
    earlier partitions. Runs are at most keys plus partitions. NULL keys are one key and
    come first, as NULL does in ``order``; rows equal in all columns may swap places.
    """
    columns = [*keys, *order]
    ordered = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    rows = stored(ordered.withColumn("_at", F.monotonically_increasing_id()), label)
    rows = rows.withColumn("_part", F.shiftright("_at", ROW_BITS))
    runs = rows.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    whole = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    earlier = whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select(
        "_part", *keys, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_n").over(whole).alias("_size"),
    )
    a, b = rows.alias("a"), runs.alias("b")
    same = [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in ["_part", *keys]]
    return a.join(b, same).select(
        *[F.col(f"a.`{c}`") for c in df.columns],
        (F.col("a._at") + F.col("b._shift")).alias("_place"), F.col("b._size").alias("_size"),
    )
