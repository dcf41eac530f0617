"""Helpers the operators share: tables, scratch folders, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder

#: Size of the broadcast bit maps of ids, the same for any number of ids.
MAP_BITS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partition_by: str | None = None, codec: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, columns stay prunable."""
    spark, path = df.sparkSession, scratch(df.sparkSession, label)
    writer = df.write.option("compression", codec)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_input(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, found without regard to other columns."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``(a, b)`` edges by alternating star contraction.

    Returns ``(node, component)`` with the smallest node of each component; nodes
    without an edge do not appear. Each round joins every node's neighbours to the
    smallest one, first over larger neighbours, then over all. Rounds grow with the
    logarithm of the longest path. Every round is a written table, so a lost
    executor repeats one round at most. Self loops and repeated edges are harmless.
    """
    current = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        label,
    )
    while True:
        large = _star(current, larger_only=True)
        small = stored(_star(large, larger_only=False), label)
        # Done when every node has one centre and no centre has one itself.
        centres = small.select(F.col("b").alias("a")).distinct()
        changed = small.join(centres, "a", "left_semi").limit(1).count()
        changed = changed or small.groupBy("a").count().where("count > 1").limit(1).count()
        current = small
        if not changed:
            return _labels(current)


def _labels(stars: DataFrame) -> DataFrame:
    centres = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    leaves = stars.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return leaves.unionByName(centres)


def _star(pairs: DataFrame, larger_only: bool) -> DataFrame:
    """One contraction; ``pairs`` has ``a > b``.

    Large star: each node sends its larger neighbours to its smallest neighbour or
    itself. Small star: each node sends its smaller neighbours and itself there.
    """
    if larger_only:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        out = both.join(least, "a").where("b > a").select(
            F.col("b").alias("a"), F.least("m", F.col("a")).alias("b")
        )
    else:
        least = pairs.groupBy("a").agg(F.min("b").alias("m"))
        joined = pairs.join(least, "a")
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.where("a > b").distinct()


def bit_map(ids: DataFrame) -> np.ndarray:
    """Which ids may be present: ``2 ** MAP_BITS`` bits however many ids there are."""
    at = ids.select(F.pmod(F.xxhash64(ids.columns[0]), F.lit(1 << MAP_BITS)).alias("at"))
    words = at.selectExpr("shiftright(at, 5) AS w", "shiftleft(1L, CAST(at & 31 AS INT)) AS b")
    out = np.zeros(1 << (MAP_BITS - 5), dtype=np.uint32)
    for row in words.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():
        out[row["w"]] = row["b"]
    return out


def marked(docs: DataFrame, bits: np.ndarray, present: bool = True) -> DataFrame:
    """``doc_id, text`` of the documents whose id may be in a bit map, or surely is not.

    The test runs before any shuffle; rows that pass by chance are left to a join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield in_map(batch, shared.value, present)

    kind = dict(docs.dtypes)["doc_id"]
    return placed(docs).mapInArrow(keep, f"doc_id {kind}, text string")


def placed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, at``: the place of the id in a bit map, for :func:`in_map`."""
    return docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << MAP_BITS)).cast("int").alias("at"))


def in_map(batch: pa.RecordBatch, bits: np.ndarray, present: bool = True) -> pa.RecordBatch:
    """``doc_id, text`` of the rows of :func:`placed` that :func:`marked` would keep."""
    at = batch.column(2).to_numpy(zero_copy_only=False)
    flag = ((bits[at >> 5] >> (at & 31).astype(np.uint32)) & 1).astype(bool)
    return batch.filter(pa.array(flag if present else ~flag)).select(["doc_id", "text"])
