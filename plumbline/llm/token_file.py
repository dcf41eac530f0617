"""Token ids in files: frequency ranks, variable-length bytes, separate control bytes.

Every id is replaced by its rank in the corpus, most frequent first, so that the 256
commonest ids take one byte and the next 65,280 two. Two bits per id in a separate
control column say how many bytes the rank takes; decoding looks a whole control byte
up in a table of four lengths and gathers the bytes with array operations.

The files are Parquet folders, so that they are written and committed by Spark on any
file system: ``codes`` holds ``shard, doc_id, start, n_tokens, control, data`` in ascending
``doc_id`` order within and across shards, with the ids before each document in its shard;
``ranks`` holds the id of every rank.

Texts are tokenised once, into a narrow intermediate table; ranks are counted on it.

Edge cases: a null text counts as empty and holds only the end id; a null ``doc_id``
comes first; rows with equal ids are kept, in the order of their token counts; other
columns are ignored; an empty table gives empty files.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import scratch, stored
from .tokens import encoder, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SHARDS_PER_PARTITION = 4

#: Four lengths and their sum for every control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    codes = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    codes[: len(ranks)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Ranks back from :func:`pack`."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    at = np.cumsum(sizes) - sizes
    out = raw[at]
    for i in (1, 2, 3):
        more = np.flatnonzero(sizes > i)
        out[more] |= raw[at[more] + i] << np.uint32(8 * i)
    return out


def tokenise(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` with the ids in the narrowest width of the vocabulary."""
    kind = dict(docs.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary or vocabulary_path(VOCABULARY), END_ID, spaces_kept=False)
        for batch in batches:
            ids = [_narrow(t) for t in tokens.encode_all(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, ids binary")


def _narrow(ids: bytes) -> bytes:
    """The width of an id, then the ids: two bytes each where they fit."""
    wide = np.frombuffer(ids, "<u4")
    return b"\x02" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\x04" + ids


def _wide(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, f"<u{ids[0]}", offset=1)


def rank_table(tokens: DataFrame) -> list[int]:
    """Ids by falling frequency over the whole corpus; one entry per vocabulary id at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                part = np.bincount(_wide(ids.as_py()), minlength=len(total))
                part[: len(total)] += total
                total = part
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    return [r["id"] for r in counts.orderBy(F.desc("n"), "id").toLocalIterator()]


def write(docs: DataFrame, folder: str, vocabulary: str | None = None) -> None:
    """Write ``codes`` and ``ranks`` below ``folder``."""
    spark = docs.sparkSession
    kind = dict(docs.dtypes)["doc_id"]
    tokens = stored(tokenise(docs, vocabulary), "token-ids")
    ids = rank_table(tokens)
    spark.createDataFrame([(i, t) for i, t in enumerate(ids)], "rank int, id bigint").coalesce(1).write.parquet(f"{folder}/ranks")
    shards = SHARDS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 20 * shards)
    cuts = np.unique(np.array(docs.agg(points.alias("p")).first()["p"] or [], dtype=np.int64))
    rank = np.zeros(max(ids, default=0) + 1, dtype=np.uint32)
    rank[ids] = np.arange(len(ids), dtype=np.uint32)
    shared = spark.sparkContext.broadcast((rank, cuts))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, cuts = shared.value
        for batch in batches:
            rows = []
            for ids in batch.column(1):
                found = _wide(ids.as_py())
                rows.append((len(found), *pack(rank[found])))
            n, control, data = zip(*rows) if rows else ((), (), ())
            at = batch.column(0)
            place = np.searchsorted(cuts, at.fill_null(0).to_numpy(zero_copy_only=False), side="left")
            place[at.is_null().to_numpy(zero_copy_only=False)] = 0
            yield pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int32()), at, pa.array(n, pa.int64()), pa.array(control, pa.binary()), pa.array(data, pa.binary())],
                names=["shard", "doc_id", "n_tokens", "control", "data"],
            )

    codes = tokens.select("doc_id", "ids").mapInArrow(
        encode, f"shard int, doc_id {kind}, n_tokens bigint, control binary, data binary"
    )
    # The window has the order of the file, so its sort is the only one.
    earlier = W.partitionBy("shard").orderBy(F.asc_nulls_first("doc_id"), "n_tokens", "data").rowsBetween(W.unboundedPreceding, -1)
    placed = codes.repartition("shard").withColumn("start", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    placed.write.option("compression", "none").parquet(f"{folder}/codes")


def read(spark, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: every document's ids as 32-bit integers, and where they begin."""
    codes = spark.read.parquet(f"{folder}/codes")
    ids = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").toLocalIterator()
    shared = spark.sparkContext.broadcast(np.array([r[0] for r in ids] or [0], dtype="<u4"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, control, data = (batch.column(i).to_pylist() for i in (3, 4, 5))
            found = [shared.value[unpack(c, d, k)].tobytes() for k, c, d in zip(n, control, data)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["shard", "doc_id", "start", "n_tokens", "ids"])

    schema = f"shard int, doc_id {dict(codes.dtypes)['doc_id']}, start bigint, n_tokens bigint, ids binary"
    rows = codes.select("shard", "doc_id", "start", "n_tokens", "control", "data").mapInArrow(decode, schema)
    # Shards follow one another; their totals come from the columns alone, without decoding.
    totals = codes.groupBy("shard").agg(F.max(F.col("start") + F.col("n_tokens")).alias("n")).orderBy("shard").collect()
    before = list(zip((r["shard"] for r in totals), accumulate((r["n"] for r in totals), initial=0)))
    offsets = spark.createDataFrame(before, "shard int, before bigint")
    return rows.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids"
    )


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write the files, read them back and describe every document from them."""
    folder = scratch(docs.sparkSession, "tokens")
    write(docs, folder, vocabulary)
    return read(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
