"""Importance resampling towards a target distribution by bit-sliced aggregation.

A document's features (its words and pairs of neighbouring words) are counted per bucket
of a hash. The counts are kept as bit planes: bit ``b`` of plane ``k`` is bit ``k`` of the
count of bucket ``b``, so a document is a handful of planes of a fixed width however long
its text is. The planes are written once; everything after that works on them:

* corpus counts add planes with carry-save adders, whole words of buckets at a time;
* the gain of each bucket is a signed integer, cut into planes in two's complement;
* a document's weight is the sum, over pairs of planes, of the number of common bits
  times a power of two (the top gain plane counts negative), which is exact.

The draw adds Gumbel noise from a keyed hash and takes the highest scores. Scores are
integers between fixed bounds, so their histogram has a bounded number of rows and gives
the lowest score to be drawn; only rows from there on are put in order, by range.

Edge cases: a null or empty text has no words, no features and weight 0; a row with a null
id has neither noise nor score, is not counted among the eligible and never drawn; rows of
one id have the same noise and are drawn each for itself; equal scores go by id, then by
weight and number of features; other columns are ignored; with an empty target all gains
come from the smoothing alone; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vectors as V
from .common import stored, text_input
from .numbering import numbered

BUCKETS = 10_000
SCALE = 1000
#: A long text is split into words piece by piece.
PIECE_BYTES = 1 << 20
#: Planes taken at once from a batch.
PLANES_AT_ONCE = 4096

#: Lower case, and a space for every byte that is no part of a word.
WORDS_ONLY = bytes(int(V.LOWER[b]) if V.ALNUM[V.LOWER[b]] else 32 for b in range(256))


def bucket_counts(text: str, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and features per bucket.

    The checksum of a pair continues that of its first word over a space and the second.
    """
    data = text.encode().translate(WORDS_ONLY)
    counts = np.zeros(buckets, dtype=np.int64)
    n_words, at, last = 0, 0, None
    while at < len(data):
        cut = data.find(b" ", at + PIECE_BYTES)
        cut = len(data) if cut < 0 else cut
        words = data[at:cut].split()
        at = cut
        if not words:
            continue
        single = list(map(crc32, words))
        before = single[:-1] if last is None else [last, *single[:-1]]
        spaced = [b" " + w for w in (words[1:] if last is None else words)]
        sums = np.array(single + list(map(crc32, spaced, before)), dtype=np.int64)
        counts += np.bincount(sums % buckets, minlength=buckets)
        n_words, last = n_words + len(words), single[-1]
    return n_words, counts


def width(buckets: int) -> int:
    """64-bit words of a plane."""
    return -(-buckets // 64)


def to_planes(values: np.ndarray, n_planes: int) -> np.ndarray:
    """The lowest ``n_planes`` bits of each value, one row of 64-bit words per bit."""
    bits = (values[None, :] >> np.arange(n_planes, dtype=np.int64)[:, None]) & 1
    packed = np.packbits(bits.astype(bool), axis=1, bitorder="little")
    out = np.zeros((n_planes, width(len(values)) * 8), dtype=np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view(np.uint64)


def bucket_planes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``id_column, n_words, n_features, planes`` of every row."""
    slim = text_input(docs, id_column, text_column)
    kind = dict(slim.dtypes)[id_column]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, planes = [], [], []
            for text in batch.column(1):
                n, counts = bucket_counts(text.as_py() or "", buckets)
                words.append(n)
                features.append(int(counts.sum()))
                planes.append(to_planes(counts, int(counts.max()).bit_length()).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(planes, pa.binary())],
                names=[id_column, "n_words", "n_features", "planes"],
            )

    return slim.mapInArrow(count, f"`{id_column}` {kind}, n_words bigint, n_features bigint, planes binary")


def _slices(column: pa.Array, words: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of whole rows: their planes as a matrix, and the first plane of each row and the end."""
    data, offsets = V.text_buffers(column)
    rows, lo = offsets // (words * 8), 0
    while lo < len(column):
        hi = int(np.searchsorted(rows, rows[lo] + PLANES_AT_ONCE, side="right")) - 1
        hi = max(hi, lo + 1)
        piece = np.frombuffer(data[offsets[lo]:offsets[hi]].tobytes(), dtype=np.uint64).reshape(-1, words)
        yield piece, rows[lo:hi + 1] - rows[lo]
        lo = hi


def _level(starts: np.ndarray) -> np.ndarray:
    """Which bit of its document's counts each plane holds."""
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


class BitSum:
    """Sum of planes by carry-save adders: three planes of one weight become two."""

    def __init__(self, buckets: int):
        self.buckets, self.planes = buckets, {}

    def add(self, planes: np.ndarray, level: int) -> None:
        while len(planes):
            held = self.planes.pop(level, None)
            stack = planes if held is None else np.concatenate([held, planes])
            carries = []
            while len(stack) > 1:
                third = max(1, len(stack) // 3)
                a, b = stack[:third], stack[third:2 * third]
                c = stack[2 * third:3 * third] if len(stack) > 2 else np.zeros_like(a)
                odd = a ^ b
                carries.append((a & b) | (odd & c))
                stack = np.concatenate([odd ^ c, stack[3 * third:]])
            self.planes[level] = stack
            planes = np.concatenate(carries) if carries else stack[:0]
            level += 1

    def counts(self) -> np.ndarray:
        total = np.zeros(self.buckets, dtype=np.int64)
        for level, plane in self.planes.items():
            bits = np.unpackbits(plane.view(np.uint8).reshape(-1), bitorder="little")[: self.buckets]
            total += bits.astype(np.int64) << level
        return total


def bucket_totals(planes: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all rows per bucket; one row per bucket and task is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = BitSum(buckets)
        for batch in batches:
            for matrix, starts in _slices(batch.column(0), width(buckets)):
                level = _level(starts)
                for k in np.unique(level):
                    total.add(matrix[level == k], int(k))
        counts = total.counts()
        some = np.flatnonzero(counts)
        yield V.output({"bucket": (some, pa.int32()), "n": (counts[some], pa.int64())})

    out = np.zeros(buckets, dtype=np.int64)
    sums = planes.select("planes").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in sums.collect():  # at most one row per bucket
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of smoothed target and source shares, in whole thousandths."""
    m, s_all, t_all = float(len(source)), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(SCALE * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m))))
        for s, t in zip(source.astype(float), target.astype(float))
    ], dtype=np.int64)


def weigh(planes: DataFrame, gains: np.ndarray, id_column: str = "doc_id") -> DataFrame:
    """``id_column, n_words, n_features, weight``: floored mean gain of a row's features."""
    kind = dict(planes.dtypes)[id_column]
    n_bits = int(np.abs(gains).max()).bit_length() + 1
    shared = planes.sparkSession.sparkContext.broadcast(to_planes(gains, n_bits))

    def total(matrix: np.ndarray, starts: np.ndarray) -> np.ndarray:
        per_plane = np.zeros(len(matrix), dtype=np.int64)
        for j, gain in enumerate(shared.value):
            common = np.bitwise_count(matrix & gain).sum(axis=1, dtype=np.int64) << j
            per_plane += -common if j == n_bits - 1 else common
        running = np.concatenate([[0], np.cumsum(per_plane << _level(starts))])
        return running[starts[1:]] - running[starts[:-1]]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = np.concatenate([total(*s) for s in _slices(batch.column(3), shared.value.shape[1])])
            n = batch.column(2).to_numpy(zero_copy_only=False)
            weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weight, pa.int64())], names=[id_column, "n_words", "n_features", "weight"]
            )

    chosen = planes.select(f"`{id_column}`", "n_words", "n_features", "planes")
    return chosen.mapInArrow(apply, f"`{id_column}` {kind}, n_words bigint, n_features bigint, weight bigint")


def noise(id_column: str, seed: int) -> Column:
    """Gumbel noise in whole thousandths from a keyed hash of the id; NULL for a null id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_column}`").cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    u = (h.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(SCALE)) * F.log(-F.log(u))).cast("bigint")


def _lowest_drawn(eligible: DataFrame, n: int) -> int | None:
    """The score of the ``n``-th highest row, from the bounded histogram of scores."""
    left = n
    for row in eligible.groupBy("score").count().orderBy(F.desc("score")).collect():
        left -= row["count"]
        if left <= 0:
            return row["score"] if n else None
    return None


def draw(weighted: DataFrame, percent: int, min_words: int, seed: int, id_column: str = "doc_id") -> DataFrame:
    """``id_column, n_words, n_features, weight, score, rank``; rank is NULL where not drawn."""
    scored = stored(weighted.withColumn("score", F.col("weight") + noise(id_column, seed)), "importance-scores")
    may = F.col("score").isNotNull() & (F.col("n_words") >= min_words)
    eligible = scored.where(may)
    n = percent * eligible.count() // 100
    lowest = _lowest_drawn(eligible, n)
    none = F.lit(None).cast("bigint").alias("rank")
    if lowest is None:
        return scored.select("*", none)
    high = F.coalesce(may & (F.col("score") >= lowest), F.lit(False))
    front = scored.where(high).withColumn("_down", -F.col("score"))
    placed = numbered(front, [], ["_down", id_column, "weight", "n_features"], "importance-order")
    rank = F.when(F.col("_place") < n, F.col("_place") + 1).cast("bigint").alias("rank")
    return placed.select(*scored.columns, rank).unionByName(scored.where(~high).select("*", none))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7,
    buckets: int = BUCKETS, id_column: str = "doc_id", text_column: str = "text", target_text: str = "text",
) -> DataFrame:
    """Every row with its weight and, if among the drawn ``percent``, its rank."""
    planes = stored(bucket_planes(docs, id_column, text_column, buckets), "importance-planes")
    wanted = target.select(F.lit(0).alias("_id"), F.col(f"`{target_text}`").alias("_text"))
    target_counts = bucket_totals(bucket_planes(wanted, "_id", "_text", buckets), buckets)
    gains = bucket_gains(bucket_totals(planes, buckets), target_counts)
    return draw(weigh(planes, gains, id_column), percent, min_words, seed, id_column)


def report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
