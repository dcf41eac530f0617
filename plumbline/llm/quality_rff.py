"""Quality classifier: random Fourier features, ridge scores, isotonic calibration.

Random Fourier features approximate a Gaussian kernel over document statistics.
Every partition adds up its part of the normal equations; the sums are a matrix of
fixed size, so the driver only ever solves ``features x features``. Scores are then
calibrated by isotonic regression over a fixed number of score bins.

Edge cases: a null text counts as empty and gets a score like any other; repeated
ids are scored row by row; other columns are ignored; without any usable label the
score is 0.5 for all; labels that are null are left out; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import statistics as S
from . import vectors as V
from .common import stored

FEATURES = 384
GAMMA = 0.5
RIDGE = 3e-4
BINS = 2000
SEED = 11
SOLVE_BLOCK = 32


def held_out(column: str = "doc_id"):
    """True where ``crc32(id as text) mod 3 = 1``; such labels are never used."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_statistics(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, x``: an array of scale-free statistics of each whole text."""
    kind = dict(docs.dtypes)[id_column]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in V.blocks(batch.column(1)):
                x = S.ratios(S.base(block))
                flat = pa.array(x.ravel(), type=pa.float64())
                ends = pa.array(np.arange(0, x.size + 1, x.shape[1]), type=pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.n), pa.ListArray.from_arrays(ends, flat)],
                    names=[id_column, "x"],
                )

    return docs.select(F.col(f"`{id_column}`"), F.col(f"`{text}`")).mapInArrow(compute, f"`{id_column}` {kind}, x array<double>")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Features:
    """Standardised statistics, their squares' kernel map and a constant."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray):
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1.0)
        d = len(mean)
        self.w = rng.normal(0.0, np.sqrt(2.0 * GAMMA / d), (d, FEATURES))
        self.b = rng.uniform(0.0, 2.0 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.sd, -8.0, 8.0)
        fourier = np.cos(z @ self.w + self.b) * np.sqrt(2.0 / FEATURES)
        return np.hstack([np.ones((len(z), 1)), 0.1 * z, fourier])

    @property
    def width(self) -> int:
        return 1 + len(self.mean) + FEATURES


def _moments(stats: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    d = len(S.RATIOS)
    row = stats.select(
        *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(d)],
        *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(d)],
    ).first()
    values = np.array([0.0 if v is None else v for v in row])
    return values[:d], values[d:]


def _normal_equations(labelled: DataFrame, features: Features) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums over all labelled rows of ``z z'`` and ``z y``, a block of rows each."""
    width, d = features.width, len(S.RATIOS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = features(_matrix(batch.column(0), d))
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                part = z.T @ np.column_stack([z, y, np.ones(len(y))])
                total = part if total is None else total + part
        if total is not None:
            for at in range(0, width, SOLVE_BLOCK):
                rows = total[at : at + SOLVE_BLOCK]
                yield V.output({"block": ([at], pa.int32()), "v": ([rows.ravel().tolist()], pa.list_(pa.float64()))})

    parts = labelled.select("x", F.col("label").cast("int")).mapInArrow(sums, "block int, v array<double>")
    # Added up per position, so that the shuffle carries one row per partition and block.
    added = (
        parts.select("block", F.posexplode("v").alias("i", "v")).groupBy("block", "i").agg(F.sum("v").alias("v"))
        .groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("c"))
        .select("block", F.col("c.v").alias("v"))
    )
    out = np.zeros((width, width + 2))
    for row in added.toLocalIterator():
        rows = np.array(row["v"]).reshape(-1, width + 2)
        out[row["block"] : row["block"] + len(rows)] = rows
    return out[:, :width], out[:, width], int(round(out[0, width + 1]))


def _isotonic(low: np.ndarray, weight: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over score bins; returns knots for interpolation."""
    pools: list[list[float]] = []
    for x, w, h in zip(low, weight, hits):
        pools.append([x * w, w, h])
        while len(pools) > 1 and pools[-2][2] / pools[-2][1] >= pools[-1][2] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    at = np.array([p[0] / p[1] for p in pools])
    # One pseudo-row of either class per pool keeps probabilities off 0 and 1.
    value = np.array([(p[2] + 0.5) / (p[1] + 1.0) for p in pools])
    return at, np.maximum.accumulate(value)


def fit(stats: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> dict | None:
    """Model from the rows of ``labels`` (id, ``label``) that are not held out."""
    mean, sd = _moments(stats)
    features = Features(mean, sd)
    usable = labels.where(F.col("label").isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
    rows = stored(stats.join(usable.select(id_column, "label"), id_column).select("x", "label"), "quality-train")
    a, b, n = _normal_equations(rows, features)
    if n == 0:
        return None
    weights = np.linalg.solve(a + RIDGE * n * np.eye(len(a)) / FEATURES, b)
    d = len(S.RATIOS)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, BINS))
        for batch in batches:
            if batch.num_rows:
                raw = np.clip(features(_matrix(batch.column(0), d)) @ weights, -0.5, 1.5)
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
                at = np.minimum(((raw + 0.5) / 2.0 * BINS).astype(np.int64), BINS - 1)
                for i, w in enumerate((None, y, raw)):
                    total[i] += np.bincount(at, weights=w, minlength=BINS)
        some = np.flatnonzero(total[0])
        yield V.output({
            "bin": (some, pa.int32()), "n": (total[0, some], pa.float64()),
            "hits": (total[1, some], pa.float64()), "raw": (total[2, some], pa.float64()),
        })

    bins = (
        rows.select("x", F.col("label").cast("int")).mapInArrow(binned, "bin int, n double, hits double, raw double")
        .groupBy("bin").agg(F.sum("n"), F.sum("hits"), F.sum("raw")).orderBy("bin").collect()
    )
    table = np.array([tuple(r)[1:] for r in bins])
    knots, values = _isotonic(table[:, 2] / table[:, 0], table[:, 0], table[:, 1])
    return {"features": features, "weights": weights, "knots": knots, "values": values}


def score(stats: DataFrame, model: dict | None, id_column: str = "doc_id") -> DataFrame:
    """``id_column, score``: calibrated probability of label 1."""
    if model is None:
        return stats.select(F.col(f"`{id_column}`"), F.lit(0.5).alias("score"))
    kind, d = dict(stats.dtypes)[id_column], len(S.RATIOS)
    features, weights, knots, values = (model[k] for k in ("features", "weights", "knots", "values"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = features(_matrix(batch.column(1), d)) @ weights
            p = np.interp(raw, knots, values)
            # Beyond the outermost pools the order of raw scores is kept.
            p = 0.999 * p + 0.001 / (1.0 + np.exp(-np.clip(4.0 * (raw - 0.5), -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], names=[id_column, "score"])

    return stats.select(F.col(f"`{id_column}`"), "x").mapInArrow(apply, f"`{id_column}` {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``."""
    stats = stored(document_statistics(docs, id_column), "quality-statistics")
    truth = labels.select(F.col(f"`{id_column}`"), F.col(f"`{label}`").alias("label")).dropDuplicates([id_column])
    model = fit(stats, truth, id_column)
    return score(stats, model, id_column).select(
        id_column, held_out(id_column).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
