"""Exact AUROC of many selections of the same rows, without a row per selection.

A task scores its rows under every model and packs the scores of a selection into arrays,
one per range of scores, with the labels beside them. A reducer puts one range of one
selection in order and counts its pairs; lower ranges are added as in :mod:`metrics`.

The ranges follow quantiles of some rows' scores. They deal the scores to reducers and
change no result, and a range holds about ``RANGE_ROWS`` scores whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .metrics import add_lower_ranges
from .scorer import FLOOR

#: Scores a range holds about, scores a task collects before it hands them on, cells of a block.
RANGE_ROWS = 1 << 18
HELD_SCORES = 1 << 21
BLOCK_CELLS = 1 << 19
#: Rows whose scores choose the ranges, per range.
ROWS_PER_CUT = 64
SCORE_BYTES = 9


class Models:
    """Diagonal Gaussian models: ``prior (model)``, ``mean`` and ``var (model, class, feature)``."""

    def __init__(self, prior: np.ndarray, mean: np.ndarray, var: np.ndarray):
        self.prior, self.mean, self.var, self.log_var = prior, mean, var, np.log(var)

    @staticmethod
    def of_moments(train1: np.ndarray, train0: np.ndarray) -> Models:
        """From ``n, sums, sums of squares`` of both classes; NaN where a class is missing."""
        f = (train1.shape[-1] - 1) // 2
        both = np.stack([train0, train1], axis=1)
        n = np.round(both[..., :1])
        n[n <= 0] = np.nan
        mean = both[..., 1:f + 1] / n
        var = np.maximum(both[..., f + 1:] / n - mean * mean, 0.0) + FLOOR
        return Models(np.log(n[:, 1, 0]) - np.log(n[:, 0, 0]), mean, var)

    @staticmethod
    def of_rows(rows: Sequence[Row], features: Sequence[str]) -> Models:
        """From rows of :func:`scorer.to_models`."""
        part = lambda kind: np.array([[[r[f"_{f}_{kind}{y}"] for f in features] for y in (0, 1)] for r in rows], dtype=float)
        shape = (len(rows), 2, len(features))
        return Models(np.array([r["_prior"] for r in rows], dtype=float), part("m").reshape(shape), part("v").reshape(shape))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """``(model, row)``. Element by element, so that equal rows have equal scores."""
        out = np.repeat(self.prior[:, None], len(x), axis=1)
        for j in range(x.shape[1]):
            for y, sign in ((1, -1.0), (0, 1.0)):
                gap = x[None, :, j] - self.mean[:, y, j, None]
                out += sign * (self.log_var[:, y, j, None] + gap * gap / self.var[:, y, j, None]) / 2
        return out


Scored = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]


def _blocks(batches: Iterator[pa.RecordBatch], n_sel: int) -> Iterator[pa.RecordBatch]:
    step = max(1, BLOCK_CELLS // max(n_sel, 1))
    for b in batches:
        for lo in range(0, b.num_rows, step):
            yield b.slice(lo, step)


def _cuts(rows: DataFrame, n_sel: int, scored: Scored) -> np.ndarray:
    """Where the ranges of each selection end, ``(selection, ranges - 1)``."""
    n = rows.count()
    n_ranges = -(-n // RANGE_ROWS)
    if n_ranges <= 1:
        return np.zeros((n_sel, 0))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, n_sel):
            score = scored(b)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(n_sel), pa.int32()), pa.array([s[np.isfinite(s)].tobytes() for s in score], pa.binary())], names=["sel", "data"]
            )

    def quantiles(table: pa.Table) -> pa.Table:
        values = np.frombuffer(b"".join(v.as_py() for v in table.column("data")))
        cut = np.quantile(values, np.arange(1, n_ranges) / n_ranges) if len(values) else np.zeros(n_ranges - 1)
        return pa.table({"sel": pa.array([table.column("sel")[0].as_py()], pa.int32()), "data": pa.array([cut.tobytes()], pa.binary())})

    schema = "sel int, data binary"
    near = rows.sample(min(1.0, ROWS_PER_CUT * n_ranges / n), seed=0).mapInArrow(some, schema)
    out = np.zeros((n_sel, n_ranges - 1))
    for sel, data in near.groupBy("sel").applyInArrow(quantiles, schema).collect():  # one row per selection
        out[sel] = np.frombuffer(data)
    return out


def _pack(score: np.ndarray, y: np.ndarray) -> bytes:
    return score.tobytes() + y.astype(np.uint8).tobytes()


def _unpack(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = [len(d) // SCORE_BYTES for d in data]
    score = np.concatenate([np.frombuffer(d, np.float64, m) for d, m in zip(data, n)])
    return score, np.concatenate([np.frombuffer(d, np.uint8, m, 8 * m) for d, m in zip(data, n)])


def auroc_of_selections(rows: DataFrame, n_sel: int, scored: Scored) -> DataFrame:
    """``sel, n_pos, n_neg, auroc``; ties count half, NULL for a single class.

    ``rows`` is read three times. ``scored`` makes ``(selection, row)`` scores of a batch,
    NaN where a row is not in a selection, and the labels of its rows.
    """
    cuts = _cuts(rows, n_sel, scored)

    def told(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        out: list[tuple[int, int, bytes]] = []
        y = np.concatenate([y for _, y in held])
        for sel in range(n_sel):
            score = np.concatenate([s[sel] for s, _ in held])
            at = np.flatnonzero(~np.isnan(score) & ((y == 0) | (y == 1)))
            part = np.searchsorted(cuts[sel], score[at], side="left")
            at = at[np.argsort(part, kind="stable")]
            ends = np.cumsum(np.bincount(part, minlength=cuts.shape[1] + 1))
            for i, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends)):
                if lo < hi:
                    out.append((sel, i, _pack(score[at[lo:hi]], y[at[lo:hi]])))
        columns = list(zip(*out)) or [(), (), ()]
        kinds = (pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["sel", "_range", "data"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in _blocks(batches, n_sel):
            held.append(scored(b))
            size += held[-1][0].size
            if size >= HELD_SCORES:
                yield told(held)
                held, size = [], 0
        if held:
            yield told(held)

    def pairs(table: pa.Table) -> pa.Table:
        values, y = _unpack([v.as_py() for v in table.column("data")])
        order = np.argsort(values, kind="stable")
        values, y = values[order], y[order].astype(np.int64)
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        pos, neg = np.add.reduceat(y, starts), np.add.reduceat(1 - y, starts)
        u = float((pos * (np.cumsum(neg) - neg + neg / 2.0)).sum())
        first = [table.column(c)[0].as_py() for c in ("sel", "_range")]
        columns = zip((*first, int(pos.sum()), int(neg.sum()), u), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()))
        return pa.Table.from_arrays([pa.array([v], k) for v, k in columns], names=["sel", "_range", "_p", "_n", "_u"])

    packed = rows.mapInArrow(score, "sel int, _range int, data binary")
    counted = packed.groupBy("sel", "_range").applyInArrow(pairs, "sel int, _range int, _p bigint, _n bigint, _u double")
    whole = add_lower_ranges(counted, ["sel"]).groupBy("sel").agg(*[F.sum(c).alias(c) for c in ("_p", "_n", "_u")])
    counts = [F.col("_p").cast("bigint").alias("n_pos"), F.col("_n").cast("bigint").alias("n_neg")]
    return whole.select("sel", *counts, F.try_divide(F.col("_u"), (F.col("_p") * F.col("_n")).cast("double")).alias("auroc"))
