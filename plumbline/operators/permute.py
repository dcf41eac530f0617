"""Permutation nulls of a refitted scorer, without participants times permutations.

A permutation of two labels is a choice of who is positive: the participants with the
``n_pos`` smallest draws. The last of them is found for all permutations at once from
counts per range of draws, so that a label becomes a comparison, ``draw <= cut``, and
can be made anywhere again. The rest is matrix products over blocks of participants:
labels times moments give class totals per fold, and moments times the coefficients of
the held-out models (log odds are quadratic in the features) give scores.

What is shuffled are totals per permutation, arm and fold, and counts per level of score.
Scores of permuted labels are compared in levels of ``1 / LEVELS`` of log odds; equal
levels count half, like any tie. The observed value is computed from exact scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import draws as D
from ..session import materialise
from .metrics import add_lower_ranges
from .scorer import FLOOR

#: Ranges a span of draws is cut into per round, and draws per permutation that are
#: looked at one by one in the end. Neither changes a result.
RANGES = 256
SINGLE = 32
#: Levels of score per unit of log odds, and levels that are counted together.
LEVELS = 1024
LEVEL_BLOCK = 1024
#: Cells of a block of labels.
MATRIX_CELLS = 1 << 21


def _blocks(n_rows: int, n_perm: int) -> Iterator[slice]:
    step = max(1, MATRIX_CELLS // max(n_perm, 1))
    for at in range(0, n_rows, step):
        yield slice(at, min(at + step, n_rows))


# -- which participants are positive ---------------------------------------------------


def _draws(seed: int, n_perm: int, units: np.ndarray) -> np.ndarray:
    return D.draw_np(seed, np.arange(n_perm)[:, None], units[None, :])


#: Stands for a unit that takes no part; above every draw.
NO_DRAW = 1 << 40


def _range_counts(units: DataFrame, lo: np.ndarray, step: np.ndarray, draw: Callable) -> np.ndarray:
    """How many draws of each selection fall into each range that begins at ``lo``."""
    n_sel = len(lo)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_sel * RANGES, dtype=np.int64)
        for batch in batches:
            for part in _blocks(batch.num_rows, n_sel):
                at = (draw(batch.slice(part.start, part.stop - part.start)) - lo[:, None]) // step[:, None]
                inside = (at >= 0) & (at < RANGES)
                key = np.arange(n_sel)[:, None] * RANGES + at
                total += np.bincount(key[inside], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["key", "n"])

    out = np.zeros(n_sel * RANGES, dtype=np.int64)
    rows = units.mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    for key, n in rows.collect():  # at most selections times ranges
        out[key] = n
    return out.reshape(n_sel, RANGES)


def cut_draws(units: DataFrame, wanted: np.ndarray, draw: Callable[[pa.RecordBatch], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per selection the draw and the unit of the last of the ``wanted`` smallest draws.

    ``units`` is read a few times; its first column is a whole-number key that settles
    ties, and ``draw`` makes the draws ``(selection, row)`` of a batch. Every round cuts
    the range that holds the wanted draw into ``RANGES`` parts.
    """
    n_sel = len(wanted)
    lo = np.zeros(n_sel, dtype=np.int64)
    span = np.full(n_sel, D.PRIME, dtype=np.int64)
    left = np.maximum(np.asarray(wanted, dtype=np.int64), 1)
    held = np.full(n_sel, units.count(), dtype=np.int64)
    which = np.arange(n_sel)
    if not (np.asarray(wanted) > 0).any():
        return np.full(n_sel, -1), np.full(n_sel, np.iinfo(np.int64).min)
    while held.max() > SINGLE and span.max() > 1:
        step = -(-span // RANGES)
        counts = _range_counts(units, lo, step, draw)
        running = counts.cumsum(axis=1)
        at = np.minimum((running < left[:, None]).sum(axis=1), RANGES - 1)
        held = counts[which, at]
        left = left - (running[which, at] - held)
        lo, span = lo + at * step, step

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column(0).to_numpy(zero_copy_only=False)
            for part in _blocks(len(unit), n_sel):
                u = draw(batch.slice(part.start, part.stop - part.start))
                p, i = np.nonzero((u >= lo[:, None]) & (u < (lo + span)[:, None]))
                columns = [p, u[p, i], unit[part][i]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["sel", "u", "unit"])

    near = units.mapInArrow(pick, "sel bigint, u bigint, unit bigint").collect()  # a few per selection
    rows = np.array(sorted(tuple(r) for r in near), dtype=np.int64).reshape(-1, 3)
    last = rows[np.minimum(np.searchsorted(rows[:, 0], which) + left - 1, len(rows) - 1)]
    some = np.asarray(wanted) > 0
    return np.where(some, last[:, 1], -1), np.where(some, last[:, 2], np.iinfo(np.int64).min)


def permutation_cuts(units: DataFrame, n_pos: int, n_perm: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The last positive participant of each permutation; ``units`` has one column of keys."""
    draw = lambda b: _draws(seed, n_perm, b.column(0).to_numpy(zero_copy_only=False))
    return cut_draws(units, np.full(n_perm, n_pos), draw)


def chosen(u: np.ndarray, units: np.ndarray, cut: np.ndarray, cut_unit: np.ndarray) -> np.ndarray:
    """Whether each draw is among the wanted of its selection."""
    return (u < cut[:, None]) | ((u == cut[:, None]) & (units[None, :] <= cut_unit[:, None]))


def labels_np(seed: int, units: np.ndarray, cut: np.ndarray, cut_unit: np.ndarray) -> np.ndarray:
    """Permuted labels of some units, one row per permutation."""
    return chosen(_draws(seed, len(cut), units), units, cut, cut_unit)


# -- moments, models, scores -----------------------------------------------------------


class Cells:
    """Moments ``n, sum, sum of squares`` around a centre, of the cells of some participants.

    A cell is an (arm, fold) in which a participant has recordings.
    """

    def __init__(self, column: pa.ListArray, centre: np.ndarray):
        self.bounds = column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()
        flat = column.flatten()
        get = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        self.arm, self.fold, n = get("arm"), get("fold"), get("n")
        f = len(centre)
        gap = np.stack([get(f"m_{i}") for i in range(f)], axis=1) - centre
        square = np.stack([get(f"q_{i}") for i in range(f)], axis=1) + n[:, None] * gap * gap
        self.moments = np.concatenate([n[:, None], n[:, None] * gap, square], axis=1)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def coefficients(positive: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Weights of ``n, sum, squares`` in the log odds of each held-out model.

    ``positive`` is ``(fold, perm, moments)`` of one arm, ``total`` the same for both
    labels ``(fold, moments)``; a model is trained on all other folds. NaN when training
    lacks a class.
    """
    train1 = positive.sum(axis=0)[None] - positive
    return odds_weights(train1, (total.sum(axis=0)[None] - total)[:, None, :] - train1)


def odds_weights(train1: np.ndarray, train0: np.ndarray) -> np.ndarray:
    """Weights of ``n, sum, squares`` in the log odds, from the moments of both classes."""
    f = (train1.shape[-1] - 1) // 2
    out = np.zeros_like(train1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for side, sign in ((train1, -1.0), (train0, 1.0)):
            n = np.round(side[..., :1])
            n[n <= 0] = np.nan
            mean = side[..., 1:f + 1] / n
            var = np.maximum(side[..., f + 1:] / n - mean * mean, 0.0) + FLOOR
            out[..., 0] -= sign * np.log(n[..., 0])
            out[..., 0] += sign * ((np.log(var) + mean * mean / var) / 2).sum(axis=-1)
            out[..., 1:f + 1] -= sign * mean / var
            out[..., f + 1:] += sign / (2 * var)
    return out


def _cells(base: DataFrame, arms: Sequence[str], features: Sequence[str], unit: Column) -> DataFrame:
    """One row per participant: ``unit`` and the list of its cells, at most arms times folds."""
    number = reduce(lambda c, i: c.when(F.col("arm") == arms[i], i), range(1, len(arms)), F.when(F.col("arm") == arms[0], 0))
    cell = F.struct(
        number.cast("int").alias("arm"), F.col("fold").cast("int").alias("fold"), F.col("n"),
        *[F.col(f"m_{f}").alias(f"m_{i}") for i, f in enumerate(features)], *[F.col(f"q_{f}").alias(f"q_{i}") for i, f in enumerate(features)],
    )
    return base.groupBy(unit.alias("unit")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))


def permutation_null(
    base: DataFrame, arms: Sequence[str], features: Sequence[str], n_pos: int, n_perm: int, k: int, seed: int, unit: Column
) -> DataFrame:
    """``arm, perm, auroc`` of the scorer refitted to permuted labels.

    ``base`` holds moments ``n, m_, q_`` per ``(arm, participant, fold)``.
    """
    people = materialise(_cells(base, arms, features, unit))
    centre_row = base.agg(*[(F.sum(F.col("n") * F.col(f"m_{f}")) / F.sum("n")) for f in features]).first()
    centre = np.array([v or 0.0 for v in centre_row])
    cut, cut_unit = permutation_cuts(people.select("unit"), n_pos, n_perm, seed)
    width, n_arms = 1 + 2 * len(features), len(arms)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One more row of labels than permutations: all ones.
        sums = np.zeros((n_arms, k, n_perm + 1, width))
        for batch in batches:
            unit_np = batch.column(0).to_numpy(zero_copy_only=False)
            for part in _blocks(len(unit_np), n_perm):
                cells = Cells(batch.column(1).slice(part.start, part.stop - part.start), centre)
                y = np.concatenate([labels_np(seed, unit_np[part], cut, cut_unit), np.ones((1, part.stop - part.start), bool)])
                for a in range(n_arms):
                    for fold in range(k):
                        at = np.flatnonzero((cells.arm == a) & (cells.fold == fold))
                        if len(at):
                            sums[a, fold] += y[:, cells.owner[at]].astype(np.float64) @ cells.moments[at]
        flat = sums.reshape(-1, width)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(flat)), pa.int64()), *[pa.array(flat[:, i]) for i in range(width)]],
            names=["key", *[f"v{i}" for i in range(width)]],
        )

    schema = "key bigint, " + ", ".join(f"v{i} double" for i in range(width))
    sums = people.mapInArrow(total, schema).groupBy("key").agg(*[F.sum(f"v{i}") for i in range(width)])
    table = np.zeros((n_arms * k * (n_perm + 1), width))
    for row in sums.collect():  # arms times folds times permutations
        table[row[0]] = row[1:]
    table = table.reshape(n_arms, k, n_perm + 1, width)
    weights = np.stack([coefficients(t[:, :-1], t[:, -1]) for t in table])
    shared = people.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit_np = batch.column(0).to_numpy(zero_copy_only=False)
            for part in _blocks(len(unit_np), n_perm):
                cells = Cells(batch.column(1).slice(part.start, part.stop - part.start), centre)
                y = labels_np(seed, unit_np[part], cut, cut_unit)
                for a in range(n_arms):
                    yield level_counts(a, _scores(cells, shared.value[a], a), y)

    lists = people.mapInArrow(score, LEVEL_SCHEMA)
    return auroc_of_levels(lists, arms)


def _scores(cells: Cells, weights: np.ndarray, arm: int) -> np.ndarray:
    """Mean log odds ``(perm, participant)`` over the participant's recordings; NaN without any."""
    n_perm, n_people = weights.shape[1], len(cells.bounds) - 1
    out, n = np.zeros((n_perm, n_people)), np.zeros(n_people)
    for fold in range(len(weights)):
        at = np.flatnonzero((cells.arm == arm) & (cells.fold == fold))
        # A participant has one cell per arm and fold.
        who = cells.owner[at]
        out[:, who] += weights[fold] @ cells.moments[at].T
        n[who] += cells.moments[at, 0]
    with np.errstate(divide="ignore", invalid="ignore"):
        return out / np.where(n > 0, n, np.nan)


LEVEL_SCHEMA = "arm int, perm int, block int, level array<int>, pos array<int>, neg array<int>"


def level_counts(arm: int, score: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
    """Counts per permutation and level of score, as one row per permutation and block of levels."""
    perm, who = np.nonzero(np.isfinite(score))
    level = np.floor(score[perm, who] * LEVELS).clip(-(1 << 30), (1 << 30) - 1).astype(np.int64)
    key = (perm.astype(np.int64) << 32) + (level + (1 << 30))
    keys, inverse = np.unique(key, return_inverse=True)
    n = np.bincount(inverse, minlength=len(keys))
    pos = np.bincount(inverse, weights=y[perm, who], minlength=len(keys)).astype(np.int64)
    perms, levels = keys >> 32, (keys & 0xFFFFFFFF) - (1 << 30)
    block = levels // LEVEL_BLOCK
    new = np.flatnonzero(np.r_[True, (perms[1:] != perms[:-1]) | (block[1:] != block[:-1])]) if len(keys) else np.zeros(0, int)
    offsets = pa.array(np.r_[new, len(keys)], pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(v, pa.int32())) for v in (levels, pos, n - pos)]
    columns = [np.full(len(new), arm), perms[new], block[new]]
    return pa.RecordBatch.from_arrays(
        [*[pa.array(c, pa.int32()) for c in columns], *lists], names=["arm", "perm", "block", "level", "pos", "neg"]
    )


def auroc_of_levels(lists: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Levels are counted within their block of levels, then lower blocks are added."""
    keys = ["arm", "perm", "_range"]
    dealt = lists.withColumnRenamed("block", "_range").repartition(*keys)
    rows = dealt.select(*keys, F.inline(F.arrays_zip("level", "pos", "neg")))
    levels = rows.groupBy(*keys, "level").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    lower = W.partitionBy(*keys).orderBy("level").rowsBetween(W.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_n").over(lower), F.lit(0))
    pairs = levels.select(*keys, "_p", "_n", (F.col("_p") * (below + F.col("_n") / 2)).alias("_u"))
    blocks = pairs.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("_p", "_n", "_u")])
    whole = add_lower_ranges(blocks, ["arm", "perm"]).groupBy("arm", "perm").agg(*[F.sum(c).alias(c) for c in ("_p", "_n", "_u")])
    name = F.element_at(F.array(*[F.lit(a) for a in arms]), F.col("arm") + 1).alias("arm")
    return whole.select(name, "perm", F.try_divide(F.col("_u"), (F.col("_p") * F.col("_n")).cast("double")).alias("auroc"))
