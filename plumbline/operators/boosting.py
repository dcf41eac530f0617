"""Boosted shallow trees for many fits in one plan.

Second-order boosting of the log loss over the bins of :mod:`forest`: a split's worth and
a leaf's value come from sums of gradients and curvatures, with a ridge and a lasso on leaf
values. Settings that differ in the number of rounds alone are one fit, read at several
rounds.

Fits of few rows are each boosted by one task that is sent the rows. Fits of many rows are
boosted together, one pass over the table per round and level: reducers add the histograms
of a fit's open nodes, at most ``2 ** depth`` of them, and choose the splits, so what comes
back is one tree per fit. Both ways take the same splits, up to the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import matrix, summed
from .forest import BINS, KEEP, LOCAL_ROWS, _batch_rows, prepared
from .regression import EPS, HELD_OUT, trained_on

RIDGE = 1.0
#: Smallest sum of curvatures of a child.
MIN_CURVATURE = 1.0
#: Rounds after which the margins of all rows are kept.
KEPT_ROUNDS = 10


@dataclass(frozen=True)
class Boost:
    """One fit: training set as in :mod:`regression`, shape of the trees, penalty and step."""

    outer: int
    fold: int | None
    depth: int = 3
    alpha: float = 0.0
    rate: float = 0.1
    rounds: int = 100


class Model:
    """Trees of one fit, nodes numbered as in a heap from 1; feature -1 for leaves."""

    def __init__(self, fit: Boost):
        self.fit = fit
        shape = (fit.rounds, 2 << fit.depth)
        self.feature, self.bin = np.full(shape, -1, np.int16), np.zeros(shape, np.int16)
        self.value = np.zeros(shape)

    def step(self, r: int, bins: np.ndarray, levels: int) -> np.ndarray:
        """Node that each row reaches in a tree after at most ``levels`` splits."""
        at = np.ones(len(bins), np.int64)
        for _ in range(levels):
            f = self.feature[r, at]
            go = np.flatnonzero(f >= 0)
            at[go] = 2 * at[go] + (bins[go, f[go]] > self.bin[r, at[go]])
        return at

    def margin(self, bins: np.ndarray, rounds: int, start: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        out = np.zeros(len(bins)) if start is None else start
        for r in range(first, rounds):
            out = out + self.value[r, self.step(r, bins, self.fit.depth)]
        return out


def _slopes(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p = 0.5 * (1.0 + np.tanh(margin / 2))
    return p - y, np.maximum(p * (1 - p), 1e-16)


def sums(bins: np.ndarray, node: np.ndarray, first: int, n_nodes: int, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gradients and curvatures ``(node, feature, bin, 2)`` of the nodes from ``first`` on."""
    m, k = bins.shape
    key = (((node - first)[:, None] * k + np.arange(k)[None, :]) * BINS + bins).reshape(-1)
    size = n_nodes * k * BINS
    return np.stack([np.bincount(key, np.repeat(v, k), size) for v in (g, h)], axis=1).reshape(n_nodes, k, BINS, 2)


def _soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def grow_level(model: Model, r: int, level: int, hist: np.ndarray) -> None:
    """Split the nodes of a level, and set the values of all nodes that it made."""
    fit, first = model.fit, 1 << level
    for i in range(len(hist)):
        node = first + i
        if level and model.feature[r, node // 2] < 0:
            continue
        left = hist[i].cumsum(axis=1)[:, :-1]
        total = hist[i][0].sum(axis=0)
        right = total - left
        worth = lambda s: _soft(s[..., 0], fit.alpha) ** 2 / (s[..., 1] + RIDGE)
        leaf = lambda s: -fit.rate * _soft(s[0], fit.alpha) / (s[1] + RIDGE)
        if not level:
            model.value[r, node] = leaf(total)
        allowed = (left[..., 1] >= MIN_CURVATURE) & (right[..., 1] >= MIN_CURVATURE)
        # Rounded, so that the order of summation does not choose between equal splits.
        gain = np.where(allowed, np.round(worth(left) + worth(right) - worth(total), 9), -1.0)
        at = int(np.argmax(gain))
        if gain.reshape(-1)[at] <= 0:
            continue
        feature, cut = at // (BINS - 1), at % (BINS - 1)
        model.feature[r, node], model.bin[r, node] = feature, cut
        model.value[r, 2 * node], model.value[r, 2 * node + 1] = leaf(left[feature, cut]), leaf(right[feature, cut])


def boost(model: Model, bins: np.ndarray, y: np.ndarray) -> Model:
    """All rounds of a fit on rows at hand."""
    margin = np.zeros(len(y))
    for r in range(model.fit.rounds):
        g, h = _slopes(margin, y)
        for level in range(model.fit.depth):
            node = model.step(r, bins, level)
            here = node >= 1 << level
            grow_level(model, r, level, sums(bins[here], node[here], 1 << level, 1 << level, g[here], h[here]))
        margin = model.margin(bins, r + 1, margin, r)
    return model


def _local(rows: DataFrame, fits: list[tuple[int, Boost]], n_features: int) -> dict[int, Model]:
    """Fits of few rows: the rows of each come together, already in bins."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, y, roles, bins = _batch_rows(b)
            for number, f in fits:
                at = trained_on(roles, f.outer, f.fold)
                data = np.concatenate([bins[at], y[at, None].astype(np.uint8)], axis=1).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([data], pa.binary())], names=["fit", "data"])

    by_number = dict(fits)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1)):
                held.setdefault(number, []).append(data.as_py())
        for number in sorted(held):
            table = np.frombuffer(b"".join(held.pop(number)), np.uint8).reshape(-1, n_features + 1)
            m = boost(Model(by_number[number]), table[:, :-1], table[:, -1].astype(np.int64))
            arrays = [pa.array([a.tobytes()], pa.binary()) for a in (m.feature, m.bin, m.value)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *arrays], names=["fit", "feature", "bin", "value"])

    pieces = rows.select("unit", "label", "roles", "bins").mapInArrow(emit, "fit int, data binary")
    out = {}
    for row in pieces.repartition("fit").mapInArrow(train, "fit int, feature binary, bin binary, value binary").collect():
        m = Model(by_number[row["fit"]])
        for name in ("feature", "bin", "value"):
            old = getattr(m, name)
            setattr(m, name, np.frombuffer(row[name], old.dtype).reshape(old.shape))
        out[row["fit"]] = m
    return out


def _split_fits(data: DataFrame, models: dict[int, Model], open_fits: list[int], r: int, level: int, first: int) -> None:
    """Split the nodes of a level of each open fit: reducers add its histograms and choose."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            _, y, roles, bins = _batch_rows(b)
            margins = _margins(b, len(models))
            for column, (number, m) in enumerate(models.items()):
                if number not in open_set:
                    continue
                at = np.flatnonzero(trained_on(roles, m.fit.outer, m.fit.fold))
                x = bins[at]
                g, h = _slopes(m.margin(x, r, margins[at, column], first), y[at])
                node = m.step(r, x, level)
                here = node >= 1 << level
                part = sums(x[here], node[here], 1 << level, 1 << level, g[here], h[here])
                total[number] = total[number] + part if number in total else part
        for number, hist in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([hist.tobytes()], pa.binary())], names=["fit", "data"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1)):
                part = np.frombuffer(data.as_py())
                total[number] = total[number] + part if number in total else part
        for number, hist in total.items():
            m = models[number]
            grow_level(m, r, level, hist.reshape(1 << level, -1, BINS, 2))
            arrays = [pa.array([a[r].tobytes()], pa.binary()) for a in (m.feature, m.bin, m.value)]
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *arrays], names=["fit", "feature", "bin", "value"])

    open_set = set(open_fits)
    pieces = data.mapInArrow(emit, "fit int, data binary").repartition("fit")
    for row in pieces.mapInArrow(choose, "fit int, feature binary, bin binary, value binary").collect():  # one tree a fit
        for name in ("feature", "bin", "value"):
            now = getattr(models[row["fit"]], name)
            now[r] = np.frombuffer(row[name], now.dtype)


def _margins(b: pa.RecordBatch, n_fits: int) -> np.ndarray:
    """``(row, fit)`` as of the last round that was kept."""
    return np.frombuffer(b"".join(b.column(4).to_pylist())).reshape(b.num_rows, n_fits)


def _kept(data: DataFrame, models: dict[int, Model], r: int, first: int) -> DataFrame:
    """``data`` with its margins taken on from round ``first`` to round ``r``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, _, roles, bins = _batch_rows(b)
            margins = _margins(b, len(models)).copy()
            for column, m in enumerate(models.values()):
                at = np.flatnonzero(trained_on(roles, m.fit.outer, m.fit.fold))
                margins[at, column] = m.margin(bins[at], min(r, m.fit.rounds), margins[at, column], first)
            packed = pa.array([row.tobytes() for row in margins], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:4], packed], names=[*b.schema.names[:4], "margins"])

    schema = ", ".join(f"{c} {kind}" for c, kind in data.dtypes)
    return materialise(data.mapInArrow(add, schema))


def _distributed(rows: DataFrame, fits: list[tuple[int, Boost]], n_features: int) -> dict[int, Model]:
    """Fits of many rows: one pass per round and level for all of them.

    What comes back is a tree's split per fit. Margins are kept with the rows every
    ``KEPT_ROUNDS`` rounds, so a pass follows a few trees however many there are.
    """
    models = {number: Model(f) for number, f in fits}
    zeros = F.lit(bytearray(8 * len(models)))
    data, first = rows.select("unit", "label", "roles", "bins", zeros.alias("margins")), 0
    for r in range(max(f.rounds for _, f in fits)):
        if r - first == KEPT_ROUNDS:
            data, first = _kept(data, models, r, first), r
        for level in range(max(f.depth for _, f in fits)):
            open_fits = [n for n, f in fits if r < f.rounds and level < f.depth]
            if open_fits:
                _split_fits(data, models, open_fits, r, level, first)
    return models


def fit_all(rows: DataFrame, n_features: int, fits: Sequence[Boost], local_rows: int = LOCAL_ROWS) -> list[Model]:
    """Models of all fits over ``unit, label, roles, bins``."""
    sets = sorted({(f.outer, f.fold) for f in fits}, key=lambda s: (s[0], -1 if s[1] is None else s[1]))
    n = dict(zip(sets, summed(
        rows.select("roles"), lambda b: np.array([trained_on(matrix(b.column(0), np.int64), *s).sum() for s in sets], float), len(sets)
    )))
    small = [(i, f) for i, f in enumerate(fits) if n[f.outer, f.fold] <= local_rows]
    large = [(i, f) for i, f in enumerate(fits) if n[f.outer, f.fold] > local_rows]
    done = {**(_local(rows, small, n_features) if small else {}), **(_distributed(rows, large, n_features) if large else {})}
    return [done.get(i) or Model(f) for i, f in enumerate(fits)]


def nested_search(rows: DataFrame, n_features: int, name: str, shapes: Sequence[dict], stops: Sequence[int], n_outer: int, k: int = 3, keep: Sequence[str] = KEEP) -> tuple[DataFrame, list[tuple]]:
    """Held-out corpora scored by the best shape and number of rounds, and ``(outer, shape, rounds, loss, chosen)``."""
    data, _ = prepared(rows, n_features, keep=keep)
    most, n = max(stops), len(shapes)
    inner = [Boost(o, f, rounds=most, **s) for o in range(n_outer) for s in shapes for f in range(k)]
    final = [Boost(o, None, rounds=most, **s) for o in range(n_outer) for s in shapes]
    models = fit_all(data, n_features, [*inner, *final])
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(models)

    def loss(b: pa.RecordBatch) -> np.ndarray:
        _, y, roles, bins = _batch_rows(b)
        out = np.zeros((len(inner), len(stops), 2))
        for j, f in enumerate(inner):
            at = roles[:, f.outer] == f.fold
            margin, done = None, 0
            for i, stop in enumerate(stops):
                margin, done = shared.value[j].margin(bins[at], stop, margin, done), stop
                p = np.clip(0.5 * (1.0 + np.tanh(margin / 2)), EPS, 1 - EPS)
                out[j, i] = -np.where(y[at] == 1, np.log(p), np.log(1 - p)).sum(), at.sum()
        return out.reshape(-1)

    table = summed(data.select("unit", "label", "roles", "bins"), loss, len(inner) * len(stops) * 2)
    table = table.reshape(n_outer, n, k, len(stops), 2)
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.nan_to_num(np.nanmean(table[..., 0] / table[..., 1], axis=2), nan=np.inf)
    chosen, told = [], []
    for o in range(n_outer):
        best = np.unravel_index(int(np.argmin(mean[o])), mean[o].shape)
        chosen.append((len(inner) + o * n + int(best[0]), stops[best[1]]))
        told += [(o, i, stop, float(mean[o, i, j]), (i, j) == tuple(map(int, best))) for i in range(n) for j, stop in enumerate(stops)]
    kinds = dict(data.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            _, y, roles, bins = _batch_rows(b)
            for number, stop in chosen:
                m = shared.value[number]
                at = np.flatnonzero(roles[:, m.fit.outer] == HELD_OUT)
                p = 0.5 * (1.0 + np.tanh(m.margin(bins[at], stop) / 2))
                yield pa.RecordBatch.from_arrays(
                    [*b.take(pa.array(at)).columns[4:], pa.array(y[at], pa.int32()), pa.array([name] * len(at), pa.string()), pa.array([m.fit.outer] * len(at), pa.int32()), pa.array(p)],
                    names=[*keep, "label", "model", "outer", "score"],
                )

    schema = "".join(f"{c} {kinds[c]}, " for c in keep) + "label int, model string, outer int, score double"
    return data.select("unit", "label", "roles", "bins", *keep).mapInArrow(apply, schema), told
