"""Many logistic regressions at once, from distributed sums.

All fits of a cross-validation or a nested search - repeats, folds, held-out corpora,
penalties - take their Newton steps together: one pass over the rows gives the loss, the
gradient and the second derivatives of every fit. What a pass returns has the size of
the design (fits times squared features) and not of the data. The ridge step is solved
directly, the elastic net by coordinate descent on the second derivatives.

A row's part in the fits is its list of roles, one per outer split: the number of the
inner fold it belongs to, or ``HELD_OUT``. The fit ``(outer, fold)`` is trained on rows
whose role is neither held out nor ``fold``; ``fold`` None trains on all inner folds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .blocks import matrix, summed
from .splits import assign_folds, pack_folds

HELD_OUT = -1
#: Largest violation of the optimality conditions per training row, and passes at most.
TOLERANCE = 1e-9
MAX_PASSES = 100
EPS = float(np.finfo(np.float64).eps)


@dataclass(frozen=True)
class Fit:
    """Training set and penalty: inverse strength ``c`` on the summed loss, share ``l1``."""

    outer: int
    fold: int | None
    c: float
    l1: float = 0.0

    @property
    def ridge(self) -> float:
        return (1.0 - self.l1) / self.c

    @property
    def lasso(self) -> float:
        return self.l1 / self.c


def trained_on(roles: np.ndarray, outer: int, fold: int | None) -> np.ndarray:
    role = roles[:, outer]
    return role != HELD_OUT if fold is None else (role != HELD_OUT) & (role != fold)


# -- roles ------------------------------------------------------------------------------


def with_fold_roles(df: DataFrame, arm: str = "C_subject_key", k: int = 5, n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """Every repeat is an outer split without held-out rows."""
    packed = pack_folds(df, [arm], k, n_repeats, seed)
    roles = F.transform(F.sort_array(F.transform("_folds", lambda x: F.struct(x["repeat"], x["fold"]))), lambda x: x["fold"].cast("int"))
    return packed.withColumn("roles", roles).drop("_folds")


def with_corpus_roles(df: DataFrame, corpora: Sequence, k: int = 3, seed: int = 42, arm: str = "C_subject_key") -> DataFrame:
    """Every corpus is held out once; the others are dealt into ``k`` inner folds.

    Folds are dealt on slim rows, once per pair of row and foreign corpus.
    """
    df = materialise(df)
    outer = F.array(*[F.struct(F.lit(i).alias("outer"), (F.col("corpus") == F.lit(c)).alias("own")) for i, c in enumerate(corpora)])
    slim = df.select("recording_id", "subject_id", "label", F.inline(outer)).where("not own").drop("own")
    dealt = assign_folds(slim, [arm], k, 1, seed, cell=["outer"])
    pairs = dealt.groupBy("recording_id").agg(F.map_from_entries(F.collect_list(F.struct("outer", "fold"))).alias("_in"))
    roles = F.array(*[F.coalesce(F.try_element_at("_in", F.lit(i)).cast("int"), F.lit(HELD_OUT)) for i in range(len(corpora))])
    return df.join(pairs, "recording_id", "left").withColumn("roles", roles).drop("_in")


# -- fitting ----------------------------------------------------------------------------


class Scaler:
    """Per training set: a map from coefficients of scaled features to those of raw ones."""

    def __init__(self, n: float, total: np.ndarray, square: np.ndarray, centre: np.ndarray, scaled: np.ndarray):
        mean = total / max(n, 1.0)
        sd = np.sqrt(np.maximum(square / max(n, 1.0) - mean * mean, 0.0))
        sd = np.where((sd > 1e-12) & scaled, sd, 1.0)
        self.n = n
        self.map = np.eye(len(mean) + 1)
        self.map[1:, 1:] /= sd[:, None]
        self.map[1:, 0] = np.where(scaled, -mean / sd, centre)


def _soft(x: float, t: float) -> float:
    return np.sign(x) * max(abs(x) - t, 0.0)


def _step(beta: np.ndarray, g: np.ndarray, h: np.ndarray, fit: Fit) -> np.ndarray:
    """Minimum of the quadratic model around ``beta`` plus the penalty, minus ``beta``."""
    keep = np.r_[0.0, np.ones(len(beta) - 1)]
    if not fit.lasso:
        a = h + np.diag(fit.ridge * keep + 1e-12)
        return -np.linalg.solve(a, g + fit.ridge * keep * beta)
    new, slope = beta.copy(), g.copy()  # slope of the smooth loss at ``new``
    for _ in range(1000):
        largest = 0.0
        for j in range(len(beta)):
            curve = h[j, j] + 1e-12
            free = curve * new[j] - slope[j]
            best = _soft(free, fit.lasso) / (curve + fit.ridge) if j else free / curve
            move = best - new[j]
            if move:
                slope += h[:, j] * move
                new[j] = best
                largest = max(largest, abs(move))
        if largest < 1e-12:
            break
    return new - beta


def violation(beta: np.ndarray, g: np.ndarray, fit: Fit) -> float:
    """How far the optimality conditions are from being met."""
    slope = g[1:] + fit.ridge * beta[1:]
    at_zero = np.maximum(np.abs(slope) - fit.lasso, 0.0)
    other = np.abs(slope + fit.lasso * np.sign(beta[1:]))
    return float(max(abs(g[0]), np.where(beta[1:] == 0, at_zero, other).max(initial=0.0)))


def _penalty(beta: np.ndarray, fit: Fit) -> float:
    return fit.ridge / 2 * float(beta[1:] @ beta[1:]) + fit.lasso * float(np.abs(beta[1:]).sum())


@dataclass
class Model:
    """A fit's coefficients of centred raw features, intercept first."""

    fit: Fit
    weights: np.ndarray
    n_train: int
    n_pos: int
    residual: float
    passes: int


def _design(batch: pa.RecordBatch, centre: np.ndarray) -> np.ndarray:
    x = matrix(batch.column(0)) - centre
    return np.concatenate([np.ones((len(x), 1)), x], axis=1)


def fit_all(rows: DataFrame, fits: Sequence[Fit], n_features: int, scaled: Sequence[bool] | None = None) -> tuple[list[Model], np.ndarray]:
    """Models of all fits and the centre of their features.

    ``rows`` holds ``x, label, roles`` and is read once per pass.
    """
    data, d = rows.select("x", F.col("label").cast("double"), "roles"), n_features
    scaled = np.ones(d, bool) if scaled is None else np.asarray(scaled)
    sets = sorted({(f.outer, f.fold) for f in fits}, key=lambda s: (s[0], -1 if s[1] is None else s[1]))

    sums = summed(data, lambda b: np.r_[b.num_rows, matrix(b.column(0)).sum(axis=0)], d + 1)
    centre = sums[1:] / max(sums[0], 1.0)

    def moments(b: pa.RecordBatch) -> np.ndarray:
        x, y, roles = matrix(b.column(0)) - centre, b.column(1).to_numpy(), matrix(b.column(2), np.int64)
        out = []
        for s in sets:
            at = trained_on(roles, *s)
            out.append(np.r_[at.sum(), y[at].sum(), x[at].sum(axis=0), (x[at] ** 2).sum(axis=0)])
        return np.concatenate(out)

    table = summed(data, moments, len(sets) * (2 + 2 * d)).reshape(len(sets), -1)
    scalers = {s: Scaler(t[0], t[2:2 + d], t[2 + d:], centre, scaled) for s, t in zip(sets, table)}
    n_pos = {s: t[1] for s, t in zip(sets, table)}
    by_set = {s: [i for i, f in enumerate(fits) if (f.outer, f.fold) == s] for s in sets}
    size = 1 + (d + 1) + (d + 1) ** 2

    def derivatives(weights: np.ndarray, active: frozenset[int]) -> Callable[[pa.RecordBatch], np.ndarray]:
        def kernel(b: pa.RecordBatch) -> np.ndarray:
            x, y, roles = _design(b, centre), b.column(1).to_numpy(), matrix(b.column(2), np.int64)
            out = np.zeros((len(fits), size))
            for s, members in by_set.items():
                members = [i for i in members if i in active]
                if not members:
                    continue
                at = trained_on(roles, *s)
                xs, ys = x[at], y[at]
                eta = xs @ weights[members].T
                p = 0.5 * (1.0 + np.tanh(eta / 2))
                out[members, 0] = (np.logaddexp(0.0, eta) - ys[:, None] * eta).sum(axis=0)
                out[members, 1:d + 2] = (xs.T @ (p - ys[:, None])).T
                for j, i in enumerate(members):
                    out[i, d + 2:] = (xs.T @ (xs * (p[:, j] * (1 - p[:, j]))[:, None])).reshape(-1)
            return out.reshape(-1)

        return kernel

    k = len(fits)
    maps = [scalers[f.outer, f.fold].map for f in fits]
    ns = [scalers[f.outer, f.fold].n for f in fits]
    beta = np.zeros((k, d + 1))
    step, tried, before = np.zeros((k, d + 1)), np.zeros(k), np.full(k, np.inf)
    residual, passes, active = np.full(k, np.inf), np.zeros(k, int), frozenset(range(k))
    for _ in range(MAX_PASSES):
        trial = beta + tried[:, None] * step
        raw = np.stack([m.T @ b for m, b in zip(maps, trial)])
        table = summed(data, derivatives(raw, active), k * size).reshape(k, size)
        left = set()
        for i in active:
            m, passes[i] = maps[i], passes[i] + 1
            objective = table[i, 0] + _penalty(trial[i], fits[i])
            if objective > before[i] + 1e-12 * abs(before[i]) and tried[i] > 1e-6:
                tried[i] /= 2
                left.add(i)
                continue
            g, h = m @ table[i, 1:d + 2], m @ table[i, d + 2:].reshape(d + 1, d + 1) @ m.T
            beta[i], before[i] = trial[i], objective
            residual[i] = violation(beta[i], g, fits[i]) / max(ns[i], 1.0)
            if residual[i] > TOLERANCE:
                step[i], tried[i] = _step(beta[i], g, h, fits[i]), 1.0
                left.add(i)
        active = frozenset(left)
        if not active:
            break
    models = [
        Model(f, m.T @ b, int(n), int(n_pos[f.outer, f.fold]), float(r), int(p))
        for f, m, b, n, r, p in zip(fits, maps, beta, ns, residual, passes)
    ]
    return models, centre


# -- use --------------------------------------------------------------------------------


def _probabilities(x: np.ndarray, models: Sequence[Model]) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(x @ np.stack([m.weights for m in models]).T / 2))


def held_out_loss(rows: DataFrame, models: Sequence[Model], centre: np.ndarray) -> np.ndarray:
    """Mean log loss of each model on the inner fold it did not see; NaN without rows."""
    data = rows.select("x", F.col("label").cast("double"), "roles")

    def kernel(b: pa.RecordBatch) -> np.ndarray:
        x, y, roles = _design(b, centre), b.column(1).to_numpy(), matrix(b.column(2), np.int64)
        p = np.clip(_probabilities(x, models), EPS, 1 - EPS)
        seen = np.stack([roles[:, m.fit.outer] == m.fit.fold for m in models], axis=1)
        loss = -(y[:, None] * np.log(p) + (1 - y[:, None]) * np.log(1 - p))
        return np.r_[(loss * seen).sum(axis=0), seen.sum(axis=0)]

    total = summed(data, kernel, 2 * len(models))
    with np.errstate(divide="ignore", invalid="ignore"):
        return total[:len(models)] / total[len(models):]


def score_rows(rows: DataFrame, chosen: Sequence[tuple[str, Model, int]], centre: np.ndarray, keep: Sequence[str]) -> DataFrame:
    """``keep, model, outer, score`` of the rows whose role in a model's split is the given one."""
    kinds = dict(rows.dtypes)
    models = [m for _, m, _ in chosen]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            p = _probabilities(_design(b, centre), models)
            roles = matrix(b.column(1), np.int64)
            for j, (name, model, role) in enumerate(chosen):
                at = np.flatnonzero(roles[:, model.fit.outer] == role)
                some = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[2:], pa.array([name] * len(at), pa.string()), pa.array([model.fit.outer] * len(at), pa.int32()), pa.array(p[at, j])],
                    names=[*keep, "model", "outer", "score"],
                )

    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", model string, outer int, score double"
    return rows.select("x", "roles", *keep).mapInArrow(apply, schema)


KEEP = ("recording_id", "subject_id", "corpus", "label")


def cross_validated(rows: DataFrame, n_features: int, c: float, l1: float = 0.0, k: int = 5, n_repeats: int = 5, scaled=None, keep: Sequence[str] = KEEP) -> tuple[DataFrame, list[Model]]:
    """Scores of held-out rows, one per repeat (``outer``), and the fits behind them.

    ``rows`` holds ``x, label`` and the ``roles`` of :func:`with_fold_roles`.
    """
    rows = materialise(rows)
    fits = [Fit(r, f, c, l1) for r in range(n_repeats) for f in range(k)]
    models, centre = fit_all(rows, fits, n_features, scaled)
    return score_rows(rows, [("logistic", m, m.fit.fold) for m in models], centre, keep), models


def nested_search(rows: DataFrame, n_features: int, grids: dict[str, Sequence[tuple[float, float]]], n_outer: int, k: int = 3, keep: Sequence[str] = KEEP) -> tuple[DataFrame, list[tuple]]:
    """Scores of held-out corpora by the best setting of each grid, and all settings.

    The inner fits of all settings and their fits on all inner folds are made together;
    the setting with the smallest mean of the folds' log losses is used, the first of equal
    ones. Settings: ``(model, outer, c, l1, loss, chosen, residual)``.
    """
    rows = materialise(rows)
    settings = [(name, c, l1) for name, grid in grids.items() for c, l1 in grid]
    inner = [Fit(o, f, c, l1) for o in range(n_outer) for _, c, l1 in settings for f in range(k)]
    final = [Fit(o, None, c, l1) for o in range(n_outer) for _, c, l1 in settings]
    models, centre = fit_all(rows, [*inner, *final], n_features)
    loss = held_out_loss(rows, models[:len(inner)], centre).reshape(n_outer, len(settings), k)
    chosen, told = [], []
    for o in range(n_outer):
        mean = np.nan_to_num(np.nanmean(loss[o], axis=1), nan=np.inf)
        for name in grids:
            at = [i for i, s in enumerate(settings) if s[0] == name]
            best = min(at, key=lambda i: mean[i])
            chosen.append((name, models[len(inner) + o * len(settings) + best], HELD_OUT))
            for i in at:
                group = [models[(o * len(settings) + i) * k + f] for f in range(k)] + [models[len(inner) + o * len(settings) + i]]
                told.append((name, o, settings[i][1], settings[i][2], float(mean[i]), i == best, max(m.residual for m in group)))
    return score_rows(rows, chosen, centre, keep), told


def train_elsewhere(rows: DataFrame, n_features: int, c: float, l1: float, n_outer: int, keep: Sequence[str] = KEEP) -> tuple[DataFrame, list[Model]]:
    """Every corpus scored by the fit on all others; ``rows`` as in :func:`nested_search`."""
    rows = materialise(rows)
    models, centre = fit_all(rows, [Fit(o, None, c, l1) for o in range(n_outer)], n_features)
    return score_rows(rows, [("logistic", m, HELD_OUT) for m in models], centre, keep), models
