"""Many random forests in one plan.

All trees of all fits (repeats, folds, held-out corpora, settings) grow together over
binned features. A row's weight in a tree is a hash draw, so bags need no table and can
be told apart anywhere. As long as a node holds many rows, its split is chosen from
histograms of its candidate features: a pass over the rows serves all such nodes of all
trees, and reducers add the histograms per node and choose. Nodes of few rows are sent,
rows and all, to a task that grows the rest of the branch. Both ways see the same bins,
weights, candidates and order of ties, so where one hands over to the other changes no
tree.

A finished forest has at most ``2 ** (max_depth + 1)`` nodes a tree, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws as D
from ..session import materialise
from .blocks import matrix, summed
from .ordering import exact_quantiles
from .regression import EPS, HELD_OUT, trained_on

BINS = 32
#: Nodes of at most so many rows are grown by one task.
LOCAL_ROWS = 1 << 14
#: Bytes of rows or histograms a task collects before it hands them on.
FLUSH_BYTES = 1 << 23
#: Candidate features of a node come from this seed's neighbour.
CANDIDATE_SEED = 1


@dataclass(frozen=True)
class Forest:
    """One fit: training set as in :mod:`regression`, size and limits."""

    outer: int
    fold: int | None
    trees: int = 100
    max_depth: int = 10
    min_leaf: int = 1


# -- bins -------------------------------------------------------------------------------


def cut_points(rows: DataFrame, n_features: int, bins: int = BINS) -> np.ndarray:
    """Exact quantiles of every feature, ``(feature, bins - 1)``."""
    long = rows.select(F.posexplode("x").alias("feature", "value")).where("value IS NOT NULL")
    probs = [i / bins for i in range(1, bins)]
    out = np.zeros((n_features, bins - 1))
    for row in exact_quantiles(long, ["feature"], "value", probs).collect():  # one per feature
        out[row["feature"]] = [row[f"q_{i}"] for i in range(bins - 1)]
    return out


def binned(rows: DataFrame, cuts: np.ndarray, unit: str, keep: Sequence[str]) -> DataFrame:
    """``unit, label, roles, bins`` and the kept columns; a bin counts the cut points below a value."""
    kinds = dict(rows.dtypes)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(0))
            at = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) if len(x) else x
            codes = pa.array([r.tobytes() for r in at.astype(np.uint8)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], codes], names=["unit", "label", "roles", *keep, "bins"])

    schema = f"unit bigint, label double, roles array<int>, {''.join(f'{c} {kinds[c]}, ' for c in keep)}bins binary"
    chosen = rows.select("x", D.unit_key(rows, unit).alias("unit"), F.col("label").cast("double"), "roles", *keep)
    return chosen.toDF("x", "unit", "label", "roles", *[f"_{c}" for c in keep]).mapInArrow(apply, schema)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


# -- one node ---------------------------------------------------------------------------


def candidates(seed: int, tree: int, node: int, n_features: int, n: int) -> np.ndarray:
    """The ``n`` features with the smallest draws, in ascending order."""
    u = D.draw_np(seed + CANDIDATE_SEED, tree, node, np.arange(n_features))
    return np.sort(np.lexsort((np.arange(n_features), u))[:n])


def histogram(bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights ``(feature, bin, class)``; all whole numbers."""
    m, k = bins.shape
    key = (np.arange(k)[None, :] * BINS + bins) * 2 + y[:, None]
    return np.bincount(key.reshape(-1), weights=np.repeat(w, k), minlength=k * BINS * 2).reshape(k, BINS, 2)


def best_split(hist: np.ndarray, min_leaf: int) -> tuple[int, int] | None:
    """Candidate number and bin: values up to the bin go left. The first of equal ones.

    Minimises the weighted Gini impurity; None if no split lowers it.
    """
    left = hist.cumsum(axis=1)[:, :-1]
    total = hist.sum(axis=1)[:, None]
    right = total - left
    nl, nr = left.sum(axis=2), right.sum(axis=2)
    allowed = (nl >= min_leaf) & (nr >= min_leaf) & (nl > 0) & (nr > 0)
    if not allowed.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 0] ** 2 + left[..., 1] ** 2) / nl + (right[..., 0] ** 2 + right[..., 1] ** 2) / nr
    gain = np.where(allowed, gain, -np.inf)
    at = int(np.argmax(gain))
    whole = total[0, 0]
    if not gain.reshape(-1)[at] > (whole[0] ** 2 + whole[1] ** 2) / whole.sum() * (1 + 1e-12):
        return None
    return at // (BINS - 1), at % (BINS - 1)


class Grower:
    """What all nodes of a set of forests share."""

    def __init__(self, seed: int, n_features: int, forests: Sequence[Forest]):
        if max((f.max_depth for f in forests), default=0) > 30:
            raise ValueError("trees deeper than 30 levels have no node numbers")
        self.seed, self.n_features, self.forests = seed, n_features, list(forests)
        self.n_candidates = max(1, int(n_features**0.5))
        self.first = np.r_[0, np.cumsum([f.trees for f in forests])]

    def forest_of(self, tree: int) -> Forest:
        return self.forests[int(np.searchsorted(self.first, tree, side="right")) - 1]

    def weights(self, tree: int, unit: np.ndarray) -> np.ndarray:
        return D.poisson_np(self.seed, tree, unit)

    def candidates(self, tree: int, node: int) -> np.ndarray:
        return candidates(self.seed, tree, node, self.n_features, self.n_candidates)

    def branch(self, tree: int, node: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[tuple[int, int, int, float]]:
        """``node, feature, bin, share of class 1`` of a node and all below; feature -1 for leaves."""
        limits, out, todo = self.forest_of(tree), [], [(node, np.arange(len(y)))]
        while todo:
            node, at = todo.pop()
            n1, n = float(w[at] @ y[at]), float(w[at].sum())
            share = n1 / n if n else float("nan")
            split = None
            if 0 < n1 < n and n >= 2 * limits.min_leaf and node.bit_length() <= limits.max_depth:
                some = self.candidates(tree, node)
                split = best_split(histogram(bins[at][:, some], y[at], w[at]), limits.min_leaf)
            if split is None:
                out.append((node, -1, 0, share))
                continue
            feature = int(some[split[0]])
            out.append((node, feature, split[1], share))
            left = bins[at, feature] <= split[1]
            todo += [(2 * node, at[left]), (2 * node + 1, at[~left])]
        return out


# -- finished trees ---------------------------------------------------------------------


#: A node as it travels and stays: its place, split (feature -1 for leaves) and share of class 1.
NODES = np.dtype([("tree", "<i4"), ("node", "<i4"), ("feature", "<i2"), ("bin", "<i2"), ("share", "<f8")])


@dataclass
class Trees:
    """Nodes of all trees, sorted by tree and node number (the children of i are 2i and 2i + 1)."""

    grower: Grower
    cuts: np.ndarray
    seed: int
    first: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    share: np.ndarray

    @staticmethod
    def of(grower: Grower, cuts: np.ndarray, seed: int, parts: list[np.ndarray]) -> Trees:
        """``parts`` hold :data:`NODES`; they are given up on the way."""
        nodes = np.concatenate(parts) if parts else np.zeros(0, NODES)
        parts.clear()
        nodes = nodes[np.lexsort((nodes["node"], nodes["tree"]))]
        first = np.searchsorted(nodes["tree"], np.arange(int(grower.first[-1]) + 1))
        return Trees(grower, cuts, seed, first, *[nodes[c].copy() for c in ("node", "feature", "bin", "share")])

    @property
    def tree(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def slots(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """Index of the node of the tree at which each row ends."""
        lo, hi = self.first[tree], self.first[tree + 1]
        nodes, feature, cut = self.node[lo:hi].astype(np.int64), self.feature[lo:hi], self.bin[lo:hi]
        at, moving = np.zeros(len(bins), np.int64), np.arange(len(bins))
        while len(moving):
            here = at[moving]
            moving = moving[feature[here] >= 0]
            here = at[moving]
            if not len(moving):
                break
            child = 2 * nodes[here] + (bins[moving, feature[here]] > cut[here])
            at[moving] = np.searchsorted(nodes, child)
        return at + lo

    def probability(self, tree: int, bins: np.ndarray) -> np.ndarray:
        """Share of class 1 where each row ends; NaN for a tree that saw no row."""
        if self.first[tree] == self.first[tree + 1]:
            return np.full(len(bins), np.nan)
        return self.share[self.slots(tree, bins)]


def _frontier(splits: dict[int, dict[int, tuple[int, int]]], tree: int, bins: np.ndarray) -> np.ndarray:
    """Node number that each row has reached in a tree that is still growing."""
    known, at = splits.get(tree, {}), np.ones(len(bins), np.int64)
    if not known:
        return at
    nodes = np.array(sorted(known), dtype=np.int64)
    feature = np.array([known[n][0] for n in nodes.tolist()])
    cut = np.array([known[n][1] for n in nodes.tolist()])
    moving = np.arange(len(bins))
    while len(moving):
        i = np.minimum(np.searchsorted(nodes, at[moving]), len(nodes) - 1)
        go = nodes[i] == at[moving]
        moving, i = moving[go], i[go]
        at[moving] = 2 * at[moving] + (bins[moving, feature[i]] > cut[i])
    return at


# -- growing ----------------------------------------------------------------------------


def _batch_rows(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.int64), matrix(b.column(2), np.int64), _codes(b.column(3))


class Counting:
    """A large node: its candidates' histograms are added, its split is chosen."""

    SCHEMA = "tree int, node bigint, feature int, bin int, share double, left double, right double, left_share double, right_share double"
    KINDS = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.float64()] * 5)
    #: Marks rows sent instead of a histogram, where that is shorter.
    ROWS, COUNTS = b"r", b"c"

    def __init__(self, grower: Grower):
        self.grower = grower
        self.width = grower.n_candidates * BINS * 2

    def pack(self, tree: int, node: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> bytes | np.ndarray:
        some = bins[:, self.grower.candidates(tree, node)]
        if some.shape[0] * (some.shape[1] + 2) < self.width:
            return self.ROWS + _row_bytes(some, y, w)
        return histogram(some, y, w).reshape(-1)

    def start(self, tree: int, node: int):
        return np.zeros(self.width)

    def add(self, held: np.ndarray, data: bytes) -> np.ndarray:
        if data[:1] == self.COUNTS:
            return held + np.frombuffer(data, offset=1)
        bins, y, w = _rows_of(data[1:], self.grower.n_candidates)
        return held + histogram(bins, y, w).reshape(-1)

    def finish(self, tree: int, node: int, held: np.ndarray) -> list[tuple]:
        hist = held.reshape(-1, BINS, 2)
        n0, n1 = hist[0].sum(axis=0)
        split = best_split(hist, self.grower.forest_of(tree).min_leaf) if n0 and n1 else None
        if split is None:
            return [(tree, node, -1, 0, n1 / (n0 + n1), 0.0, 0.0, 0.0, 0.0)]
        left0, left1 = hist[split[0], :split[1] + 1].sum(axis=0)
        nl, nr = left0 + left1, n0 + n1 - left0 - left1
        feature = int(self.grower.candidates(tree, node)[split[0]])
        return [(tree, node, feature, split[1], n1 / (n0 + n1), nl, nr, left1 / nl, (n1 - left1) / nr)]


class Local:
    """A small node: its rows come together and the rest of the branch is grown at once.

    The branch leaves as one array, so that the driver holds no object per node.
    """

    SCHEMA = "tree int, node bigint, nodes binary"
    KINDS = (pa.int32(), pa.int64(), pa.binary())

    def __init__(self, grower: Grower):
        self.grower = grower

    def pack(self, tree: int, node: int, bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> bytes:
        return _row_bytes(bins, y, w)

    def start(self, tree: int, node: int) -> list[bytes]:
        return []

    def add(self, held: list[bytes], data: bytes) -> list[bytes]:
        held.append(data)
        return held

    def finish(self, tree: int, node: int, held: list[bytes]) -> list[tuple]:
        bins, y, w = _rows_of(b"".join(held), self.grower.n_features)
        grown = [(tree, *r) for r in self.grower.branch(tree, node, bins, y, w)]
        return [(tree, node, np.array(grown, NODES).tobytes())]


def _row_bytes(bins: np.ndarray, y: np.ndarray, w: np.ndarray) -> bytes:
    return np.concatenate([bins, y[:, None].astype(np.uint8), w[:, None].astype(np.uint8)], axis=1).tobytes()


def _rows_of(data: bytes, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    table = np.frombuffer(data, dtype=np.uint8).reshape(-1, n_features + 2)
    return table[:, :-2], table[:, -2].astype(np.int64), table[:, -1].astype(np.float64)


class _Outbox:
    """Pieces of a task; histograms of one node are added before they leave."""

    def __init__(self):
        self.counts: dict[tuple[int, int], np.ndarray] = {}
        self.rows: list[tuple[int, int, bytes]] = []
        self.size = 0

    def put(self, tree: int, node: int, data: bytes | np.ndarray) -> None:
        if isinstance(data, bytes):
            self.rows.append((tree, node, data))
            self.size += len(data)
        elif (tree, node) in self.counts:
            self.counts[tree, node] += data
        else:
            self.counts[tree, node] = data
            self.size += data.nbytes

    def take(self) -> pa.RecordBatch:
        rows = [*self.rows, *((t, n, Counting.COUNTS + c.tobytes()) for (t, n), c in self.counts.items())]
        self.__init__()
        columns = list(zip(*rows)) or [(), (), ()]
        kinds = (pa.int32(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["tree", "node", "data"])


def _pieces(rows: DataFrame, grower: Grower, splits: dict, wanted: dict[int, set[int]], way: Counting | Local) -> DataFrame:
    """``tree, node, data``: what a task knows of each wanted node."""
    shared = rows.sparkSession.sparkContext.broadcast((splits, {t: np.array(sorted(n)) for t, n in wanted.items()}))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, wanted = shared.value
        out = _Outbox()
        for b in batches:
            if not b.num_rows:
                continue
            unit, y, roles, bins = _batch_rows(b)
            masks = {}
            for tree, numbers in wanted.items():
                f = grower.forest_of(tree)
                mask = masks.setdefault((f.outer, f.fold), trained_on(roles, f.outer, f.fold))
                w = np.where(mask, grower.weights(tree, unit), 0)
                at = np.flatnonzero(w)
                node = _frontier(splits, tree, bins[at])
                found = np.minimum(np.searchsorted(numbers, node), len(numbers) - 1)
                ok = numbers[found] == node
                at, node = at[ok], node[ok]
                order = np.argsort(node, kind="stable")
                at, node = at[order], node[order]
                starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]]) if len(node) else []
                for lo, hi in zip(starts, [*starts[1:], len(node)]):
                    some, number = at[lo:hi], int(node[lo])
                    out.put(tree, number, way.pack(tree, number, bins[some], y[some], w[some]))
                if out.size > FLUSH_BYTES:
                    yield out.take()
        yield out.take()

    return rows.select("unit", "label", "roles", "bins").mapInArrow(emit, "tree int, node bigint, data binary")


def _per_node(pieces: DataFrame, way: Counting | Local) -> list:
    """What follows from all pieces of each node, which come to one task one after the other."""
    names = [c.split(" ")[0] for c in way.SCHEMA.split(", ")]

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []
        for b in batches:
            for tree, node, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if now != (tree, node):
                    if now is not None:
                        out += way.finish(*now, held)
                    now, held = (tree, node), way.start(tree, node)
                held = way.add(held, data.as_py())
            if out:
                yield told(out)
                out = []
        if now is not None:
            yield told(way.finish(*now, held))

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), way.KINDS)], names=names)

    return pieces.repartition("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(gather, way.SCHEMA).collect()


def grow(rows: DataFrame, cuts: np.ndarray, forests: Sequence[Forest], seed: int, local_rows: int = LOCAL_ROWS) -> Trees:
    """All trees of all forests over ``unit, label, roles, bins``, which is read a few times."""
    grower = Grower(seed, len(cuts), forests)
    sets = sorted({(f.outer, f.fold) for f in forests}, key=lambda s: (s[0], -1 if s[1] is None else s[1]))
    n_rows = dict(zip(sets, summed(
        rows.select("roles"), lambda b: np.array([trained_on(matrix(b.column(0), np.int64), *s).sum() for s in sets], float), len(sets)
    )))
    done: list[tuple] = []
    splits: dict[int, dict[int, tuple[int, int]]] = {}
    small: dict[int, set[int]] = {}
    large: dict[int, set[int]] = {}
    for tree in range(int(grower.first[-1])):
        f = grower.forest_of(tree)
        (large if n_rows[f.outer, f.fold] > local_rows and f.max_depth > 0 else small).setdefault(tree, set()).add(1)
    while large:
        counting = Counting(grower)
        found, large = _per_node(_pieces(rows, grower, splits, large, counting), counting), {}
        for tree, node, feature, cut, share, left, right, left_share, right_share in found:
            done.append((tree, node, feature, cut, share))
            if feature < 0:
                continue
            splits.setdefault(tree, {})[node] = (feature, cut)
            for child, n, child_share in ((2 * node, left, left_share), (2 * node + 1, right, right_share)):
                if child.bit_length() > grower.forest_of(tree).max_depth:
                    done.append((tree, child, -1, 0, child_share))
                else:
                    (small if n <= local_rows else large).setdefault(tree, set()).add(child)
    branches = [np.array(done, NODES)] if done else []
    if small:
        local = Local(grower)
        branches += [np.frombuffer(r["nodes"], NODES) for r in _per_node(_pieces(rows, grower, splits, small, local), local)]
    return Trees.of(grower, cuts, seed, branches)


# -- use --------------------------------------------------------------------------------


def _mean_probability(trees: Trees, forest: int, bins: np.ndarray) -> np.ndarray:
    first, last = trees.grower.first[forest], trees.grower.first[forest + 1]
    return sum(trees.probability(t, bins) for t in range(first, last)) / (last - first)


def held_out_loss(rows: DataFrame, trees: Trees, forests: Sequence[int]) -> np.ndarray:
    """Mean log loss of the given forests on the inner fold each did not see."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def kernel(b: pa.RecordBatch) -> np.ndarray:
        trees, out = shared.value, np.zeros((2, len(forests)))
        _, y, roles, bins = _batch_rows(b)
        for j, number in enumerate(forests):
            f = trees.grower.forests[number]
            at = roles[:, f.outer] == f.fold
            p = np.clip(_mean_probability(trees, number, bins[at]), EPS, 1 - EPS)
            out[0, j] = -np.where(y[at] == 1, np.log(p), np.log(1 - p)).sum()
            out[1, j] = at.sum()
        return out.reshape(-1)

    total = summed(rows.select("unit", "label", "roles", "bins"), kernel, 2 * len(forests)).reshape(2, -1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return total[0] / total[1]


def score_rows(rows: DataFrame, trees: Trees, chosen: Sequence[tuple[str, int, int]], keep: Sequence[str]) -> DataFrame:
    """``keep, label, model, outer, score`` of the rows whose role in a forest's split is the given one."""
    kinds = dict(rows.dtypes)
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            trees = shared.value
            _, y, roles, bins = _batch_rows(b)
            for name, number, role in chosen:
                outer = trees.grower.forests[number].outer
                at = np.flatnonzero(roles[:, outer] == role)
                if not len(at):
                    continue
                some = b.take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[4:], pa.array(y[at], pa.int32()), pa.array([name] * len(at), pa.string()), pa.array([outer] * len(at), pa.int32()), pa.array(_mean_probability(trees, number, bins[at]))],
                    names=[*keep, "label", "model", "outer", "score"],
                )

    schema = "".join(f"{c} {kinds[c]}, " for c in keep) + "label int, model string, outer int, score double"
    return rows.select("unit", "label", "roles", "bins", *keep).mapInArrow(apply, schema)


KEEP = ("recording_id", "subject_id", "corpus")


def prepared(rows: DataFrame, n_features: int, unit: str = "recording_id", keep: Sequence[str] = KEEP) -> tuple[DataFrame, np.ndarray]:
    """Binned rows, kept, and the cut points."""
    rows = materialise(rows)
    cuts = cut_points(rows, n_features)
    return materialise(binned(rows, cuts, unit, keep)), cuts


def cross_validated(rows: DataFrame, n_features: int, k: int = 5, n_repeats: int = 5, seed: int = 42, keep: Sequence[str] = KEEP, **limits) -> DataFrame:
    """Scores of held-out rows, one per repeat; ``rows`` with the roles of ``with_fold_roles``."""
    data, cuts = prepared(rows, n_features, keep=keep)
    forests = [Forest(r, f, **limits) for r in range(n_repeats) for f in range(k)]
    trees = grow(data, cuts, forests, seed)
    return score_rows(data, trees, [("forest", i, f.fold) for i, f in enumerate(forests)], keep)


def nested_search(rows: DataFrame, n_features: int, name: str, settings: Sequence[dict], n_outer: int, k: int = 3, seed: int = 42, keep: Sequence[str] = KEEP) -> tuple[DataFrame, list[tuple]]:
    """Held-out corpora scored by the best setting, and ``(outer, setting, loss, chosen)``."""
    data, cuts = prepared(rows, n_features, keep=keep)
    n = len(settings)
    inner = [Forest(o, f, **s) for o in range(n_outer) for s in settings for f in range(k)]
    final = [Forest(o, None, **s) for o in range(n_outer) for s in settings]
    trees = grow(data, cuts, [*inner, *final], seed)
    loss = held_out_loss(data, trees, range(len(inner))).reshape(n_outer, n, k)
    chosen, told = [], []
    for o in range(n_outer):
        mean = np.nan_to_num(np.nanmean(loss[o], axis=1), nan=np.inf)
        best = int(np.argmin(mean))
        chosen.append((name, len(inner) + o * n + best, HELD_OUT))
        told += [(o, i, float(mean[i]), i == best) for i in range(n)]
    return score_rows(data, trees, chosen, keep), told


def out_of_bag_error(rows: DataFrame, n_features: int, sizes: Sequence[int], seed: int = 42, **limits) -> DataFrame:
    """``n_trees, oob_error, n_scored, n_votes``: error of the growing forest on rows out of each tree's bag."""
    spark = rows.sparkSession
    data, cuts = prepared(rows.withColumn("roles", F.array(F.lit(0))), n_features, keep=())
    trees = grow(data, cuts, [Forest(0, None, max(sizes), **limits)], seed)
    shared = spark.sparkContext.broadcast(trees)

    def kernel(b: pa.RecordBatch) -> np.ndarray:
        unit, y, _, bins = _batch_rows(b)
        total, votes, out = np.zeros(len(y)), np.zeros(len(y)), np.zeros((len(sizes), 3))
        for t in range(max(sizes)):
            free = np.flatnonzero(shared.value.grower.weights(t, unit) == 0)
            total[free] += shared.value.probability(t, bins[free])
            votes[free] += 1
            for i in [i for i, s in enumerate(sizes) if s == t + 1]:
                some = votes > 0
                out[i] = (((total[some] / votes[some]) > 0.5) != (y[some] == 1)).sum(), some.sum(), votes.sum()
        return out.reshape(-1)

    table = summed(data.select("unit", "label", "roles", "bins"), kernel, 3 * len(sizes)).reshape(-1, 3)
    told = [(int(s), float(w / n) if n else None, int(n), int(v)) for s, (w, n, v) in zip(sizes, table)]
    return spark.createDataFrame(told, "n_trees int, oob_error double, n_scored bigint, n_votes bigint")


def roots(rows: DataFrame, cuts: np.ndarray, forests: Sequence[Forest], seed: int) -> DataFrame:
    """``outer, fold, tree, n_weight, share`` of every tree's bag."""
    spark, grower = rows.sparkSession, Grower(seed, len(cuts), forests)
    n = int(grower.first[-1])

    def kernel(b: pa.RecordBatch) -> np.ndarray:
        unit, y, roles, _ = _batch_rows(b)
        out = np.zeros((n, 2))
        for tree in range(n):
            f = grower.forest_of(tree)
            w = np.where(trained_on(roles, f.outer, f.fold), grower.weights(tree, unit), 0)
            out[tree] = w.sum(), w @ y
        return out.reshape(-1)

    table = summed(rows.select("unit", "label", "roles", "bins"), kernel, 2 * n).reshape(n, 2)
    told = []
    for tree in range(n):
        f, weight = grower.forest_of(tree), table[tree, 0]
        number = tree - int(grower.first[np.searchsorted(grower.first, tree, side="right") - 1])
        told.append((f.outer, f.fold, number, int(weight), float(table[tree, 1] / weight) if weight else None))
    return spark.createDataFrame(told, "outer int, fold int, tree int, n_weight bigint, share double")
