"""Bootstrap intervals, paired differences and label permutations.

Every draw is a hash of (seed, draw number, participant), so an interval does not
depend on partitioning. Two bootstrap weightings are offered:

``poisson``
    each participant's weight is Poisson(1). Participants stay where they are:
    only per-range totals per draw are shuffled, never participants times draws.
``multinomial``
    n draws with replacement among n participants, the textbook scheme. The draws of a
    resample are dealt to ranges of participants by repeated halving; only counts per
    range and draw are shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws as D
from ..session import is_small, materialise
from .metrics import add_lower_ranges, auroc
from .ordering import ROWS_PER_RANGE, dense_position, with_ranges

#: A small input is copied once per this many draws to spread the draws over tasks.
DRAWS_PER_BLOCK = 64
MATRIX_CELLS = 2_000_000
#: Rows, and weights of them, that the Poisson kernel holds at a time.
RUN_ROWS = 256
RUN_CELLS = 1 << 14


def _runs(starts: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Runs of whole groups of equal scores, of about ``RUN_ROWS`` rows."""
    out, lo, ends = [], 0, np.r_[starts[1:], n]
    while lo < n:
        hi = int(ends[min(np.searchsorted(ends, lo + RUN_ROWS), len(ends) - 1)])
        out.append((lo, hi))
        lo = hi
    return out


def _poisson_kernel(keys: list[str], n_boot: int, n_blocks: int, seed: int):
    """Weighted pair counts of one score range for every draw of one block.

    Rows are taken a run at a time, so that weights and totals stay in a core's cache.
    """

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        first = {k: pdf[k].iat[0] for k in [*keys, "_range"]}
        block = int(pdf["_block"].iat[0])
        order = np.argsort(pdf["score"].to_numpy(), kind="stable")
        score, unit = pdf["score"].to_numpy()[order], pdf["unit"].to_numpy()[order]
        label = pdf["label"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        numbers = np.arange(block, n_boot, n_blocks)
        # Positives, negatives and twice the pairs; a pair of equal scores counts half.
        p, n, twice = np.zeros((3, len(numbers)), dtype=np.int64)
        for lo, hi in _runs(starts, len(score)):
            y = label[lo:hi] == 1
            pos, neg = score[lo:hi][y], score[lo:hi][~y]
            below, upto = np.searchsorted(neg, pos), np.searchsorted(neg, pos, side="right")
            ordered = np.r_[unit[lo:hi][~y], unit[lo:hi][y]]
            step = max(1, RUN_CELLS // (hi - lo))
            for at in range(0, len(numbers), step):
                d = slice(at, at + step)
                w = D.poisson_bytes(seed, numbers[None, d], ordered[:, None])
                held = np.zeros((len(neg) + 1, w.shape[1]), dtype=np.int64)
                np.cumsum(w[:len(neg)], axis=0, out=held[1:])
                mine = w[len(neg):].astype(np.int64)
                here = mine.sum(axis=0)
                twice[d] += 2 * n[d] * here + np.einsum("id,id->d", mine, held[below] + held[upto])
                p[d] += here
                n[d] += held[-1]
        out = pd.DataFrame({"draw": numbers, "_p": p, "_n": n, "_u": twice / 2.0})
        for k, v in first.items():
            out[k] = v
        return out[[*keys, "_range", "draw", "_p", "_n", "_u"]]

    return kernel


def _range_kernel(keys: list[str], n_boot: int, n_blocks: int, seed: int, weights_of):
    """Weighted pair counts of one score range for every draw of one block."""

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("score", kind="stable")
        weights = weights_of(pdf, seed)
        pdf = pdf[pdf["score"].notna()]
        score, y = pdf["score"].to_numpy(), pdf["label"].to_numpy() == 1
        starts = np.flatnonzero(np.r_[True, score[1:] != score[:-1]])
        block = int(pdf["_block"].iat[0])
        numbers = np.arange(block, n_boot, n_blocks)
        step = max(1, MATRIX_CELLS // len(pdf))
        parts = []
        for at in range(0, len(numbers), step):
            d = numbers[at:at + step]
            weight = weights(d)
            pos = np.add.reduceat(weight * y, starts, axis=1)
            neg = np.add.reduceat(weight * ~y, starts, axis=1)
            below = np.cumsum(neg, axis=1) - neg
            parts.append(pd.DataFrame({
                "draw": d, "_p": pos.sum(axis=1), "_n": neg.sum(axis=1), "_u": (pos * (below + neg / 2.0)).sum(axis=1),
            }))
        out = pd.concat(parts, ignore_index=True)
        for k in [*keys, "_range"]:
            out[k] = pdf[k].iat[0]
        return out[[*keys, "_range", "draw", "_p", "_n", "_u"]]

    return kernel


def _pair_counts(rows: DataFrame, keys: list[str], small: bool, kernel) -> DataFrame:
    """``keys, draw, auroc`` of rows that carry ``_range`` and ``_block``."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType(
        [T.StructField(k, types[k]) for k in [*keys, "_range"]]
        + [T.StructField(n, T.LongType()) for n in ("draw", "_p", "_n")] + [T.StructField("_u", T.DoubleType())]
    )
    # a fixed number of tasks: the groups are small in bytes but not in work
    group = [*keys, "_range", "_block"]
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *group)
    ranges = rows.groupBy(*group).applyInPandas(kernel, schema)
    if not small:
        ranges = add_lower_ranges(ranges, [*keys, "draw"])
        ranges = ranges.groupBy(*keys, "draw").agg(*[F.sum(c).alias(c) for c in ("_p", "_n", "_u")])
    return ranges.select(*keys, "draw", F.try_divide(F.col("_u"), (F.col("_p") * F.col("_n")).cast("double")).alias("auroc"))


def _in_blocks(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("_block", F.explode(F.array(*[F.lit(b) for b in range(blocks)])))


def poisson_draws(part: DataFrame, keys: Sequence[str], unit: str, n_boot: int, seed: int) -> DataFrame:
    """``keys, draw, auroc`` over rows ``keys, unit, label, score``."""
    keys = list(keys)
    rows = part.where(F.col("score").isNotNull()).select(*keys, D.unit_key(part, unit).alias("unit"), "label", "score")
    small = is_small(rows)
    # A small input is one range per key; the draws are spread instead.
    rows = rows.withColumn("_range", F.lit(0)) if small else with_ranges(rows, ["score"])
    blocks = -(-n_boot // DRAWS_PER_BLOCK) if small else 1
    return _pair_counts(_in_blocks(rows, blocks), keys, small, _poisson_kernel(keys, n_boot, blocks, seed))


# -- n draws among n participants ----------------------------------------------------

#: Draws that a leaf of the tree holds on average, at most; and a node of its upper part.
LEAF_DRAWS = 64
NODE_DRAWS = ROWS_PER_RANGE


def tree_depth(n, per_node: int):
    """Levels of halving until a node holds ``per_node`` of ``n`` draws or fewer."""
    return np.ceil(np.log2(np.maximum(n, per_node) / per_node)).astype(np.int64)


def _left_half(seed: int, draw: np.ndarray, node: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many of ``count`` draws of a node go left: one random bit for each."""
    words, out, piece = -(-count // 32), np.zeros(len(count), dtype=np.int64), 1 << 20
    for first in range(0, int(words.max(initial=0)), piece):
        here = np.clip(words - first, 0, piece)
        owner = np.repeat(np.arange(len(count)), here)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(here) - here, here) + first
        bits = D.draw_np(seed, draw[owner], node[owner], j)
        left = np.minimum(count[owner] - 32 * j, 32)
        ones = np.bitwise_count(bits & ((np.int64(1) << left) - 1))
        out += np.bincount(owner, weights=ones, minlength=len(count)).astype(np.int64)
    return out


def _descend(seed: int, draws: np.ndarray, counts: np.ndarray, first: int, level: int, depth: int, span: tuple[float, float]):
    """Counts ``(draw, node)`` of the nodes from ``first`` on, taken down to ``depth``.

    Only nodes that meet ``span``, a part of the unit interval, are followed.
    """
    while level < depth:
        m = counts.shape[1]
        node = (1 << level) + first + np.arange(m)
        left = _left_half(seed, np.repeat(draws, m), np.tile(node, len(draws)), counts.reshape(-1)).reshape(counts.shape)
        counts = np.stack([left, counts - left], axis=2).reshape(len(draws), 2 * m)
        level, first = level + 1, 2 * first
        lo = max(first, int(span[0] * (1 << level)) - 1)
        hi = min(first + 2 * m, int(span[1] * (1 << level)) + 2)
        counts, first = counts[:, lo - first:hi - first], lo
    return counts, first


def _tree_weights(pdf: pd.DataFrame, seed: int):
    """Weights of one score range, whose rows are neighbours in the order of positions.

    The tree halves the unit interval and deals the ``n`` draws of each resample to its
    nodes; a draw picks the participant whose ``1 / n`` of the interval it falls into.
    The upper part of the tree arrives as rows without score.
    """
    nodes = pdf[pdf["score"].isna()].sort_values("_node")
    people = pdf[pdf["score"].notna()]
    n = int(people["_size"].iat[0])
    begin, m = int(people["_i"].min()) - 1, len(people)
    place = people["_i"].to_numpy().astype(np.int64) - 1 - begin
    top, depth = int(tree_depth(n, NODE_DRAWS)), int(tree_depth(n, LEAF_DRAWS))
    upper = np.stack(nodes["_counts"].to_list()).astype(np.int64)
    span = (begin / n, (begin + m) / n)

    def weights(numbers: np.ndarray) -> np.ndarray:
        counts, first = _descend(seed, numbers, upper[:, numbers].T, int(nodes["_node"].iat[0]), top, depth, span)
        leaf = first + np.arange(counts.shape[1])
        each = counts.reshape(-1)
        owner = np.repeat(np.arange(len(each)), each)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
        row, at = owner // counts.shape[1], leaf[owner % counts.shape[1]]
        u = D.draw_np(seed + 1, numbers[row], (1 << depth) + at, j)
        pick = np.minimum(((at + (u + 0.5) / D.PRIME) / (1 << depth) * n).astype(np.int64), n - 1) - begin
        inside = (pick >= 0) & (pick < m)
        flat = np.bincount(row[inside] * m + pick[inside], minlength=len(numbers) * m)
        return flat.reshape(len(numbers), m)[:, place]

    return weights


def _upper_tree(sizes: DataFrame, keys: list[str], n_boot: int, seed: int) -> DataFrame:
    """``keys, _node, _counts``: draws of every resample in each node of the upper tree.

    One row per key and resample is worked on by itself, so that no score range has to
    split the root again.
    """
    types = {f.name: f.dataType for f in sizes.schema.fields}
    out = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField("_draw", T.IntegerType()), T.StructField("_node", T.LongType()), T.StructField("_count", T.LongType())]
    )

    def split(pdfs):
        for pdf in pdfs:
            parts = []
            for at in range(len(pdf)):
                row = pdf.iloc[at:at + 1]
                n, draw = int(row["_size"].iat[0]), int(row["_draw"].iat[0])
                counts, _ = _descend(seed, np.array([draw]), np.array([[n]]), 0, 0, int(tree_depth(n, NODE_DRAWS)), (0.0, 1.0))
                made = {k: [row[k].iat[0]] * counts.shape[1] for k in keys}
                parts.append(pd.DataFrame({**made, "_draw": draw, "_node": np.arange(counts.shape[1]), "_count": counts[0]}))
            if parts:
                yield pd.concat(parts, ignore_index=True)

    draws = sizes.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    spread = draws.repartition(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys, "_draw")
    nodes = spread.select(*keys, "_size", "_draw").mapInPandas(split, out)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("_draw", "_count"))), lambda r: r["_count"])
    return nodes.groupBy(*keys, "_node").agg(ordered.alias("_counts"))


def multinomial_draws(part: DataFrame, keys: Sequence[str], unit: str, n_boot: int, seed: int) -> DataFrame:
    """Every resample deals n draws to n participants down a tree of halves.

    Participants stand in the order of their scores, so a score range is a part of the
    unit interval and finds its draws by following the nodes it meets. Only counts per
    node and totals per range and resample are shuffled.
    """
    keys = list(keys)
    rows = part.where(F.col("score").isNotNull()).select(*keys, D.unit_key(part, unit).alias("unit"), "label", "score")
    small = is_small(rows)
    placed = materialise(dense_position(rows, keys, ["score", "unit"], "_i"))
    placed = placed.withColumn("_range", F.lit(0)) if small else with_ranges(placed, ["score"])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    extent = placed.groupBy(*keys, "_range").agg(F.min("_i").alias("_lo"), F.max("_i").alias("_hi"))
    extent = _with_size(extent, sizes, keys)
    # The nodes a range meets, one more on each side against rounding.
    depth = F.ceil(F.log2(F.greatest(F.col("_size"), F.lit(NODE_DRAWS)) / F.lit(NODE_DRAWS)))
    n_nodes = F.pow(F.lit(2.0), depth).cast("bigint")
    lo = F.greatest(F.floor((F.col("_lo") - 1) / F.col("_size") * n_nodes) - 1, F.lit(0))
    hi = F.least(F.floor(F.col("_hi") / F.col("_size") * n_nodes) + 1, n_nodes - 1)
    met = extent.select(*keys, "_range", "_size", F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))).alias("_node"))
    tree = _upper_tree(sizes, keys, n_boot, seed)
    brought = met.join(tree, [*_same(met, tree, keys), met["_node"] == tree["_node"]]).select(
        *[met[k] for k in keys], "_range", "_size", met["_node"], "_counts"
    )
    sized = _with_size(placed, sizes, keys)
    blocks = -(-n_boot // DRAWS_PER_BLOCK) if small else 1
    both = _in_blocks(sized.unionByName(brought, allowMissingColumns=True), blocks)
    return _pair_counts(both, keys, small, _range_kernel(keys, n_boot, blocks, seed, _tree_weights))


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> list:
    """Equal keys; NULL is a key like others."""
    return [a[k].eqNullSafe(b[k]) for k in keys]


def _with_size(df: DataFrame, sizes: DataFrame, keys: Sequence[str]) -> DataFrame:
    if not keys:
        return df.withColumn("_size", sizes.scalar())
    return df.join(sizes, _same(df, sizes, keys)).select(*[df[c] for c in df.columns], "_size")


METHODS = {"poisson": poisson_draws, "multinomial": multinomial_draws}


def bootstrap_ci(
    part: DataFrame, keys: Sequence[str], unit: str = "subject_id", n_boot: int = 2000,
    alpha: float = 0.05, seed: int = 42, method: str = "poisson", ready: bool = False,
) -> DataFrame:
    """``keys, auroc, ci_lo, ci_hi, n``; draws with a single class are left out.

    The scores are read twice, for the point and for the draws; unless ``ready``
    (already materialised) they are computed once and kept.
    """
    keys = list(keys)
    if not ready:
        part = materialise(part.select(*keys, unit, "label", "score"))
    drawn = METHODS[method](part, keys, unit, n_boot, seed).where("auroc IS NOT NULL")
    band = drawn.groupBy(*keys).agg(F.percentile("auroc", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_q"))
    point = auroc(part, keys).select(*keys, "auroc", (F.col("n_pos") + F.col("n_neg")).alias("n"))
    if not keys:
        return point.select("auroc", *_band(band.select("_q").scalar()), "n")
    joined = point.join(band, keys, "left")
    return joined.select(*keys, "auroc", *_band(F.col("_q")), "n")


def _band(q):
    return q[0].alias("ci_lo"), q[1].alias("ci_hi")


def paired_delta(
    part: DataFrame, keys: Sequence[str], score_a: str, score_b: str, unit: str = "subject_id",
    n_boot: int = 2000, alpha: float = 0.05, seed: int = 42, method: str = "poisson",
) -> DataFrame:
    """``keys, delta, ci_lo, ci_hi, p``: both scores see the same draws."""
    keys = list(keys)
    both = part.where(F.col(score_a).isNotNull() & F.col(score_b).isNotNull())
    both = materialise(both.select(*keys, unit, "label", score_a, score_b))
    long = both.unpivot([*keys, unit, "label"], [score_a, score_b], "_which", "score")
    drawn = METHODS[method](long, [*keys, "_which"], unit, n_boot, seed)

    def difference(df, by):
        pick = lambda s: F.max(F.when(F.col("_which") == s, F.col("auroc")))
        return df.groupBy(*by).agg((pick(score_a) - pick(score_b)).alias("delta"))

    deltas = difference(drawn, [*keys, "draw"]).where("delta IS NOT NULL")
    share = lambda c: F.avg(c.cast("double"))
    band = deltas.groupBy(*keys).agg(
        F.percentile("delta", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("_q"),
        F.least(F.lit(1.0), 2 * F.least(share(F.col("delta") <= 0), share(F.col("delta") >= 0))).alias("p"),
    )
    point = difference(auroc(long, [*keys, "_which"], fanout=2), keys)
    if not keys:
        row = band.select(F.struct("_q", "p")).scalar()
        return point.select("delta", *_band(row["_q"]), row["p"].alias("p"))
    return point.join(band, keys).select(*keys, "delta", *_band(F.col("_q")), "p")


def permuted_labels(subjects: DataFrame, keys: Sequence[str], n_perm: int, seed: int = 42, unit: str = "subject_id") -> DataFrame:
    """``keys, perm, unit, label_perm``: labels shuffled across participants.

    With two labels a shuffle is a choice of who is positive: the first ``n_pos``
    participants in the hash order of that permutation.
    """
    keys = list(keys)
    rows = subjects.select(*keys, unit, "label", F.explode(F.sequence(F.lit(0), F.lit(n_perm - 1))).alias("perm"))
    rows = rows.withColumn("_u", D.draw(seed, F.col("perm"), D.unit_key(subjects, unit)))
    placed = dense_position(rows, [*keys, "perm"], ["_u", unit], "_i", hashed=True, fanout=n_perm)
    n_pos = subjects.groupBy(*keys).agg(F.sum("label").alias("_pos"))
    placed = placed.join(n_pos, keys) if keys else placed.withColumn("_pos", n_pos.scalar())
    return placed.select(*keys, "perm", unit, (F.col("_i") <= F.col("_pos")).cast("int").alias("label_perm"))


def permutation_summary(observed: DataFrame, null: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, observed, null_mean, null_p95, p_value`` with the +1 correction."""
    keys = list(keys)
    rows = null.where("auroc IS NOT NULL").join(observed.select(*keys, F.col("auroc").alias("observed")), keys)
    return rows.groupBy(*keys).agg(
        F.max("observed").alias("observed"), F.avg("auroc").alias("null_mean"),
        F.percentile("auroc", F.lit(0.95)).alias("null_p95"),
        F.percentile("auroc", F.lit(0.025)).alias("null_lo"), F.percentile("auroc", F.lit(0.975)).alias("null_hi"),
        ((F.count_if(F.col("auroc") >= F.col("observed")) + 1) / (F.count(F.lit(1)) + 1)).alias("p_value"),
    )
