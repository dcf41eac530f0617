"""Ordered operators that never put one key's rows into one task.

Spark's window functions sort a whole partition key in one task. Keys here can
hold a third of a table, so on large inputs the order column is cut into value
ranges first: each ``(key, range)`` is ordered on its own and the totals of
earlier ranges are added as an offset. Small inputs (Catalyst estimate) skip the
ranges; the results are the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.draws import PRIME
from ..session import is_small, materialise

ROWS_PER_RANGE = 1_000_000
SAMPLE_PER_RANGE = 20


def window(keys: Sequence[str]):
    """``partitionBy`` that accepts an empty key list."""
    return W.partitionBy(*[F.col(k) for k in keys]) if keys else W.partitionBy(F.lit(0))


def split_points(df: DataFrame, order: Sequence[str], n_ranges: int, n_rows: int) -> list[tuple]:
    """Cut points for ``n_ranges`` ranges, from a sample of bounded size.

    They only decide how evenly the work is spread, never the result. NULL and NaN are
    no cut points: NULL has a range of its own, NaN belongs to the last one.
    """
    fraction = min(1.0, SAMPLE_PER_RANGE * n_ranges / max(n_rows, 1))
    sample = df.select(*order)
    if fraction < 1.0:
        sample = sample.sample(fraction=fraction, seed=7)
    rows = sorted({tuple(r) for r in sample.collect() if all(v is not None and v == v for v in r)})
    step = max(1, len(rows) // n_ranges)
    return rows[step::step][: n_ranges - 1]


def range_of(order: Sequence[str], cuts: Sequence[tuple]) -> Column:
    """Number of cut points at or below the row, as a balanced decision tree.

    A NULL comes before every range, as it comes first in ascending order.
    """
    here = F.struct(*[F.col(c) for c in order]) if len(order) > 1 else F.col(order[0])

    def literal(cut):
        return F.struct(*[F.lit(v).alias(c) for c, v in zip(order, cut)]) if len(order) > 1 else F.lit(cut[0])

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(here < literal(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(F.col(order[0]).isNull(), F.lit(-1)).otherwise(tree(0, len(cuts)))


def with_ranges(df: DataFrame, order: Sequence[str], n_ranges: int | None = None) -> DataFrame:
    """Materialise ``df`` and add ``_range``, monotone in ``order``."""
    df = materialise(df)
    n_rows = df.count()
    if n_ranges is None:
        n_ranges = max(2, -(-n_rows // ROWS_PER_RANGE))
    cuts = split_points(df, order, n_ranges, n_rows)
    return df.withColumn("_range", range_of(order, cuts))


def _add_offsets(df: DataFrame, keys: Sequence[str], sums: dict[str, str], descending: bool) -> DataFrame:
    """Add the totals of earlier ranges of the same key to each running column."""
    totals = df.groupBy(*keys, "_range").agg(
        *[F.sum(src).alias(f"_t_{out}") for out, src in sums.items()]
    )
    order = F.col("_range").desc() if descending else F.col("_range").asc()
    before = window(keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_range",
        *[F.coalesce(F.sum(f"_t_{out}").over(before), F.lit(0)).alias(f"_o_{out}") for out in sums],
    )
    a, b = df.alias("a"), offsets.alias("b")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "_range"]]
    return a.join(b, same).select(
        *[F.col(f"a.{c}") for c in df.columns if c not in sums and c != "_range"],
        *[(F.col(f"a.{out}") + F.col(f"b._o_{out}")).alias(out) for out in sums],
    )


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, Column],
    descending: bool = False,
    fanout: float = 1.0,
    bounded: bool = False,
) -> DataFrame:
    """One row per ``(keys, order)`` with each sum and its running total.

    Rows are first added up per distinct order value, map-side, so ties are one
    row. Output: ``keys, order, <name>, cum_<name>``; the total includes the row.
    ``bounded`` says a key has a fixed number of order values, such as bins.
    """
    comp = df.groupBy(*keys, order).agg(*[c.alias(n) for n, c in sums.items()])
    small = bounded or is_small(df, fanout)
    if not small:
        comp = with_ranges(comp, [order])
    ordering = F.col(order).desc() if descending else F.col(order).asc()
    part = [*keys] if small else [*keys, "_range"]
    w = window(part).orderBy(ordering).rowsBetween(W.unboundedPreceding, 0)
    out = comp.select("*", *[F.sum(n).over(w).alias(f"cum_{n}") for n in sums])
    if small:
        return out
    return _add_offsets(out, keys, {f"cum_{n}": n for n in sums}, descending)


def dense_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    hashed: bool = False,
    fanout: float = 1.0,
) -> DataFrame:
    """1-based ``row_number`` within ``keys`` by a total order.

    ``hashed`` says the first order column is a uniform draw; its leading digits
    are then the ranges and nothing needs to be sampled.
    """
    small = is_small(df, fanout)
    if not small:
        if hashed:
            n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            df = df.withColumn("_range", F.floor(F.col(order[0]) * F.lit(n) / F.lit(PRIME)).cast("int"))
        else:
            df = with_ranges(df, order)
    part = [*keys] if small else [*keys, "_range"]
    w = window(part).orderBy(*[F.col(c) for c in order])
    out = df.withColumn(name, F.row_number().over(w).cast("bigint"))
    if small:
        return out
    return _add_offsets(out.withColumn("_one", F.lit(1)), keys, {name: "_one"}, False).drop("_one")


def average_rank(df: DataFrame, keys: Sequence[str], value: str, fanout: float = 1.0) -> DataFrame:
    """``keys, value, n_ties, avg_rank`` - one row per distinct value."""
    cum = running_totals(df, keys, value, {"n_ties": F.count(F.lit(1))}, fanout=fanout)
    return cum.select(
        *keys, value, "n_ties",
        (F.col("cum_n_ties") - (F.col("n_ties") - 1) / F.lit(2.0)).alias("avg_rank"),
    )


def dense_rank(df: DataFrame, keys: Sequence[str], value: str, name: str, bounded: bool = False) -> DataFrame:
    """``keys, value, name`` - dense rank of the distinct values of each key."""
    distinct = df.select(*keys, value).distinct()
    cum = running_totals(distinct, keys, value, {"_n": F.count(F.lit(1))}, bounded=bounded)
    return cum.select(*keys, value, F.col("cum__n").cast("bigint").alias(name))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles ``q_0, q_1, ...`` per key.

    Works on the running count of distinct values, so no task holds a whole key.
    """
    if not keys:
        raise ValueError("exact_quantiles needs at least one key column")
    df = df.where(F.col(value).isNotNull())
    cum = running_totals(df, keys, value, {"n": F.count(F.lit(1))})
    total = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    rows = cum.join(total, [*keys])
    aggs = []
    for i, p in enumerate(probs):
        pos = (F.col("_total") - 1) * F.lit(float(p))
        # First value whose running count passes the wanted 0-based position.
        low = F.min(F.when(F.col("cum_n") > F.floor(pos), F.col(value)))
        high = F.min(F.when(F.col("cum_n") > F.ceil(pos), F.col(value)))
        frac = F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * frac).alias(f"q_{i}"))
    return rows.groupBy(*keys).agg(*aggs)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """First row of each key by a total order, as a map-side aggregate."""
    best = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*")


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    value: str,
    offsets: Sequence[int],
    chunk: int = 4096,
) -> DataFrame:
    """Add ``v_<offset>`` = the value at ``pos + offset`` of the same key.

    ``pos`` must be a dense integer. Positions are cut into chunks and the rows
    near a border are copied to the neighbouring chunk, so the window sorts
    bounded groups however long one key is.
    """
    reach = max(abs(o) for o in offsets)
    if reach >= chunk:
        raise ValueError("chunk must be longer than the largest offset")
    home = F.floor(F.col(pos) / F.lit(chunk)).cast("bigint")
    left = F.floor((F.col(pos) - F.lit(reach)) / F.lit(chunk)).cast("bigint")
    right = F.floor((F.col(pos) + F.lit(reach)) / F.lit(chunk)).cast("bigint")
    spread = df.withColumn("_home", home).withColumn(
        "_chunk", F.explode(F.array_distinct(F.array(left, home, right)))
    )
    w = window([*keys, "_chunk"]).orderBy(pos)
    cols = [
        (F.lag(value, -o) if o < 0 else F.lead(value, o)).over(w).alias(f"v_{o}".replace("-", "m"))
        for o in offsets
    ]
    return spread.select("*", *cols).where("_chunk = _home").drop("_chunk", "_home")
