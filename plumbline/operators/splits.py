"""Cross-validation folds as a long table, and how much they leak.

A fold is a pure function of a hash and the label stratum, so a repeat can be
recomputed anywhere. Units (recordings, folders, participants) are put in hash
order within ``(cell, repeat, label)`` and dealt out round-robin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..functions import draws as D
from ..session import is_small, materialise
from .blocks import matrix, summed
from .ordering import dense_rank, window
from .permute import NO_DRAW, chosen, cut_draws

# Arm names and the column each one groups by.
ARMS = {
    "A_recording": None,
    "B_folder_path": "folder_path",
    "C_subject_key": "subject_id",
    "D_leave_one_corpus_out": "corpus",
}


def grouping_column(df: DataFrame, arm: str) -> str | None:
    if arm not in ARMS:
        raise KeyError(f"unknown arm {arm!r}; expected one of {sorted(ARMS)}")
    column = ARMS[arm]
    if column is not None and column not in df.columns:
        raise KeyError(f"the table is missing the {column!r} column needed by {arm!r}")
    return column


#: Counts per fold.
LEAKS = ["n_test_recordings", "n_leaked_participants", "n_leaked_recordings"]
#: Corpora that can be left out one by one; each is a fold with a model of its own.
MOST_CORPORA = 10_000


def without_unit(df: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Rows that an arm cannot deal, as they lack its unit: ``df`` columns and ``error``."""
    columns = {arm: grouping_column(df, arm) or "recording_id" for arm in arms}
    errors = [F.when(F.col(c).isNull(), F.lit(f"no {c} for {arm}")) for arm, c in columns.items()]
    return df.withColumn("error", F.array_join(F.array_compact(F.array(*errors)), "; ")).where("error <> ''")


def _unit(column: str, arm: str):
    """A row without unit stops the query: it would be lost or have no fold."""
    refuse = F.raise_error(F.lit(f"recording without {column} cannot be dealt in {arm}")).cast("string")
    return F.coalesce(F.col(column).cast("string"), refuse)


def _deal(units: DataFrame, cell: Sequence[str], k: int, n_repeats: int, seed: int, column: str, kind: str) -> DataFrame:
    """Units ``cell, _unit, label`` to ``cell, column, _own``: the fold of every repeat.

    On large inputs a unit meets only the units of its range of draws. The units of lower
    ranges are counted without moving any: cells times labels times repeats times ranges
    numbers, sent to every task.
    """
    groups = [*cell, "repeat", "label"]
    rows = units.withColumn("_h", D.text_key(F.col("_unit"))).withColumn(
        "repeat", F.explode(F.sequence(F.lit(0), F.lit(n_repeats - 1)))
    )
    rows = rows.withColumn("_u", D.draw(seed, F.col("repeat"), F.col("_h"))).drop("_h")
    if is_small(units, n_repeats):
        placed = rows.withColumn("_i", F.row_number().over(window(groups).orderBy("_u", "_unit")).cast("bigint"))
    else:
        n = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("_range", F.floor(F.col("_u") * F.lit(n) / F.lit(D.PRIME)).cast("int"))
        lower = window(groups).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
        totals = rows.groupBy(*groups, "_range").agg(F.count(F.lit(1)).alias("_n"))
        before = totals.select(*groups, "_range", F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("_before")).alias("b")
        here = rows.withColumn("_i", F.row_number().over(window([*groups, "_range"]).orderBy("_u", "_unit"))).alias("a")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*groups, "_range"]]
        placed = here.join(F.broadcast(before), same).select(
            *[F.col(f"a.{c}").alias(c) for c in [*cell, "repeat", "_unit"]], (F.col("a._i") + F.col("b._before")).alias("_i")
        )
    fold = F.pmod(F.col("_i") - 1, F.lit(k)).cast("int")
    own = F.array(*[F.max(F.when(F.col("repeat") == r, fold)) for r in range(n_repeats)])
    return placed.groupBy(*cell, F.col("_unit").cast(kind).alias(column)).agg(own.alias("_own"))


def deal_folds(
    df: DataFrame, arms: Sequence[str], k: int = 5, n_repeats: int = 5, seed: int = 42, cell: Sequence[str] = (),
    ready: bool = False,
) -> DataFrame:
    """``df`` plus, for every arm, an array ``_own_<arm>`` with the fold of each repeat.

    Folds are dealt on units with nothing but their keys and label; a recording then meets
    the folds of its units. ``recording_id`` must be unique within a cell. The input is read
    for every kind of unit and again for the joins, so it is computed once and kept unless
    ``ready`` (already materialised). A recording without the unit of an arm stops the
    query; :func:`without_unit` tells which.
    """
    cell = list(cell)
    if not ready:
        df = materialise(df)
    columns = {arm: grouping_column(df, arm) for arm in arms}
    kinds, out, own = dict(df.dtypes), df, {}
    # Recordings last: what follows finds the rows dealt by their key.
    for arm, c in sorted(((a, c) for a, c in columns.items() if c != "corpus"), key=lambda x: x[1] is None):
        column = c or "recording_id"
        units = df.select(*cell, "label", _unit(column, arm).alias("_unit"))
        if c is not None:
            units = units.groupBy(*cell, "_unit").agg(F.max("label").alias("label"))
        dealt = _deal(units, cell, k, n_repeats, seed, column, kinds[column])
        out = out.join(dealt.withColumnRenamed("_own", f"_own_{arm}"), [*cell, column])
        own[arm] = F.col(f"_own_{arm}")
    for arm in [a for a, c in columns.items() if c == "corpus"]:
        corpora = materialise(dense_rank(df.select(*cell, "corpus"), cell, "corpus", "_f_corpus", bounded=True))
        n = corpora.count()
        if n > MOST_CORPORA:
            raise ValueError(f"{n} corpora of all cells are too many to leave out one by one")
        out = out.withColumn("corpus", F.coalesce("corpus", _unit("corpus", arm).cast(kinds["corpus"])))
        # Counted, so every task gets them and no recording is shuffled by its corpus.
        out = out.join(F.broadcast(corpora), [*cell, "corpus"])
        own[arm] = F.array_repeat((F.col("_f_corpus") - 1).cast("int"), n_repeats)
    return out.select(*df.columns, *[own[arm].alias(f"_own_{arm}") for arm in arms])


def with_entries(dealt: DataFrame, arms: Sequence[str]) -> DataFrame:
    """Rows of :func:`deal_folds` with ``_folds``, an array of ``(arm, repeat, fold)``, in their place."""
    # Arms of corpora come last, as their folds are found last.
    order = sorted(arms, key=lambda a: ARMS[a] == "corpus")
    keep = [c for c in dealt.columns if c not in {f"_own_{a}" for a in arms}]
    return dealt.select(*keep, F.concat(*[_entries(a, F.col(f"_own_{a}")) for a in order]).alias("_folds"))


def pack_folds(
    df: DataFrame, arms: Sequence[str], k: int = 5, n_repeats: int = 5, seed: int = 42, cell: Sequence[str] = (),
    ready: bool = False,
) -> DataFrame:
    """``df`` plus ``_folds``: an array of ``(arm, repeat, fold)``, one row per recording."""
    return with_entries(deal_folds(df, arms, k, n_repeats, seed, cell, ready), arms)


def kept_folds(
    df: DataFrame, arms: Sequence[str], k: int = 5, n_repeats: int = 5, seed: int = 42, cell: Sequence[str] = ()
) -> DataFrame:
    """:func:`pack_folds`, computed once and kept with a number per fold."""
    return with_entries(materialise(deal_folds(df, arms, k, n_repeats, seed, cell)), arms)


def _entries(arm: str, folds):
    return F.transform(
        folds, lambda f, r: F.struct(F.lit(arm).alias("arm"), r.cast("int").alias("repeat"), f.cast("bigint").alias("fold"))
    )


def unpack_folds(packed: DataFrame, *columns: str) -> DataFrame:
    """Long form: the row once per arm and repeat. A generator, no shuffle."""
    keep = columns or [c for c in packed.columns if c != "_folds"]
    return packed.select(*keep, F.inline("_folds"))


def assign_folds(
    df: DataFrame, arms: Sequence[str], k: int = 5, n_repeats: int = 5, seed: int = 42, cell: Sequence[str] = (),
    ready: bool = False,
) -> DataFrame:
    """All rows of ``df`` once per arm and repeat with their test ``fold``.

    ``df`` has ``recording_id, label`` and the grouping columns of the arms.
    """
    return unpack_folds(pack_folds(df, arms, k, n_repeats, seed, cell, ready))


def leakage_report(folds: DataFrame, cell: Sequence[str] = (), subject: str = "subject_id") -> DataFrame:
    """Per fold: test rows, participants also in training, and their test rows.

    The folds of a repeat partition the rows, so a participant is on both sides of
    a fold exactly when it has rows in another fold too.
    """
    key = [*cell, "arm", "repeat"]
    per = folds.groupBy(*key, subject, "fold").agg(F.count(F.lit(1)).alias("_n"))
    # at most one row per fold and participant
    spread = W.partitionBy(*key, subject)
    leaks = (F.min("fold").over(spread) != F.max("fold").over(spread)).cast("int")
    return per.withColumn("_l", leaks).groupBy(*key, "fold").agg(
        F.sum("_n").alias("n_test_recordings"),
        F.sum("_l").alias("n_leaked_participants"),
        F.sum(F.col("_n") * F.col("_l")).alias("n_leaked_recordings"),
    )


class _Leaks:
    """Counts of :func:`leakage_of_dealt` in one task: rows come group by group."""

    def __init__(self, n_cols: int):
        self.n_cols = n_cols
        #: Per cell: test rows, leaked participants, leaked rows of ``(column, fold)``.
        self.totals: dict[tuple, np.ndarray] = {}
        #: The group that may go on in the next batch: its key and ``column, fold, n``.
        self.open: tuple | None = None

    def add(self, keys: list[pa.Array], own: np.ndarray) -> None:
        """``keys`` are the columns of cell and participant; equal ones follow one another."""
        rows = len(own)
        codes = [k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys]
        first = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in codes], axis=0)])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, rows]))
        width = int(own.max()) + 1
        found, n = np.unique((group[:, None] * self.n_cols + np.arange(self.n_cols)) * width + own, return_counts=True)
        pair, fold = np.divmod(found, width)
        group, col = np.divmod(pair, self.n_cols)
        key = lambda i: tuple(k[int(first[i])].as_py() for k in keys)
        if self.open is not None and self.open[0] == key(0):
            _, c, f, m = self.open
            group, col, fold, n = np.r_[np.zeros(len(c), int), group], np.r_[c, col], np.r_[f, fold], np.r_[m, n]
        else:
            self.close()
        last = group == len(first) - 1
        at = np.unique(col[last] * (fold[last].max() + 1) + fold[last], return_inverse=True)
        c, f = np.divmod(at[0], fold[last].max() + 1)
        self.open = (key(len(first) - 1), c, f, np.bincount(at[1], n[last]).astype(np.int64))
        done = ~last
        if done.any():
            cell = np.r_[True, np.any([c[first[1:]] != c[first[:-1]] for c in codes[:-1]], axis=0)] if len(codes) > 1 else np.arange(len(first)) == 0
            run = np.cumsum(cell) - 1
            for i, start in enumerate(np.flatnonzero(cell)):
                here = done & (run[group] == i)
                if here.any():
                    self._count(key(start)[:-1], group[here], col[here], fold[here], n[here])

    def close(self) -> None:
        if self.open is not None:
            key, c, f, n = self.open
            self._count(key[:-1], np.zeros(len(c), int), c, f, n)
            self.open = None

    def _count(self, cell: tuple, group: np.ndarray, col: np.ndarray, fold: np.ndarray, n: np.ndarray) -> None:
        """Whole groups; a fold of a group may come in two parts."""
        width = int(fold.max()) + 1
        at, back = np.unique((group * self.n_cols + col) * width + fold, return_inverse=True)
        n = np.bincount(back, n).astype(np.int64)
        pair, fold = np.divmod(at, width)
        _, back, folds = np.unique(pair, return_inverse=True, return_counts=True)
        leaks, col = folds[back] > 1, pair % self.n_cols
        total = self.totals.get(cell)
        if total is None or total.shape[2] < width:
            grown = np.zeros((3, self.n_cols, width), np.int64)
            if total is not None:
                grown[:, :, : total.shape[2]] = total
            total = self.totals[cell] = grown
        for counted, v in zip(total, (n, leaks, n * leaks)):
            np.add.at(counted, (col, fold), v)


def leakage_of_dealt(
    dealt: DataFrame, arms: Sequence[str], n_repeats: int, cell: Sequence[str] = (), subject: str = "subject_id"
) -> DataFrame:
    """:func:`leakage_report` from rows of :func:`deal_folds`, one row per recording.

    Rows are put in order by participant once for all arms and repeats, and counted as a
    stream: a task holds one participant's counts, never its rows.
    """
    cell = list(cell)
    own = F.concat(*[F.col(f"_own_{a}") for a in arms])
    rows = dealt.select(*cell, subject, own.alias("_own"))
    rows = rows.repartition(*cell, subject).sortWithinPartitions(*cell, subject)
    fields = [rows.schema[c] for c in cell]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kinds = _Leaks(len(arms) * n_repeats), None
        for b in batches:
            if b.num_rows:
                kinds = b.schema.types[:-2]
                held.add(b.columns[:-1], matrix(b.column(b.num_columns - 1), np.int64))
        held.close()
        for at, total in held.totals.items():
            col, fold = np.nonzero(total[0])
            counts = [pa.array(t[col, fold], pa.int64()) for t in total]
            keys = [pa.array([v] * len(col), t) for v, t in zip(at, kinds)]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.array(col, pa.int32()), pa.array(fold, pa.int64()), *counts], names=[*cell, "_col", "fold", *LEAKS]
            )

    schema = StructType([*fields, *[StructField(c, t) for c, t in zip(["_col", "fold", *LEAKS], [IntegerType()] + [LongType()] * 4)]])
    counted = rows.mapInArrow(count, schema).groupBy(*cell, "_col", "fold").agg(*[F.sum(c).alias(c) for c in LEAKS])
    arm = F.element_at(F.array(*[F.lit(a) for a in arms]), F.floor(F.col("_col") / n_repeats).cast("int") + 1)
    return counted.select(*cell, arm.alias("arm"), (F.col("_col") % n_repeats).cast("int").alias("repeat"), "fold", *LEAKS)


def leakage_rates(report: DataFrame, cell: Sequence[str] = ()) -> DataFrame:
    return report.groupBy(*cell, "arm").agg(
        F.count(F.lit(1)).alias("folds"),
        F.count_if(F.col("n_leaked_participants") > 0).alias("folds_with_leakage"),
        F.avg("n_leaked_participants").alias("mean_leaked_participants"),
        F.avg("n_leaked_recordings").alias("mean_leaked_test_recordings"),
        (F.sum("n_leaked_recordings") * 100.0 / F.sum("n_test_recordings")).alias("pct_test_recordings_leaked"),
    )


def check_contrast(rates: DataFrame, disjoint: str = "C_subject_key", leaky: str = "A_recording") -> DataFrame:
    """Stop unless the disjoint arm never leaks and the leaky arm does."""
    bad = (F.col("arm") == disjoint) & (F.col("folds_with_leakage") > 0)
    bad = bad | ((F.col("arm") == leaky) & (F.col("folds_with_leakage") == 0))
    folds = F.when(bad, F.raise_error(F.concat(F.lit("split contrast violated by "), "arm"))).otherwise(F.col("folds"))
    return rates.withColumn("folds", folds.cast("bigint"))


class Subsets:
    """Participants drawn for training, told by the draw of the last one of each subset.

    ``keys`` are ``(repeat, fold, fraction, n_train)``. Within a participant-disjoint fold,
    the first ``max(smallest, round(f * n))`` training participants in the order of their
    draws are taken.
    """

    def __init__(self, people: DataFrame, fractions: Sequence[float], k: int, seed: int, smallest: int = 4):
        """``people``: one row ``unit, own`` per participant, ``own`` the fold in each repeat."""
        n_repeats = len(people.select("own").first()[0])
        pairs = [(r, f) for r in range(n_repeats) for f in range(k)]

        def sizes(b) -> np.ndarray:
            own = matrix(b.column(0), np.int64)
            return np.array([(own[:, r] != f).sum() for r, f in pairs], dtype=float)

        n = dict(zip(pairs, summed(people.select("own"), sizes, len(pairs)).astype(int).tolist()))
        # round() of Python is half-even, as is that of the reference's language.
        wanted = lambda f, m: min(m, max(smallest, round(f * m)))
        self.keys = [(r, f, float(s), wanted(s, n[r, f])) for r, f in pairs if n[r, f] for s in fractions]
        self.seed = seed
        self.pair = [(r, f) for r, f, *_ in self.keys]
        self.cut, self.cut_unit = cut_draws(people.select("unit", "own"), np.array([key[3] for key in self.keys]), self.draws)

    def draws(self, b) -> np.ndarray:
        """Draws ``(subset, row)`` of a batch ``unit, own``; the held-out fold takes no part."""
        return self._draws(b.column(0).to_numpy(zero_copy_only=False), matrix(b.column(1), np.int64))

    def _draws(self, unit: np.ndarray, own: np.ndarray) -> np.ndarray:
        known = {p: np.where(own[:, p[0]] == p[1], NO_DRAW, D.draw_np(self.seed, p[0], p[1], unit)) for p in set(self.pair)}
        return np.stack([known[p] for p in self.pair])

    def member(self, unit: np.ndarray, own: np.ndarray) -> np.ndarray:
        return chosen(self._draws(unit, own), unit, self.cut, self.cut_unit)


def fold_of_participants(folds: DataFrame, subject: str = "subject_id") -> DataFrame:
    """``unit, subject, own``: a participant's key and its fold in each repeat."""
    per = folds.groupBy(subject, "repeat").agg(F.max("fold").cast("int").alias("fold"))
    own = F.transform(F.sort_array(F.collect_list(F.struct("repeat", "fold"))), lambda x: x["fold"])
    return per.groupBy(subject).agg(own.alias("own")).select(D.unit_key(folds, subject).alias("unit"), subject, "own")


def training_subsets(
    folds: DataFrame, fractions: Sequence[float], seed: int = 42, smallest: int = 4, subject: str = "subject_id"
) -> DataFrame:
    """``repeat, fold, fraction, n_train_participants, subject`` of every drawn participant."""
    people = materialise(fold_of_participants(folds.where(F.col(subject).isNotNull()), subject))
    k = folds.agg(F.max("fold")).first()[0]
    subsets = Subsets(people, fractions, (-1 if k is None else int(k)) + 1, seed, smallest)
    cuts = [(*key, int(c), int(u)) for key, c, u in zip(subsets.keys, subsets.cut, subsets.cut_unit)]
    table = folds.sparkSession.createDataFrame(
        cuts, "repeat int, fold int, fraction double, n_train_participants bigint, _cut bigint, _cut_unit bigint"
    )
    rows = people.join(F.broadcast(table), F.element_at("own", F.col("repeat") + 1) != F.col("fold"))
    u = D.draw(seed, F.col("repeat"), F.col("fold"), F.col("unit"))
    drawn = rows.where((u < F.col("_cut")) | ((u == F.col("_cut")) & (F.col("unit") <= F.col("_cut_unit"))))
    return drawn.select("repeat", F.col("fold").cast("bigint").alias("fold"), "fraction", "n_train_participants", subject)
