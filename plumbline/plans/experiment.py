"""Experiments: cells times arms times repeats as one keyed plan."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws as D
from ..operators import permute as P
from ..operators import resample as R
from ..operators import scorer as S
from ..operators import selections as L
from ..operators import splits as X
from ..operators.blocks import matrix, summed
from ..operators.metrics import PLACES, auroc, to_participants
from ..operators.splits import Subsets, assign_folds, kept_folds, pack_folds, unpack_folds
from ..session import materialise

KEYS = ["recording_id", "subject_id", "label", "folder_path", "corpus"]

#: Number of corpora assumed when sizing leave-one-corpus-out models.
MAX_CORPORA = 64


def _n_models(cells: int, arms: Sequence[str], k: int, repeats: int) -> int:
    return cells * len(arms) * repeats * max(k, MAX_CORPORA if "D_leave_one_corpus_out" in arms else k)


def score_out_of_fold(
    folds: DataFrame, features: Sequence[str], cell: Sequence[str], n_models: int
) -> DataFrame:
    """``folds`` rows with the log odds of the model that did not see their fold."""
    keys = [*cell, "arm", "repeat"]
    models = S.held_out_models(S.class_moments(folds, [*keys, "fold"], features), keys, features)
    scored = S.attach(folds, models, [*keys, "fold"], n_models, len(features))
    return scored.withColumn("score", S.log_odds(features))


def run_arms(
    df: DataFrame,
    arms: Sequence[str],
    feature_sets: dict[str, Sequence[str]],
    cell: Sequence[str] = (),
    n_cells: int = 1,
    k: int = 5,
    n_repeats: int = 5,
    seed: int = 42,
    n_boot: int = 2000,
) -> DataFrame:
    """One result row per ``(cell, feature_set, arm)``.

    Scores are averaged over repeats per recording and scored once, at recording
    and at participant grain, each with a bootstrap interval of its own units.
    """
    cell, arms = list(cell), list(arms)
    every = sorted({f for fs in feature_sets.values() for f in fs})
    keep = [*cell, "recording_id", "subject_id", "folder_path", "corpus", "label"]
    # Dealt once, one row per recording with all its folds; no recording is multiplied.
    dealt = materialise(X.deal_folds(df.select(*dict.fromkeys([*keep, *every])), arms, k, n_repeats, seed, cell))
    scores = materialise(out_of_fold_means(dealt, arms, feature_sets, every, cell, n_repeats))
    told = [(arm, name) for arm in arms for name in feature_sets]
    by = [*cell, "feature_set", "arm"]
    # Conflicting labels stop the query, as in to_participants.
    message = F.concat(F.lit("participant with more than one label: "), F.col("subject_id").cast("string"))
    label = F.when(F.col("_lo") == F.col("_hi"), F.col("_hi")).otherwise(F.raise_error(message).cast("int"))
    mean = F.array(*[F.round(F.avg(F.col("scores")[i]), PLACES) for i in range(len(told))])
    people = scores.groupBy(*cell, "subject_id").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), mean.alias("scores"))
    people = materialise(people.select(*cell, "subject_id", label.alias("label"), "scores"))
    leaks = X.leakage_of_dealt(dealt, arms, n_repeats, cell).groupBy(*cell, "arm").agg(
        F.avg("n_leaked_participants").alias("leaked_per_fold")
    )
    part = _grain(people, told, by, "subject_id", "auroc_participant", "", "n_participants", n_boot, seed)
    rec = _grain(scores, told, by, "recording_id", "auroc_recording", "rec_", "n_recordings", n_boot, seed)
    return part.join(rec, by).join(leaks, [*cell, "arm"])


class _Slots:
    """Places of the models ``cell, arm, repeat, fold`` in arrays.

    Folds of corpora are those of every repeat, so their models are kept once.
    """

    def __init__(self, dealt: DataFrame, arms: Sequence[str], cell: Sequence[str], n_repeats: int):
        self.arms, self.n_repeats = list(arms), n_repeats
        widest = [F.max(F.array_max(f"_own_{a}")) for a in arms]
        # One row per cell of the design.
        rows = dealt.groupBy(*cell).agg(*[w.alias(f"_{i}") for i, w in enumerate(widest)]).collect()
        self.cells = {tuple(r[: len(cell)]): i for i, r in enumerate(rows)}
        self.width = [1 + max((r[len(cell) + i] for r in rows), default=-1) for i in range(len(arms))]
        self.columns, at = [], 0
        for arm, width in zip(self.arms, self.width):
            for r in range(1 if X.ARMS[arm] == "corpus" else n_repeats):
                self.columns.append((arm, r, at))
                at += width
        self.per_cell = at
        self.size = at * len(self.cells)

    def of(self, columns: list[pa.Array], n: int) -> np.ndarray:
        """Cells of a batch, as the place of their first model."""
        if not columns:
            return np.zeros(n, np.int64)
        codes = [c.dictionary_encode() for c in columns]
        values = [c.dictionary.to_pylist() for c in codes]
        wide = np.zeros(n, np.int64)
        for c, v in zip(codes, values):
            wide = wide * len(v) + c.indices.to_numpy(zero_copy_only=False)
        found, back = np.unique(wide, return_inverse=True)
        place = np.zeros(len(found), np.int64)
        for i, code in enumerate(found):
            key = []
            for v in reversed(values):
                code, j = divmod(int(code), len(v))
                key.insert(0, v[j])
            place[i] = self.cells[tuple(key)] * self.per_cell
        return place[back]

    def rows(self) -> list[tuple]:
        """``cell, arm, repeat, fold`` of every place, in order."""
        out = []
        for at in sorted(self.cells, key=self.cells.get):
            for arm, r, _ in self.columns:
                out += [(*at, arm, r, f) for f in range(self.width[self.arms.index(arm)])]
        return out


def held_out_arrays(dealt: DataFrame, slots: _Slots, features: Sequence[str], cell: Sequence[str]) -> L.Models:
    """Models of all places: class totals of a task are added in arrays, rows stay where they are."""
    centre = np.array([v if v is not None else 0.0 for v in dealt.agg(*[F.avg(f) for f in features]).first()], dtype=float)
    width, n_cell = 1 + 3 * len(features), len(cell)

    def totals(b: pa.RecordBatch) -> np.ndarray:
        start, y, x, missing, own = _columns(b, n_cell, len(features))
        gap = np.where(missing, 0.0, x - centre)
        moments = np.concatenate([np.ones((1, len(x))), (~missing).T, gap.T, (gap * gap).T])
        # Rows of neither class hold a fold open and belong to no model.
        side = np.where(y == 1, 1, np.where(y == 0, 0, 2))
        out = np.zeros((width, slots.size * 3))
        first = slots.of(start, len(x))
        for arm, r, at in slots.columns:
            place = (first + at + own[arm][:, r]) * 3 + side
            for total, m in zip(out, moments):
                total += np.bincount(place, m, slots.size * 3)
        return out.reshape(-1)

    rows = dealt.select(*_inputs(slots, features, cell))
    n, *rest = summed(rows, totals, width * slots.size * 3).reshape(width, slots.size, 3)
    n = n.round()
    known, sums, squares = (np.array(rest[i * len(features):(i + 1) * len(features)]) for i in range(3))
    with np.errstate(divide="ignore", invalid="ignore"):
        mean = np.where(known > 0, sums / known, 0.0)
        spread = np.where(known > 0, np.maximum(squares / known - mean * mean, 0.0) * n, 0.0)
        mean = np.where(known > 0, centre[:, None, None] + mean, 0.0)
    per_fold = []
    for i, key in enumerate(slots.rows()):
        if n[i].sum():
            sides = [[float(n[i, y]), *[float(v) for j in range(len(features)) for v in (mean[j, i, y], spread[j, i, y])]] for y in (0, 1)]
            per_fold.append((*key, *sides[0], *sides[1]))
    names = [f"{c} double" for y in (0, 1) for c in [f"n{y}", *[f"{m}{y}_{f}" for f in features for m in ("m", "q")]]]
    kinds = dict(dealt.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in cell], "arm string, repeat int, fold bigint", *names])
    keys = [*cell, "arm", "repeat"]
    found = {
        (*[m[c] for c in [*keys, "fold"]],): m
        for m in S.held_out_models(dealt.sparkSession.createDataFrame(per_fold, schema), keys, features).collect()
    }
    empty = dict.fromkeys(["_prior", *[f"_{f}_{p}{y}" for f in features for p in "mvl" for y in (0, 1)]])
    return L.Models.of_rows([found.get(key, empty) for key in slots.rows()], features)


def _inputs(slots: _Slots, features: Sequence[str], cell: Sequence[str]) -> list:
    return [*cell, "label", *[F.col(f).cast("double").alias(f) for f in features], *[f"_own_{a}" for a in slots.arms]]


def _columns(b: pa.RecordBatch, n_cell: int, n_features: int):
    """Cells, labels, features, where they are missing and folds of a batch of :func:`_inputs`."""
    x = b.columns[n_cell + 1:n_cell + 1 + n_features]
    values = np.stack([c.to_numpy(zero_copy_only=False) for c in x], axis=1)
    missing = np.stack([c.is_null().to_numpy(zero_copy_only=False) for c in x], axis=1)
    arms = [n[len("_own_"):] for n in b.schema.names if n.startswith("_own_")]
    own = {a: matrix(b.column(f"_own_{a}"), np.int64) for a in arms}
    return b.columns[:n_cell], b.column(n_cell).to_numpy(zero_copy_only=False), values, missing, own


def out_of_fold_means(
    dealt: DataFrame, arms: Sequence[str], feature_sets: dict[str, Sequence[str]], every: Sequence[str], cell: Sequence[str], n_repeats: int,
) -> DataFrame:
    """``cell, recording_id, subject_id, label, scores``: means over the repeats, per arm and feature set.

    All folds of a recording are in its row, so its scores are means within the row. The
    models, one per cell, arm, repeat and fold, are sent to every task.
    """
    slots = _Slots(dealt, arms, cell, n_repeats)
    models = dealt.sparkSession.sparkContext.broadcast(held_out_arrays(dealt, slots, every, cell))
    sets = [[every.index(f) for f in fs] for fs in feature_sets.values()]
    told, n_cell, extra = [(a, fs) for a in arms for fs in sets], len(cell), ["recording_id", "subject_id"]

    def scored(batches):
        m = models.value
        for b in batches:
            if not b.num_rows:
                continue
            start, _, x, missing, own = _columns(b.select(b.schema.names[len(extra):]), n_cell, len(every))
            first, out = slots.of(start, len(x)), []
            for arm in arms:
                total, n = np.zeros((2, len(sets), len(x)))
                for _, r, at in (c for c in slots.columns if c[0] == arm):
                    place = first + at + own[arm][:, r]
                    known = ~np.isnan(m.prior[place])
                    terms = [_odds_of(m, place, x, j) for j in range(len(every))]
                    for i, fs in enumerate(sets):
                        odds = m.prior[place]
                        for j in fs:
                            odds = odds + terms[j]
                        ok = known & ~missing[:, fs].any(axis=1)
                        total[i] += np.where(ok, odds, 0.0)
                        n[i] += ok
                out.append((total, n))
            total, n = (np.concatenate(side).T.reshape(-1) for side in zip(*out))
            with np.errstate(invalid="ignore"):
                flat = pa.array(total / n, pa.float64(), mask=n == 0)
            ends = pa.array(np.arange(0, len(flat) + 1, len(told)), pa.int32())
            names = [*cell, *extra, "label", "scores"]
            columns = [*start, b.column(0), b.column(1), b.column("label"), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kinds = dict(dealt.dtypes)
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in [*cell, *extra, "label"]], "scores array<double>"])
    # A recording has one row: another stops the query.
    rows = dealt.groupBy(*cell, *extra, "label").agg(F.count(F.lit(1)).alias("_scored"))
    _complete(rows, 1).agg(F.max("label")).collect()
    return dealt.select(*extra, *_inputs(slots, every, cell)).mapInArrow(scored, schema)


def _odds_of(m: L.Models, place: np.ndarray, x: np.ndarray, j: int) -> np.ndarray:
    """What feature ``j`` adds to the log odds of each row under the model at its place."""
    out = 0.0
    for y, sign in ((1, -1.0), (0, 1.0)):
        gap = x[:, j] - m.mean[place, y, j]
        out = out + sign * (m.log_var[place, y, j] + gap * gap / m.var[place, y, j]) / 2
    return out


def _complete(oof: DataFrame, n_repeats: int) -> DataFrame:
    """Stops the query unless every recording was scored exactly once in every repeat."""
    message = F.concat(F.lit("recording "), F.col("recording_id").cast("string"), F.lit(" was not scored once in every repeat"))
    label = F.when(F.col("_scored") == n_repeats, F.col("label")).otherwise(F.raise_error(message).cast(dict(oof.dtypes)["label"]))
    return oof.withColumn("label", label).drop("_scored")


def _grain(rows: DataFrame, told: Sequence[tuple[str, str]], by: Sequence[str], unit: str, point: str, prefix: str, n: str, n_boot: int, seed: int) -> DataFrame:
    """AUROC of one grain, with its interval unless ``n_boot`` is 0.

    ``rows`` hold the scores of ``told``, pairs of arm and feature set, in one array.
    """
    cell = [c for c in by if c not in ("feature_set", "arm")]
    if n_boot:
        each = [F.struct(F.lit(s).alias("feature_set"), F.lit(a).alias("arm"), F.round(F.col("scores")[i], PLACES).alias("score")) for i, (a, s) in enumerate(told)]
        long = rows.select(*cell, unit, "label", F.inline(F.array(*each)))
        ci = R.bootstrap_ci(long, by, unit, n_boot, seed=seed)
        return ci.select(
            *by, F.col("auroc").alias(point), F.col("ci_lo").alias(f"{prefix}ci_lo"), F.col("ci_hi").alias(f"{prefix}ci_hi"), F.col("n").alias(n)
        )
    # One row per cell of the design.
    cells = [tuple(r) for r in rows.select(*cell).distinct().collect()] if cell else [()]
    place = {c: i for i, c in enumerate(cells)}

    def scored(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        score = np.round(matrix(b.column(0)), PLACES)
        at = np.array([place[key] for key in zip(*[c.to_pylist() for c in b.columns[2:]])] if cell else [0] * len(score), dtype=int)
        out = np.full((len(cells), len(told), len(score)), np.nan)
        out[at, :, np.arange(len(score))] = score
        return out.reshape(-1, len(score)), b.column(1).to_numpy(zero_copy_only=False)

    a = L.auroc_of_selections(rows.select("scores", "label", *cell), len(cells) * len(told), scored)
    kinds = dict(rows.dtypes)
    names = [(i * len(told) + j, *c, s, arm) for c, i in place.items() for j, (arm, s) in enumerate(told)]
    schema = ", ".join(["sel int", *[f"`{c}` {kinds[c]}" for c in cell], "feature_set string, arm string"])
    a = a.join(F.broadcast(rows.sparkSession.createDataFrame(names, schema)), "sel")
    return a.select(*by, F.col("auroc").alias(point), (F.col("n_pos") + F.col("n_neg")).alias(n))


def run_grid(
    df: DataFrame,
    cells: Sequence[tuple[str, str, str]],
    feature_sets: dict[str, Sequence[str]],
    arms: Sequence[str],
    **kw,
) -> DataFrame:
    """Every ``(task, feature_set, cohort)`` cell across every arm as one plan.

    ``df`` carries the cohort flags ``cohort_<name>``. Cells of one task and cohort
    share their folds.
    """
    cohorts = sorted({c for _, _, c in cells})
    tagged = df.withColumn(
        "cohort", F.explode(F.array_compact(F.array(*[F.when(F.col(f"cohort_{c}"), F.lit(c)) for c in cohorts])))
    )
    pairs = sorted({(t, c) for t, _, c in cells})
    tagged = tagged.where(F.concat_ws("|", "task", "cohort").isin([f"{t}|{c}" for t, c in pairs]))
    used = {n: feature_sets[n] for n in sorted({f for _, f, _ in cells})}
    grid = run_arms(tagged, arms, used, ["task", "cohort"], len(pairs), **kw)
    listed = [f"{t}|{f}|{c}" for t, f, c in cells]
    return grid.where(F.concat_ws("|", "task", "feature_set", "cohort").isin(listed))


def pivot_arms(grid: DataFrame, arms: Sequence[str], value: str = "auroc_participant") -> DataFrame:
    return grid.groupBy("task", "feature_set", "cohort").pivot("arm", list(arms)).agg(F.max(value))


def optimism(df: DataFrame, arms: Sequence[str], features: Sequence[str], k: int = 5, n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """``arm, repeat, fold, side, auroc``: training against held-out AUROC per fold."""
    packed = kept_folds(df.select(*dict.fromkeys([*KEYS, *features])), arms, k, n_repeats, seed)
    folds = unpack_folds(packed, "label", *features)
    keys = ["arm", "repeat"]
    found = S.held_out_models(S.class_moments(folds, [*keys, "fold"], features), keys, features)
    told = sorted(found.collect(), key=lambda m: (m["arm"], m["repeat"], m["fold"]))  # arms times repeats times folds
    models = L.Models.of_rows(told, features)
    # A recording's folds, put in the order of arms and repeats.
    own = F.transform(F.array_sort("_folds"), lambda x: x["fold"].cast("int"))
    place = {pair: i for i, pair in enumerate((arm, r) for arm in sorted(arms) for r in range(n_repeats))}
    at = [place[m["arm"], m["repeat"]] for m in told]

    def scored(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        odds = models.log_odds(matrix(b.column(1)))
        test = matrix(b.column(0), np.int64)[:, at].T == np.array([m["fold"] for m in told])[:, None]
        return np.concatenate([np.where(test, np.nan, odds), np.where(test, odds, np.nan)]), b.column(2).to_numpy(zero_copy_only=False)

    rows = packed.select(own.alias("own"), F.array(*[F.col(f).cast("double") for f in features]).alias("x"), "label")
    sides = [(i + s * len(told), m["arm"], m["repeat"], m["fold"], side) for s, side in enumerate(("train", "test")) for i, m in enumerate(told)]
    names = df.sparkSession.createDataFrame(sides, "sel int, arm string, repeat int, fold bigint, side string")
    a = L.auroc_of_selections(rows, len(sides), scored).join(F.broadcast(names), "sel")
    return a.select(*keys, "fold", "side", "auroc")


def arm_summary(per_fold: DataFrame) -> DataFrame:
    """Mean training AUROC and the spread of held-out AUROC per arm."""
    side = lambda s: F.when(F.col("side") == s, F.col("auroc"))
    return per_fold.groupBy("arm").agg(
        F.avg(side("train")).alias("train_auroc_mean"), F.avg(side("test")).alias("test_auroc_mean"),
        F.stddev_samp(side("test")).alias("test_auroc_fold_sd"),
    )


def participant_scores(df: DataFrame, arms: Sequence[str], features: Sequence[str], k: int = 5, n_repeats: int = 5, seed: int = 42, cell: Sequence[str] = (), n_cells: int = 1) -> DataFrame:
    """``cell, arm, subject_id, label, score``: out-of-fold means per participant."""
    folds = unpack_folds(kept_folds(df.select(*dict.fromkeys([*cell, *KEYS, *features])), arms, k, n_repeats, seed, cell))
    scored = score_out_of_fold(folds, features, cell, _n_models(n_cells, arms, k, n_repeats))
    oof = scored.groupBy(*cell, "arm", "recording_id", "subject_id", "label").agg(F.avg("score").alias("score"))
    # compared, resampled and scored by the callers
    return materialise(to_participants(oof, [*cell, "arm"]))


def leakage_effect(people: DataFrame, cell: Sequence[str], reference: str = "C_subject_key", n_boot: int = 2000, seed: int = 42) -> DataFrame:
    """Paired difference of every arm against the reference arm, same participants."""
    cell = list(cell)
    ref = people.where(F.col("arm") == reference).select(*cell, "subject_id", F.col("score").alias("reference_score"))
    both = people.where(F.col("arm") != reference).join(ref, [*cell, "subject_id"])
    out = R.paired_delta(both, [*cell, "arm"], "score", "reference_score", n_boot=n_boot, seed=seed)
    return out.withColumn("vs", F.lit(reference))


def permutation_null(
    df: DataFrame, arms: Sequence[str], features: Sequence[str], n_perm: int, k: int = 5, seed: int = 42
) -> DataFrame:
    """``arm, perm, auroc``: refit under shuffled participant labels; perm -1 is observed.

    Fold, label and score depend on a recording only through its participant and
    fold, so recordings are reduced to moments per (arm, participant, fold) once.
    """
    folds = assign_folds(df.select(*dict.fromkeys([*KEYS, *features])), arms, k, 1, seed)
    base = materialise(S.moments(folds.where("subject_id IS NOT NULL"), ["arm", "subject_id", "fold", "label"], features))
    subjects = to_participants(base.where(F.col("arm") == arms[0]).withColumn("score", F.lit(0.0)))
    n_pos = subjects.agg(F.sum("label")).first()[0] or 0
    keys = ["arm", "fold"]
    per_fold = S.merge(base, keys, features, "label", len(arms) * k)
    models = S.held_out_models(per_fold, ["arm"], features)
    scored = S.attach(base, models, keys, len(arms) * k, len(features))
    people = scored.groupBy("arm", "subject_id", "label").agg(
        F.round(F.sum(S.summed_log_odds(features)) / F.sum("n"), PLACES).alias("score")
    )
    observed = auroc(people, ["arm"], fanout=len(arms)).select("arm", F.lit(-1).alias("perm"), "auroc")
    null = P.permutation_null(base, arms, features, n_pos, n_perm, k, seed, D.unit_key(base, "subject_id"))
    # arms times permutations rows, read twice by the summary
    return materialise(null.unionByName(observed))


def learning_curve(
    df: DataFrame, features: Sequence[str], fractions: Sequence[float] = (0.4, 0.55, 0.7, 0.85, 1.0),
    k: int = 5, n_repeats: int = 3, seed: int = 42,
) -> DataFrame:
    """``repeat, fold, fraction, n_train_participants, auroc_train, auroc_test``.

    Participants' moments give the class totals of every subset; recordings are scored by
    all models at once, exactly, and never multiplied by them.
    """
    dealt = pack_folds(df.select(*dict.fromkeys([*KEYS, *features])), ["C_subject_key"], k, n_repeats, seed)
    own = F.transform(F.array_sort(F.transform("_folds", lambda x: F.struct(x["repeat"], x["fold"]))), lambda x: x["fold"].cast("int"))
    df = materialise(dealt.select(D.unit_key(dealt, "subject_id").alias("unit"), own.alias("own"), "label", *features))
    people = materialise(S.moments(df, ["unit", "own", "label"], features))
    subsets = Subsets(people.select("unit", "own"), fractions, k, seed)
    centre = np.array(df.agg(*[F.avg(f) for f in features]).first(), dtype=float)
    n_sets, width = len(subsets.keys), 1 + 2 * len(features)

    def totals(b: pa.RecordBatch) -> np.ndarray:
        n = b.column(3).to_numpy()
        gap, q = matrix(b.column(4)) - centre, matrix(b.column(5))
        moments = np.concatenate([n[:, None], n[:, None] * gap, q + n[:, None] * gap * gap], axis=1)
        member = subsets.member(b.column(0).to_numpy(), matrix(b.column(1), np.int64))
        y = b.column(2).to_numpy() == 1
        return np.stack([(member & y).astype(float) @ moments, (member & ~y).astype(float) @ moments]).reshape(-1)

    packed = people.select(
        "unit", "own", "label", "n", F.array(*[f"m_{f}" for f in features]), F.array(*[f"q_{f}" for f in features])
    )
    train1, train0 = summed(packed, totals, 2 * n_sets * width).reshape(2, n_sets, width)
    models = L.Models.of_moments(train1, train0)

    def scored(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        own_np = matrix(b.column(1), np.int64)
        odds = models.log_odds(matrix(b.column(3)) - centre)
        test = np.stack([own_np[:, r] == f for r, f, *_ in subsets.keys])
        member = subsets.member(b.column(0).to_numpy(), own_np)
        sides = np.concatenate([np.where(member, odds, np.nan), np.where(test, odds, np.nan)])
        return sides, b.column(2).to_numpy(zero_copy_only=False)

    rows = df.select("unit", "own", "label", F.array(*[F.col(f).cast("double") for f in features]))
    found = L.auroc_of_selections(rows, 2 * n_sets, scored)
    told = [(i + s * n_sets, *key, name) for s, name in enumerate(("train", "test")) for i, key in enumerate(subsets.keys)]
    names = df.sparkSession.createDataFrame(
        told, "sel int, repeat int, fold bigint, fraction double, n_train_participants bigint, side string"
    )
    both = found.join(F.broadcast(names), "sel").where("auroc IS NOT NULL")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("auroc"))).alias(f"auroc_{s}")
    return both.groupBy("repeat", "fold", "fraction", "n_train_participants").agg(side("train"), side("test"))


def learning_curve_summary(curve: DataFrame) -> DataFrame:
    return curve.groupBy("fraction").agg(
        F.avg("auroc_test").alias("mean"), F.stddev_samp("auroc_test").alias("sd"), F.count(F.lit(1)).alias("n")
    )


def train_elsewhere(df: DataFrame, features: Sequence[str], corpus: str = "corpus", keys: Sequence[str] = ()) -> DataFrame:
    """Score every corpus with the model of all other corpora: one repeat of arm D."""
    folds = assign_folds(df, ["D_leave_one_corpus_out"], 0, 1, 0, keys)
    return score_out_of_fold(folds, features, keys, MAX_CORPORA)


def generalisation_gap(within: DataFrame, cross: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Within-corpus minus cross-corpus AUROC."""
    a = within.select(*keys, F.col("auroc").alias("within_corpus_auroc"))
    b = cross.select(*keys, F.col("auroc").alias("cross_corpus_auroc"))
    return a.join(b, list(keys)).withColumn(
        "generalization_gap", F.col("within_corpus_auroc") - F.col("cross_corpus_auroc")
    )


def batch_control(df: DataFrame, group: str, batch: int, features: Sequence[str], n_repeats: int = 5, seed: int = 42) -> DataFrame:
    """Participants of one group only; the target is their batch. Those in several are left out."""
    from ..operators.cohort import exclude_in_several

    rows = exclude_in_several(df.where(F.col("group") == group), "subject_id", "batch")
    rows = rows.withColumn("label", (F.col("batch") == batch).cast("int"))
    return participant_scores(rows, ["C_subject_key"], features, 5, n_repeats, seed)


def control_row(name: str, ci: DataFrame) -> DataFrame:
    """A metric in the one schema of the negative-control table."""
    return ci.select(
        F.lit(name).alias("control"), "auroc", "ci_lo", "ci_hi", F.col("n").cast("bigint").alias("n")
    )
