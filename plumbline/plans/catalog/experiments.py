"""Splits, metrics, resampling, calibration, tests and experiment drivers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ...functions.draws import PRIME, draw_sql
from ...operators import calibrate as Cal
from ...operators import cohort as C
from ...operators import metrics as M
from ...operators import regression as RG
from ...operators import resample as R
from ...operators import splits as X
from ...operators import stats as H
from ...session import materialise
from .. import experiment as E
from .. import oracle as SQL
from ..registry import query
from ..views import FEATURES, FT, MATCHED_BATCH, REC, feature_cohort, feature_table, r6, recordings, s6, table
from .audit import FULL, TASKS

N_BOOT = 2000
ABC = ["A_recording", "B_folder_path", "C_subject_key"]
ABCD = [*ABC, "D_leave_one_corpus_out"]
AR = ["arm", "repeat"]
SEED = 42

RC = f'{REC}, rc AS (SELECT * FROM rec WHERE {FULL})'
#: Participants of the cohort with the mean header value as their score.
PART = f"{RC}, part AS (SELECT corpus, subject_id, max(label) AS label, round(avg(header), 9) AS score FROM rc GROUP BY corpus, subject_id)"
#: Recordings with a probability-like score.
PROB = f"{RC}, prob AS (SELECT recording_id, subject_id, corpus, label, 1 / (1 + exp(-(header - 250000.0) / 120000.0)) AS p FROM rc)"


def cohort(spark, sf):
    return recordings(spark, sf).where(F.col("group").isin("case", "control"))


def slim(spark, sf):
    """Only what dealing folds needs."""
    return cohort(spark, sf).select(*E.KEYS)


def participants(spark, sf):
    return M.to_participants(cohort(spark, sf), ["corpus"], score="header")


def probabilities(spark, sf):
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("header") - 250000.0) / 120000.0))
    return cohort(spark, sf).select("recording_id", "subject_id", "corpus", "label", p.alias("p"))


def rounded(df, *names):
    return df.withColumns({n: r6(n) for n in names})


# -- splits ----------------------------------------------------------------------------


def _folds(name, arm):
    sql = f"WITH {RC}, {SQL.folds_sql([arm], 5, 5, SEED, 'rc')} SELECT recording_id, arm, repeat::INTEGER AS repeat, fold FROM folds"

    @query(name, sql)
    def run(spark, sf):
        return X.assign_folds(slim(spark, sf), [arm]).select("recording_id", "arm", "repeat", "fold")

    return run


_folds("x01_folds_by_recording", "A_recording")
_folds("x02_folds_by_folder", "B_folder_path")
_folds("x03_folds_by_participant", "C_subject_key")
_folds("x04_leave_one_corpus_out", "D_leave_one_corpus_out")

LEAK = f"""per AS (SELECT arm, repeat, subject_id, fold, count(*) AS n FROM folds GROUP BY ALL),
flag AS (SELECT *, (min(fold) OVER w <> max(fold) OVER w)::INTEGER AS l FROM per WINDOW w AS (PARTITION BY arm, repeat, subject_id)),
leak AS (SELECT arm, repeat, fold, sum(n)::BIGINT AS n_test_recordings, sum(l)::BIGINT AS n_leaked_participants, sum(n * l)::BIGINT AS n_leaked_recordings FROM flag GROUP BY ALL)"""


@query("x05_arm_registry", f"""
WITH {RC}, a AS (SELECT unnest(['A_recording','B_folder_path','C_subject_key','D_leave_one_corpus_out']) AS arm, unnest(['recording_id','folder_path','subject_id','corpus']) AS grouping)
SELECT arm, grouping, CASE grouping WHEN 'recording_id' THEN (SELECT count(DISTINCT recording_id) FROM rc) WHEN 'folder_path' THEN (SELECT count(DISTINCT folder_path) FROM rc)
 WHEN 'subject_id' THEN (SELECT count(DISTINCT subject_id) FROM rc) ELSE (SELECT count(DISTINCT corpus) FROM rc) END AS n_groups FROM a""")
def x05(spark, sf):
    """Each arm with its grouping column, checked against the table, and its group count."""
    rows = cohort(spark, sf)
    columns = {arm: X.grouping_column(rows, arm) or "recording_id" for arm in X.ARMS}
    counts = rows.agg(*[F.countDistinct(c).alias(a) for a, c in columns.items()]).unpivot([], list(columns), "arm", "n_groups")
    mapping = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    return counts.select("arm", mapping[F.col("arm")].alias("grouping"), "n_groups")


@query("x06_leakage_report", f"WITH {RC}, {SQL.folds_sql(ABCD, 5, 5, SEED, 'rc')}, {LEAK} SELECT arm, repeat::INTEGER AS repeat, fold, n_test_recordings, n_leaked_participants, n_leaked_recordings FROM leak")
def x06(spark, sf):
    return X.leakage_of_dealt(X.deal_folds(slim(spark, sf), ABCD), ABCD, 5)


@query("x07_leakage_rates", f"""WITH {RC}, {SQL.folds_sql(ABC, 5, 5, SEED, 'rc')}, {LEAK}
SELECT arm, count(*) AS folds, count(*) FILTER (n_leaked_participants > 0) AS folds_with_leakage, {s6('avg(n_leaked_participants)')} AS mean_leaked_participants,
 {s6('avg(n_leaked_recordings)')} AS mean_leaked_test_recordings, {s6('100.0 * sum(n_leaked_recordings) / sum(n_test_recordings)')} AS pct_test_recordings_leaked FROM leak GROUP BY arm""")
def x07(spark, sf):
    rates = X.check_contrast(X.leakage_rates(X.leakage_of_dealt(X.deal_folds(slim(spark, sf), ABC), ABC, 5)))
    return rounded(rates, "mean_leaked_participants", "mean_leaked_test_recordings", "pct_test_recordings_leaked")


FRACTIONS = [0.4, 0.55, 0.7, 0.85, 1.0]
SUBSETS = f"""people AS (SELECT DISTINCT repeat, subject_id, fold AS own FROM folds),
af AS (SELECT DISTINCT repeat, fold FROM folds),
tr AS (SELECT p.repeat, af.fold, subject_id, row_number() OVER (PARTITION BY p.repeat, af.fold ORDER BY {draw_sql(SEED, 'p.repeat', 'af.fold', 'subject_id')}, subject_id) AS i,
  count(*) OVER (PARTITION BY p.repeat, af.fold) AS n FROM people p JOIN af ON af.repeat = p.repeat AND af.fold <> p.own),
chosen AS (SELECT repeat, fold, fraction, least(n, greatest(4, round_even(fraction * n, 0)::BIGINT)) AS n_train_participants, subject_id
  FROM tr, (SELECT unnest([{', '.join(f'{f}::DOUBLE' for f in FRACTIONS)}]) AS fraction) WHERE i <= least(n, greatest(4, round_even(fraction * n, 0)::BIGINT)))"""


@query("x08_training_subsets", f"""WITH {RC}, {SQL.folds_sql(['C_subject_key'], 5, 3, SEED, 'rc')}, {SUBSETS}
SELECT repeat::INTEGER AS repeat, fold, fraction, n_train_participants, subject_id FROM chosen""")
def x08(spark, sf):
    return X.training_subsets(X.assign_folds(slim(spark, sf), ["C_subject_key"], n_repeats=3), FRACTIONS)


# -- metrics -----------------------------------------------------------------------------


@query("a14_participant_aggregation", f"WITH {PART} SELECT corpus, subject_id, label, {s6('score')} AS score FROM part")
def a14(spark, sf):
    return rounded(participants(spark, sf), "score")


@query("a15_participant_covariates", f"""
WITH {RC} SELECT subject_id, max(label) AS label, {s6('avg(header)')} AS score, max(age) AS age, max(sex) AS sex FROM rc GROUP BY subject_id""")
def a15(spark, sf):
    """Covariates must be constant per participant; the extremes are compared."""
    agg = cohort(spark, sf).groupBy("subject_id").agg(
        F.max("label").alias("label"), F.avg("header").alias("score"),
        *[f(c).alias(f"{n}_{c}") for c in ("age", "sex") for n, f in (("lo", F.min), ("hi", F.max))],
    )
    same = lambda c: F.when(F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}")), F.col(f"hi_{c}")).otherwise(
        F.raise_error(F.lit(f"{c} differs within a participant")).cast(dict(agg.dtypes)[f"hi_{c}"])
    )
    return agg.select("subject_id", "label", r6("score").alias("score"), same("age").alias("age"), same("sex").alias("sex"))


@query("a16_header_rollup", f"WITH {RC} SELECT subject_id, max(label) AS label, max(header) AS header FROM rc GROUP BY subject_id")
def a16(spark, sf):
    return cohort(spark, sf).groupBy("subject_id").agg(F.max("label").alias("label"), F.max("header").alias("header"))


@query("m01_auroc", f"""
WITH {RC}, src AS (SELECT corpus, task, label, round(header / 5000) AS score FROM rc), {SQL.auroc_sql('src', ['corpus', 'task'], 'a')}
SELECT corpus, task, n_pos, n_neg, {s6('auroc')} AS auroc FROM a""")
def m01(spark, sf):
    rows = cohort(spark, sf).select("corpus", "task", "label", F.round(F.col("header") / 5000).alias("score"))
    return rounded(M.auroc(rows, ["corpus", "task"]), "auroc")


UNPIVOT = "UNPIVOT (SELECT {keys}, label, " + ", ".join(FEATURES) + " FROM {src}) ON " + ", ".join(FEATURES) + " INTO NAME feature VALUE score"
SCREEN_SRC = f"""ck AS (SELECT 'full' AS cohort, * FROM fc UNION ALL SELECT 'batch_matched', * FROM fc WHERE batch = {MATCHED_BATCH}),
long AS ({UNPIVOT.format(keys='cohort, task', src='ck')}), {SQL.auroc_sql('long', ['cohort', 'task', 'feature'], 'a')}"""


def screened(spark, sf):
    fc = feature_cohort(spark, sf)
    flags = F.array_compact(F.array(F.lit("full"), F.when(F.col("batch") == MATCHED_BATCH, F.lit("batch_matched"))))
    return M.univariate_screen(fc.withColumn("cohort", F.explode(flags)), ["cohort", "task"], FEATURES)


@query("m02_univariate_screen", f"WITH {FT}, {SCREEN_SRC} SELECT cohort, task, feature, {s6('greatest(auroc, 1 - auroc)')} AS auroc FROM a")
def m02(spark, sf):
    return rounded(screened(spark, sf), "auroc")


@query("m03_strong_features", f"""WITH {FT}, {SCREEN_SRC}
SELECT task, count(*) FILTER (cohort = 'full' AND greatest(auroc, 1 - auroc) > 0.52) AS "full",
 count(*) FILTER (cohort = 'batch_matched' AND greatest(auroc, 1 - auroc) > 0.52) AS batch_matched FROM a GROUP BY task""")
def m03(spark, sf):
    """The threshold is a parameter; these labels carry no signal, so it is low."""
    s = screened(spark, sf)
    return s.groupBy("task").pivot("cohort", ["full", "batch_matched"]).agg(F.count_if(F.col("auroc") > 0.52)).na.fill(0)


@query("m04_metadata_only_auroc", f"""
WITH {REC}, p AS (SELECT corpus, subject_id, max(label) AS label, max(header) AS score FROM rec GROUP BY ALL),
r AS (SELECT corpus, label, header AS score FROM rec), {SQL.auroc_sql('p', ['corpus'], 'ap')}, {SQL.auroc_sql('r', ['corpus'], 'ar')}
SELECT 'participant' AS grain, corpus, n_pos, n_neg, {s6('auroc')} AS auroc FROM ap UNION ALL SELECT 'recording', corpus, n_pos, n_neg, {s6('auroc')} FROM ar""")
def m04(spark, sf):
    rec = recordings(spark, sf)
    people = rec.groupBy("corpus", "subject_id").agg(F.max("label").alias("label"), F.max("header").alias("score"))
    rows = people.select(F.lit("participant").alias("grain"), "corpus", "label", "score").unionByName(
        rec.select(F.lit("recording").alias("grain"), "corpus", "label", F.col("header").alias("score"))
    )
    return rounded(M.auroc(rows, ["grain", "corpus"]), "auroc")


BEST = f"""ps AS (SELECT corpus, subject_id, max(label) AS label, {', '.join(f'round(avg({f}), 9) AS {f}' for f in FEATURES)} FROM fc GROUP BY ALL),
long AS ({UNPIVOT.format(keys='corpus', src='ps')}), {SQL.auroc_sql('long', ['corpus', 'feature'], 'a')}"""


@query("m05_best_control", f"""WITH {FT}, {BEST}
SELECT corpus, {s6('greatest(0.5, max(greatest(auroc, 1 - auroc)))')} AS best_auroc, arg_max(feature, greatest(auroc, 1 - auroc)) AS best_feature FROM a GROUP BY corpus""")
def m05(spark, sf):
    return rounded(M.best_control(feature_cohort(spark, sf), "corpus", FEATURES), "best_auroc")


@query("m06_roc_points", f"""WITH {PART}, s AS (SELECT corpus, round(score / 2000) AS threshold, sum(label) AS p, sum(1 - label) AS n FROM part GROUP BY ALL)
SELECT corpus, threshold, {s6('sum(n) OVER w / sum(n) OVER t')} AS fpr, {s6('sum(p) OVER w / sum(p) OVER t')} AS tpr FROM s
WINDOW w AS (PARTITION BY corpus ORDER BY threshold DESC), t AS (PARTITION BY corpus)""")
def m06(spark, sf):
    part = participants(spark, sf).withColumn("score", F.round(F.col("score") / 2000))
    return rounded(M.roc_points(part, ["corpus"]), "fpr", "tpr")


CI_OUT = f"{s6('auroc')} AS auroc, {s6('ci_lo')} AS ci_lo, {s6('ci_hi')} AS ci_hi, n"


@query("m07_bootstrap_ci", f"WITH {PART}, {SQL.ci_sql('part', ['corpus'], 'subject_id', N_BOOT, SEED, 'b')} SELECT corpus, {CI_OUT} FROM b")
def m07(spark, sf):
    return rounded(R.bootstrap_ci(participants(spark, sf), ["corpus"], n_boot=N_BOOT), "auroc", "ci_lo", "ci_hi")


#: The same tree of halves: 64 draws a leaf at most on average, one random bit per draw and level.
TREE_SQL = f"""ix AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY score, subject_id) AS i FROM part),
node AS (
  SELECT corpus, count(*) AS n, ceil(log2(greatest(count(*), 64) / 64.0::DOUBLE))::BIGINT AS depth, draw, 0::BIGINT AS lvl, 0::BIGINT AS idx, count(*) AS c
  FROM part, (SELECT unnest(range({N_BOOT})) AS draw) GROUP BY corpus, draw
  UNION ALL SELECT corpus, n, depth, draw, lvl + 1, 2 * idx + side, CASE side WHEN 0 THEN lft ELSE c - lft END
  FROM (SELECT *, coalesce(list_sum(list_transform(range((c + 31) // 32), lambda j: bit_count({draw_sql(SEED, 'draw', '(1 << lvl) + idx', 'j')} & ((1::BIGINT << least(c - 32 * j, 32)) - 1)))), 0)::BIGINT AS lft
    FROM node WHERE lvl < depth), (SELECT unnest(range(2)) AS side)),
slot AS (SELECT corpus, n, depth, draw, idx, unnest(range(c)) AS j FROM node WHERE lvl = depth),
pick AS (SELECT corpus, draw, least(floor((idx + ({draw_sql(SEED + 1, 'draw', '(1 << depth) + idx', 'j')} + 0.5::DOUBLE) / {PRIME}::DOUBLE) / (1 << depth) * n)::BIGINT, n - 1) + 1 AS i, count(*) AS w FROM slot GROUP BY ALL)"""


@query("m07_bootstrap_ci_multinomial", f"""WITH RECURSIVE {PART}, {TREE_SQL},
bs AS (SELECT pick.corpus, draw, score, sum(w * label) AS p, sum(w * (1 - label)) AS q FROM pick JOIN ix ON pick.corpus = ix.corpus AND pick.i = ix.i GROUP BY ALL),
bc AS (SELECT corpus, draw, p, q, sum(q) OVER (PARTITION BY corpus, draw ORDER BY score) - q AS below FROM bs),
bd AS (SELECT corpus, draw, sum(p * (below + q / 2.0::DOUBLE)) / nullif(sum(p) * sum(q), 0)::DOUBLE AS auroc FROM bc GROUP BY ALL),
band AS (SELECT corpus, quantile_cont(auroc, 0.025) AS ci_lo, quantile_cont(auroc, 0.975) AS ci_hi FROM bd WHERE auroc IS NOT NULL GROUP BY corpus),
{SQL.auroc_sql('part', ['corpus'], 'pt')}
SELECT corpus, {s6('auroc')} AS auroc, {s6('ci_lo')} AS ci_lo, {s6('ci_hi')} AS ci_hi, n_pos + n_neg AS n FROM pt JOIN band USING (corpus)""")
def m07m(spark, sf):
    ci = R.bootstrap_ci(participants(spark, sf), ["corpus"], n_boot=N_BOOT, method="multinomial")
    return rounded(ci, "auroc", "ci_lo", "ci_hi")


def delta_sql(src, keys, a, b, n_boot, name):
    """Oracle of a paired difference: both scores carry the same weights."""
    k = "".join(f"{x}, " for x in keys)
    d = lambda s: SQL.draws_sql(f"{name}_{s}", keys, "subject_id", n_boot, SEED, f"{name}_{s}d")
    return f"""{name}_a AS (SELECT {k}subject_id, label, {a} AS score FROM {src}), {name}_b AS (SELECT {k}subject_id, label, {b} AS score FROM {src}),
{d('a')}, {d('b')}, {SQL.auroc_sql(name + '_a', keys, name + '_pa')}, {SQL.auroc_sql(name + '_b', keys, name + '_pb')},
{name}_dl AS (SELECT {k}x.auroc - y.auroc AS d FROM {name}_ad x JOIN {name}_bd y USING ({k}draw) WHERE x.auroc IS NOT NULL AND y.auroc IS NOT NULL),
{name}_band AS (SELECT {k}quantile_cont(d, 0.025) AS ci_lo, quantile_cont(d, 0.975) AS ci_hi, least(1, 2 * least(avg((d <= 0)::INTEGER), avg((d >= 0)::INTEGER))) AS p FROM {name}_dl GROUP BY ALL),
{name} AS (SELECT {k}x.auroc - y.auroc AS delta, ci_lo, ci_hi, p FROM {name}_pa x JOIN {name}_pb y USING ({k[:-2]}) JOIN {name}_band USING ({k[:-2]}))"""


@query("m08_paired_delta", f"""WITH {FT}, ps AS (SELECT corpus, subject_id, max(label) AS label, round(avg(f_qty), 9) AS sa, round(avg(f_discount), 9) AS sb FROM fc GROUP BY ALL),
{delta_sql('ps', ['corpus'], 'sa', 'sb', N_BOOT, 'd')} SELECT corpus, {s6('delta')} AS delta, {s6('ci_lo')} AS ci_lo, {s6('ci_hi')} AS ci_hi, {s6('p')} AS p FROM d""")
def m08(spark, sf):
    ps = feature_cohort(spark, sf).groupBy("corpus", "subject_id").agg(
        F.max("label").alias("label"), F.round(F.avg("f_qty"), 9).alias("sa"), F.round(F.avg("f_discount"), 9).alias("sb")
    )
    return rounded(R.paired_delta(ps, ["corpus"], "sa", "sb", n_boot=N_BOOT), "delta", "ci_lo", "ci_hi", "p")


PERM_ARMS = ["C_subject_key", "A_recording"]
N_PERM = 500
LINES = FEATURES
#: Class totals per permutation, arm and fold from moments per participant and fold.
_SIDES = [f"sum(n) FILTER (y = {v}) AS n{v}, " + ", ".join(f"sum(s_{f}) FILTER (y = {v}) AS s{v}_{f}, sum(t_{f}) FILTER (y = {v}) AS t{v}_{f}" for f in LINES) for v in (0, 1)]
_SUMS = [f"{c}{v}{t}" for v in (0, 1) for c, t in [("n", ""), *[(x, f"_{f}") for f in LINES for x in ("s", "t")]]]


def _odds_of_sums():
    """Summed log odds of recordings given by count, sum and sum of squares."""
    total = "c.n * (ln(m.n1) - ln(m.n0))"
    for f in LINES:
        for v, sign in ((1, "-"), (0, "+")):
            mean, var = f"(m.s{v}_{f} / m.n{v})", f"(m.t{v}_{f} / m.n{v} - (m.s{v}_{f} / m.n{v}) * (m.s{v}_{f} / m.n{v}) + 1e-9::DOUBLE)"
            total += f" {sign} (c.n * ln({var}) + (c.t_{f} - 2 * {mean} * c.s_{f} + c.n * {mean} * {mean}) / {var}) / 2"
    return total


NULL_SQL = f"""{SQL.folds_sql(PERM_ARMS, 5, 1, SEED)},
subj AS (SELECT subject_id, max(label) AS label FROM fc GROUP BY subject_id),
pr AS (SELECT subject_id, perm, row_number() OVER (PARTITION BY perm ORDER BY {draw_sql(SEED, 'perm', 'subject_id')}, subject_id) AS r FROM subj, (SELECT unnest(range({N_PERM})) AS perm)),
labels AS (SELECT subject_id, perm, (r <= (SELECT sum(label) FROM subj))::INTEGER AS y FROM pr),
centre AS (SELECT {', '.join(f'avg({f}) AS c_{f}' for f in LINES)} FROM folds),
pm AS (SELECT arm, subject_id, fold, count(*)::DOUBLE AS n, {', '.join(f'sum({f} - c_{f}) AS s_{f}, sum(({f} - c_{f}) * ({f} - c_{f})) AS t_{f}' for f in LINES)} FROM folds, centre GROUP BY ALL),
cells AS (SELECT pm.*, perm, y FROM pm JOIN labels USING (subject_id)),
sides AS (SELECT arm, perm, fold, {', '.join(_SIDES)} FROM cells GROUP BY ALL),
trained AS (SELECT arm, perm, fold, {', '.join(f'sum({c}) OVER (PARTITION BY arm, perm) - {c} AS {c}' for c in _SUMS)} FROM sides),
pp AS (SELECT c.arm, c.perm, c.subject_id, max(c.y) AS label, floor(1024 * sum({_odds_of_sums()}) / sum(c.n)) AS score
  FROM cells c JOIN trained m ON c.arm = m.arm AND c.perm = m.perm AND c.fold = m.fold GROUP BY ALL),
{SQL.auroc_sql('pp', ['arm', 'perm'], 'null_a')}"""
OBSERVED_SQL = f"""{SQL.models_sql(LINES, ['arm'])}, {SQL.scored_sql(LINES, ['arm'])},
op AS (SELECT arm, subject_id, max(label) AS label, round(avg(score), 9) AS score FROM scored GROUP BY ALL), {SQL.auroc_sql('op', ['arm'], 'obs_a')}"""


@query("m09_permutation_test", f"""WITH {FT}, {NULL_SQL}, {OBSERVED_SQL}, obs AS (SELECT arm, auroc AS observed FROM obs_a)
SELECT arm, {s6('max(observed)')} AS observed, {s6('avg(auroc)')} AS null_mean, {s6('quantile_cont(auroc, 0.95)')} AS null_p95,
 {s6('quantile_cont(auroc, 0.025)')} AS null_lo, {s6('quantile_cont(auroc, 0.975)')} AS null_hi, {s6('(count(*) FILTER (auroc >= observed) + 1) / (count(*) + 1)')} AS p_value
FROM null_a JOIN obs USING (arm) GROUP BY arm""")
def m09(spark, sf):
    return rounded(permutation(spark, sf), "observed", "null_mean", "null_p95", "null_lo", "null_hi", "p_value")


def permutation(spark, sf):
    null = E.permutation_null(feature_cohort(spark, sf), PERM_ARMS, LINES, N_PERM)
    return R.permutation_summary(null.where("perm = -1"), null.where("perm >= 0"), ["arm"])


OOF = f"""{SQL.folds_sql(ABC, 5, 5, SEED)}, {SQL.models_sql(LINES, AR)}, {SQL.scored_sql(LINES, AR)},
oof AS (SELECT arm, recording_id, subject_id, label, avg(score) AS raw, round(avg(score), 9) AS score FROM scored GROUP BY ALL),
people AS (SELECT arm, subject_id, max(label) AS label, round(avg(raw), 9) AS score FROM oof GROUP BY ALL)"""


@query("m10_leakage_effect", f"""WITH {FT}, {OOF},
paired AS (SELECT o.arm, subject_id, o.label, o.score AS so, c.score AS sc FROM people o JOIN people c USING (subject_id) WHERE o.arm <> 'C_subject_key' AND c.arm = 'C_subject_key'),
{delta_sql('paired', ['arm'], 'so', 'sc', N_BOOT, 'd')} SELECT arm, {s6('delta')} AS delta, {s6('ci_lo')} AS ci_lo, {s6('ci_hi')} AS ci_hi, {s6('p')} AS p, 'C_subject_key' AS vs FROM d""")
def m10(spark, sf):
    people = E.participant_scores(feature_cohort(spark, sf), ABC, LINES)
    return rounded(E.leakage_effect(people, [], n_boot=N_BOOT), "delta", "ci_lo", "ci_hi", "p")


SIDES = f"""{SQL.folds_sql(['A_recording', 'C_subject_key'], 5, 5, SEED)}, {SQL.models_sql(LINES, AR)},
sides AS (SELECT f.arm, f.repeat, m.fold, f.label, CASE WHEN f.fold = m.fold THEN 'test' ELSE 'train' END AS side, {SQL.log_odds_sql(LINES)} AS score
  FROM folds f JOIN models m ON f.arm = m.arm AND f.repeat = m.repeat), {SQL.auroc_sql('sides', ['arm', 'repeat', 'fold', 'side'], 'pf')}"""


@query("m11_optimism", f"WITH {FT}, {SIDES} SELECT arm, repeat::INTEGER AS repeat, fold, side, {s6('auroc')} AS auroc FROM pf")
def m11(spark, sf):
    return rounded(E.optimism(feature_cohort(spark, sf), ["A_recording", "C_subject_key"], LINES), "auroc")


@query("m12_out_of_fold_auroc", f"""WITH {FT}, {OOF}, {SQL.auroc_sql('people', ['arm'], 'a')} SELECT arm, n_pos, n_neg, {s6('auroc')} AS auroc FROM a""")
def m12(spark, sf):
    return rounded(M.auroc(E.participant_scores(feature_cohort(spark, sf), ABC, LINES), ["arm"], fanout=15), "auroc")


D_ONE = f"""{SQL.folds_sql(['D_leave_one_corpus_out'], 1, 1, 0, name='dfolds')}, {SQL.models_sql(LINES, AR, 'dfolds', 'dmodels')}, {SQL.scored_sql(LINES, AR, 'dfolds', 'dmodels', 'dscored')},
dpeople AS (SELECT corpus, subject_id, max(label) AS label, round(avg(score), 9) AS score FROM dscored GROUP BY ALL), {SQL.auroc_sql('dpeople', ['corpus'], 'cross_a')}"""
W_ONE = f"""{SQL.folds_sql(['C_subject_key'], 5, 5, SEED, cell=['corpus'], name='wfolds')}, {SQL.models_sql(LINES, ['corpus', *AR], 'wfolds', 'wmodels')}, {SQL.scored_sql(LINES, ['corpus', *AR], 'wfolds', 'wmodels', 'wscored')},
woof AS (SELECT corpus, recording_id, subject_id, label, avg(score) AS score FROM wscored GROUP BY ALL),
wpeople AS (SELECT corpus, subject_id, max(label) AS label, round(avg(score), 9) AS score FROM woof GROUP BY ALL), {SQL.auroc_sql('wpeople', ['corpus'], 'within_a')}"""


def slim_features(spark, sf):
    """Made once for the queries that read it several times."""
    return materialise(feature_cohort(spark, sf).select(*E.KEYS, *LINES))


@query("m13_generalisation_gap", f"""WITH {FT}, {D_ONE}, {W_ONE}
SELECT corpus, {s6('w.auroc')} AS within_corpus_auroc, {s6('c.auroc')} AS cross_corpus_auroc, {s6('w.auroc - c.auroc')} AS generalization_gap FROM within_a w JOIN cross_a c USING (corpus)""")
def m13(spark, sf):
    fc = slim_features(spark, sf)
    within = M.auroc(E.participant_scores(fc, ["C_subject_key"], LINES, cell=["corpus"], n_cells=E.MAX_CORPORA), ["corpus"])
    cross = M.to_participants(E.train_elsewhere(fc, LINES), ["corpus"])
    gap = E.generalisation_gap(within, M.auroc(cross, ["corpus"]), ["corpus"])
    return rounded(gap, "within_corpus_auroc", "cross_corpus_auroc", "generalization_gap")


# -- calibration ---------------------------------------------------------------------------

EDGES = ", ".join(f"{e!r}::DOUBLE" for e in Cal.edges(10))
BINNED = f"{PROB}, binned AS (SELECT *, greatest(least(len(list_filter([{EDGES}], lambda e: e <= p)) - 1, 9), 0)::INTEGER AS bin FROM prob)"


@query("c01_reliability_curve", f"""WITH {BINNED}, g AS (SELECT bin, count(*) AS n, avg(label) AS o, avg(p) AS m FROM binned GROUP BY bin),
e AS (SELECT sum(n * abs(o - m)) / sum(n) AS ece FROM g)
SELECT b.bin::INTEGER AS bin, {s6('o')} AS observed, {s6('coalesce(m, (b.bin + 0.5) / 10)')} AS predicted, coalesce(n, 0)::BIGINT AS n, {s6('(SELECT ece FROM e)')} AS ece
FROM (SELECT unnest(range(10)) AS bin) b LEFT JOIN g USING (bin)""")
def c01(spark, sf):
    return rounded(Cal.reliability_curve(probabilities(spark, sf), "label", "p"), "observed", "predicted", "ece")


@query("c02_brier_decomposition", f"""WITH {BINNED}, g AS (SELECT corpus, bin, count(*) AS n, avg(label) AS o, avg(p) AS m FROM binned GROUP BY ALL),
t AS (SELECT corpus, avg(label) AS y, avg((p - label) * (p - label)) AS brier FROM binned GROUP BY corpus),
bb AS (SELECT corpus, avg((m - label) * (m - label)) AS brier_binned FROM binned JOIN g USING (corpus, bin) GROUP BY corpus)
SELECT corpus, {s6('max(brier)')} AS brier, {s6('max(brier_binned)')} AS brier_binned, {s6('sum(n * (m - o) * (m - o)) / sum(n)')} AS reliability,
 {s6('sum(n * (o - y) * (o - y)) / sum(n)')} AS resolution, {s6('max(y * (1 - y))')} AS uncertainty FROM g JOIN t USING (corpus) JOIN bb USING (corpus) GROUP BY corpus""")
def c02(spark, sf):
    out = Cal.brier_decomposition(probabilities(spark, sf), "label", "p", 10, ["corpus"])
    return rounded(out, "brier", "brier_binned", "reliability", "resolution", "uncertainty")


@query("c03_prior_correction", f"""WITH {PROB} SELECT recording_id, {s6("1 / (1 + exp(-(ln(p / (1 - p)) + ln(0.015 / 0.985) - ln((SELECT avg(label) FROM prob) / (1 - (SELECT avg(label) FROM prob))))))")} AS corrected FROM prob""")
def c03(spark, sf):
    prob = probabilities(spark, sf)
    prevalence = prob.agg(F.avg(F.col("label").cast("double"))).scalar()
    return prob.select("recording_id", r6(Cal.prior_correction(F.col("p"), prevalence)).alias("corrected"))


@query("c04_predictive_value", f"""WITH {PROB}, r AS (SELECT corpus, avg((p >= 0.5)::INTEGER) FILTER (label = 1) AS se, avg((p < 0.5)::INTEGER) FILTER (label = 0) AS sp FROM prob GROUP BY corpus)
SELECT corpus, {s6('se')} AS sensitivity, {s6('sp')} AS specificity, {s6('coalesce(se * 0.015 / nullif(se * 0.015 + (1 - sp) * 0.985, 0), 0)')} AS ppv FROM r""")
def c04(spark, sf):
    hit = (F.col("p") >= 0.5).cast("double")
    rates = probabilities(spark, sf).groupBy("corpus").agg(
        F.avg(F.when(F.col("label") == 1, hit)).alias("sensitivity"), F.avg(F.when(F.col("label") == 0, 1 - hit)).alias("specificity")
    )
    out = rates.withColumn("ppv", Cal.predictive_value(F.col("sensitivity"), F.col("specificity")))
    return rounded(out, "sensitivity", "specificity", "ppv")


THRESHOLDS = [float(t) for t in np.linspace(0.01, 0.99, 99)]


@query("c05_decision_curve", f"""WITH {PROB}, th AS (SELECT unnest([{', '.join(f'{t!r}::DOUBLE' for t in THRESHOLDS)}]) AS t),
n AS (SELECT count(*)::DOUBLE AS n, avg(label) AS prev FROM prob),
h AS (SELECT t, count(*) FILTER (p >= t AND label = 1) AS tp, count(*) FILTER (p >= t AND label = 0) AS fp FROM th, prob GROUP BY t)
SELECT {s6('t')} AS threshold, {s6('tp / n - fp / n * (t / (1 - t))')} AS net_benefit_model, {s6('prev - (1 - prev) * (t / (1 - t))')} AS net_benefit_all, 0.0::DOUBLE AS net_benefit_none FROM h, n""")
def c05(spark, sf):
    out = Cal.decision_curve(probabilities(spark, sf), "label", "p", THRESHOLDS)
    return rounded(out, "threshold", "net_benefit_model", "net_benefit_all")


# -- tests -----------------------------------------------------------------------------------


@query("h01_welch", f"""WITH {RC}, g AS (SELECT corpus, label, avg(header) AS m, var_samp(header) AS v, count(*) AS n FROM rc GROUP BY ALL),
w AS (SELECT a.corpus, a.m AS m1, b.m AS m2, a.v / a.n AS s1, b.v / b.n AS s2, a.n AS n1, b.n AS n2 FROM g a JOIN g b ON a.corpus = b.corpus AND a.label = 1 AND b.label = 0)
SELECT corpus, {s6('(m1 - m2) / sqrt(s1 + s2)')} AS t, {s6('(s1 + s2) * (s1 + s2) / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1))')} AS df FROM w""")
def h01(spark, sf):
    return rounded(H.welch(cohort(spark, sf), ["corpus"], "header", F.col("label") == 1, p_value=False), "t", "df")


@query("h01_welch_p")
def h01p(spark, sf):
    return rounded(H.welch(cohort(spark, sf), ["corpus"], "header", F.col("label") == 1), "t", "df", "p")


LOGP = "lgamma(rw + 1) + lgamma(n - rw + 1) + lgamma(cl + 1) + lgamma(n - cl + 1) - lgamma(n + 1) - lgamma({k} + 1) - lgamma(rw - {k} + 1) - lgamma(cl - {k} + 1) - lgamma(n - rw - cl + {k} + 1)"


@query("h02_fisher", f"""WITH j AS (SELECT lang, quality = 1 AS r, toxic = 1 AS t FROM labels JOIN documents USING (doc_id)),
f AS (SELECT lang, count(*) FILTER (r AND t) AS a, count(*) FILTER (r AND NOT t) AS b, count(*) FILTER (NOT r AND t) AS c, count(*) FILTER (NOT r AND NOT t) AS d FROM j GROUP BY lang),
g AS (SELECT *, a + b AS rw, a + c AS cl, a + b + c + d AS n FROM f),
k AS (SELECT *, unnest(range(greatest(0, rw + cl - n), least(rw, cl) + 1)) AS k FROM g)
SELECT lang, max(a) AS a, max(b) AS b, max(c) AS c, max(d) AS d, {s6(f"least(1, sum(CASE WHEN {LOGP.format(k='k')} <= {LOGP.format(k='a')} + 1e-7 THEN exp({LOGP.format(k='k')}) ELSE 0 END))")} AS p FROM k GROUP BY lang""")
def h02(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return rounded(H.fisher(rows, ["lang"], F.col("quality") == 1, F.col("toxic") == 1), "p")


@query("h03_mann_whitney", f"""WITH {RC}, s AS (SELECT task, label, round(header / 1000) AS v FROM rc),
r AS (SELECT task, label, v, rank() OVER (PARTITION BY task ORDER BY v) + (count(*) OVER (PARTITION BY task, v) - 1) / 2.0::DOUBLE AS r FROM s),
t AS (SELECT task, sum(c * c * c - c) AS tie FROM (SELECT task, v, count(*)::DOUBLE AS c FROM s GROUP BY ALL) GROUP BY task),
a AS (SELECT task, sum(r) FILTER (label = 1) AS r1, (count(*) FILTER (label = 1))::DOUBLE AS n1, (count(*) FILTER (label = 0))::DOUBLE AS n2 FROM r GROUP BY task),
u AS (SELECT task, r1 - n1 * (n1 + 1) / 2 AS u, n1, n2, tie FROM a JOIN t USING (task))
SELECT task, {s6('u')} AS u, {s6('(greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - tie / ((n1 + n2) * (n1 + n2 - 1))))')} AS z FROM u""")
def h03(spark, sf):
    rows = cohort(spark, sf).select("task", "label", F.round(F.col("header") / 1000).alias("v"))
    return rounded(H.mann_whitney(rows, ["task"], "v", F.col("label") == 1, p_value=False), "u", "z")


@query("h04_pearson", f"""WITH {FT} SELECT task, {s6('corr(header, f_price)')} AS r, NULL::DOUBLE AS r_constant FROM ft GROUP BY task""")
def h04(spark, sf):
    ft = feature_table(spark, sf).withColumn("one", F.lit(1.0))
    return ft.groupBy("task").agg(
        r6(H.correlation(F.col("header"), F.col("f_price"))).alias("r"), r6(H.correlation(F.col("header"), F.col("one"))).alias("r_constant")
    )


@query("h05_spearman", f"""WITH {FT}, p AS (SELECT corpus, subject_id, avg(header) AS score, max(f_lines) AS hy FROM fc GROUP BY ALL),
r AS (SELECT corpus, rank() OVER (PARTITION BY corpus ORDER BY score) + (count(*) OVER (PARTITION BY corpus, score) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY corpus ORDER BY hy) + (count(*) OVER (PARTITION BY corpus, hy) - 1) / 2.0::DOUBLE AS b FROM p)
SELECT corpus, count(*) AS n, {s6('corr(a, b)')} AS rho FROM r GROUP BY corpus""")
def h05(spark, sf):
    p = feature_cohort(spark, sf).groupBy("corpus", "subject_id").agg(F.avg("header").alias("score"), F.max("f_lines").alias("hy"))
    return rounded(H.spearman(p, ["corpus"], "hy", "score", p_value=False), "rho")


# -- experiment drivers ------------------------------------------------------------------------

SETS = {"header": ["header"], "lines": LINES}
CELLS = [(t, s, c) for t in TASKS for s in SETS for c in ("full", "batch_matched")]
TC = ["task", "cohort"]
GRID_KEYS = [*TC, "feature_set", "arm"]
GRID_SQL = f"""gb AS (SELECT 'full' AS cohort, * FROM fc UNION ALL SELECT 'batch_matched', * FROM fc WHERE batch = {MATCHED_BATCH}),
{SQL.folds_sql(ABCD, 5, 5, SEED, 'gb', TC)},
{SQL.models_sql(['header', *LINES], [*TC, *AR])},
gs AS (SELECT f.*, {SQL.log_odds_sql(['header'])} AS s_header, {SQL.log_odds_sql(LINES)} AS s_lines FROM folds f JOIN models m ON f.task = m.task AND f.cohort = m.cohort AND f.arm = m.arm AND f.repeat = m.repeat AND f.fold = m.fold),
go AS (SELECT task, cohort, arm, recording_id, subject_id, label, avg(s_header) AS sh, avg(s_lines) AS sl FROM gs GROUP BY ALL),
oof AS (SELECT task, cohort, arm, recording_id, subject_id, label, 'header' AS feature_set, sh AS raw, round(sh, 9) AS score FROM go UNION ALL SELECT task, cohort, arm, recording_id, subject_id, label, 'lines', sl, round(sl, 9) FROM go),
people AS (SELECT task, cohort, feature_set, arm, subject_id, max(label) AS label, round(avg(raw), 9) AS score FROM oof GROUP BY ALL)"""
GRID_LEAK = """gper AS (SELECT task, cohort, arm, repeat, subject_id, fold FROM folds GROUP BY ALL),
gflag AS (SELECT *, (min(fold) OVER w <> max(fold) OVER w)::INTEGER AS l FROM gper WINDOW w AS (PARTITION BY task, cohort, arm, repeat, subject_id)),
gleak AS (SELECT task, cohort, arm, avg(l) AS leaked_per_fold FROM (SELECT task, cohort, arm, repeat, fold, sum(l) AS l FROM gflag GROUP BY ALL) GROUP BY ALL)"""


def graded(spark, sf):
    return C.with_cohort_flags(feature_table(spark, sf), ["case", "control"], MATCHED_BATCH)


GRID_VALUES = ["auroc_participant", "ci_lo", "ci_hi", "auroc_recording", "rec_ci_lo", "rec_ci_hi", "leaked_per_fold"]


@query("e09_experiment_grid")
def e09(spark, sf):
    """Intervals of 2000 draws for every cell and arm are too much for the SQL check; ``e08`` has the same in SQL."""
    return rounded(E.run_grid(graded(spark, sf), CELLS, SETS, ABCD, n_boot=N_BOOT), *GRID_VALUES)


@query("e09_experiment_grid_points", f"""WITH {FT}, {GRID_SQL}, {GRID_LEAK}, {SQL.auroc_sql('people', GRID_KEYS, 'pa')}, {SQL.auroc_sql('oof', GRID_KEYS, 'oa')}
SELECT task, cohort, feature_set, arm, {s6('pa.auroc')} AS auroc_participant, pa.n_pos + pa.n_neg AS n_participants,
 {s6('oa.auroc')} AS auroc_recording, oa.n_pos + oa.n_neg AS n_recordings, {s6('leaked_per_fold')} AS leaked_per_fold
FROM pa JOIN oa USING (task, cohort, feature_set, arm) JOIN gleak USING (task, cohort, arm)""")
def e09_points(spark, sf):
    """The same grid without intervals."""
    points = E.run_grid(graded(spark, sf), CELLS, SETS, ABCD, n_boot=0)
    return rounded(points, "auroc_participant", "auroc_recording", "leaked_per_fold")


@query("a18_result_pivot", f"""WITH {FT}, {GRID_SQL}, {SQL.auroc_sql('people', GRID_KEYS, 'a')}
SELECT task, cohort, feature_set, {', '.join(f"{s6(f'max(auroc) FILTER (arm = {chr(39)}{a}{chr(39)})')} AS {chr(34)}{a}{chr(34)}" for a in ABCD)} FROM a GROUP BY ALL""")
def a18(spark, sf):
    return rounded(E.pivot_arms(E.run_grid(graded(spark, sf), CELLS, SETS, ABCD, n_boot=0), ABCD), *ABCD)


@query("e07_aggregate_scorer", f"""WITH {FT}, {SQL.folds_sql(['C_subject_key'], 5, 5, SEED)}, {SQL.models_sql(LINES, AR)}, {SQL.scored_sql(LINES, AR)}
SELECT recording_id, repeat::INTEGER AS repeat, fold, {s6('score')} AS score FROM scored""")
def e07(spark, sf):
    folds = X.assign_folds(feature_cohort(spark, sf).select(*E.KEYS, *LINES), ["C_subject_key"])
    return rounded(E.score_out_of_fold(folds, LINES, [], 25).select("recording_id", "repeat", "fold", "score"), "score")


@query("e08_run_arm", f"""WITH {FT}, {OOF}, {LEAK}, {SQL.ci_sql('people', ['arm'], 'subject_id', N_BOOT, SEED, 'pc')}, {SQL.ci_sql('oof', ['arm'], 'recording_id', N_BOOT, SEED, 'oc')},
lf AS (SELECT arm, avg(n_leaked_participants) AS leaked_per_fold FROM leak GROUP BY arm)
SELECT 'lines' AS feature_set, arm, {s6('pc.auroc')} AS auroc_participant, {s6('pc.ci_lo')} AS ci_lo, {s6('pc.ci_hi')} AS ci_hi, pc.n AS n_participants,
 {s6('oc.auroc')} AS auroc_recording, {s6('oc.ci_lo')} AS rec_ci_lo, {s6('oc.ci_hi')} AS rec_ci_hi, oc.n AS n_recordings, {s6('leaked_per_fold')} AS leaked_per_fold
FROM pc JOIN oc USING (arm) JOIN lf USING (arm)""")
def e08(spark, sf):
    return rounded(E.run_arms(feature_cohort(spark, sf), ABC, {"lines": LINES}, n_boot=N_BOOT), *GRID_VALUES)


@query("a19_arm_summary", f"""WITH {FT}, {SIDES} SELECT arm, {s6("avg(auroc) FILTER (side = 'train')")} AS train_auroc_mean, {s6("avg(auroc) FILTER (side = 'test')")} AS test_auroc_mean,
 {s6("stddev_samp(auroc) FILTER (side = 'test')")} AS test_auroc_fold_sd FROM pf GROUP BY arm""")
def a19(spark, sf):
    per_fold = E.optimism(feature_cohort(spark, sf), ["A_recording", "C_subject_key"], LINES)
    return rounded(E.arm_summary(per_fold), "train_auroc_mean", "test_auroc_mean", "test_auroc_fold_sd")


CURVE = f"""{SQL.folds_sql(['C_subject_key'], 5, 3, SEED)}, {SUBSETS},
lt AS (SELECT c.repeat, c.fold, c.fraction, c.n_train_participants, fc.* EXCLUDE (batch) FROM chosen c JOIN fc USING (subject_id)),
lm AS (SELECT repeat, fold, fraction, n_train_participants, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 0) AS n0,
 {', '.join(f'avg({f}) FILTER (label = {y}) AS {f}_m{y}, var_pop({f}) FILTER (label = {y}) + 1e-9::DOUBLE AS {f}_v{y}' for f in LINES for y in (0, 1))} FROM lt GROUP BY ALL),
lr AS (SELECT m.repeat, m.fold, m.fraction, m.n_train_participants, 'train' AS side, f.label, {SQL.log_odds_sql(LINES)} AS score FROM lt f JOIN lm m ON f.repeat = m.repeat AND f.fold = m.fold AND f.fraction = m.fraction
 UNION ALL SELECT m.repeat, m.fold, m.fraction, m.n_train_participants, 'test', f.label, {SQL.log_odds_sql(LINES)} FROM folds f JOIN lm m ON f.repeat = m.repeat AND f.fold = m.fold),
{SQL.auroc_sql('lr', ['repeat', 'fold', 'fraction', 'n_train_participants', 'side'], 'la')},
curve AS (SELECT repeat, fold, fraction, n_train_participants, max(auroc) FILTER (side = 'train') AS auroc_train, max(auroc) FILTER (side = 'test') AS auroc_test FROM la GROUP BY ALL)"""


@query("e11_learning_curve", f"WITH {FT}, {CURVE} SELECT repeat::INTEGER AS repeat, fold, fraction, n_train_participants, {s6('auroc_train')} AS auroc_train, {s6('auroc_test')} AS auroc_test FROM curve")
def e11(spark, sf):
    return rounded(E.learning_curve(feature_cohort(spark, sf), LINES), "auroc_train", "auroc_test")


@query("a17_learning_curve_summary", f"WITH {FT}, {CURVE} SELECT fraction, {s6('avg(auroc_test)')} AS mean, {s6('stddev_samp(auroc_test)')} AS sd, count(*) AS n FROM curve GROUP BY fraction")
def a17(spark, sf):
    return rounded(E.learning_curve_summary(E.learning_curve(feature_cohort(spark, sf), LINES)), "mean", "sd")


BATCH = f"""bc AS (SELECT * EXCLUDE (label), (batch = {MATCHED_BATCH})::INTEGER AS label FROM ft WHERE "group" = 'case' AND task = '2-HIGH'
 AND subject_id NOT IN (SELECT subject_id FROM ft WHERE "group" = 'case' AND task = '2-HIGH' GROUP BY 1 HAVING min(batch) <> max(batch))),
{SQL.folds_sql(['C_subject_key'], 5, 5, SEED, 'bc', name='bfolds')}, {SQL.models_sql(LINES, AR, 'bfolds', 'bmodels')}, {SQL.scored_sql(LINES, AR, 'bfolds', 'bmodels', 'bscored')},
boof AS (SELECT recording_id, subject_id, label, avg(score) AS score FROM bscored GROUP BY ALL),
bpeople AS (SELECT subject_id, max(label) AS label, round(avg(score), 9) AS score FROM boof GROUP BY ALL), {SQL.ci_sql('bpeople', [], 'subject_id', N_BOOT, SEED, 'bci')}"""


def batch_ci(spark, sf):
    rows = feature_table(spark, sf).where(F.col("task") == "2-HIGH")
    people = E.batch_control(rows, "case", MATCHED_BATCH, LINES)
    return R.bootstrap_ci(people, [], n_boot=N_BOOT)


@query("e12_batch_control", f"WITH {FT}, {BATCH} SELECT {CI_OUT} FROM bci")
def e12(spark, sf):
    return rounded(batch_ci(spark, sf), "auroc", "ci_lo", "ci_hi")


def demographic(rows):
    """Held-out probabilities of a logistic regression on scaled age and sex."""
    x = F.array(F.col("age").cast("double"), (F.col("sex") == "M").cast("double"))
    dealt = RG.with_fold_roles(rows.select(*E.KEYS, x.alias("x")), n_repeats=1, seed=SEED)
    return RG.cross_validated(dealt, 2, 1.0, n_repeats=1, scaled=[True, False])[0]


def demographic_sql(base, name):
    """The same regression by twenty Newton steps, its three equations solved by determinants."""
    h = [["h00", "h01", "h02"], ["h01", "h11", "h12"], ["h02", "h12", "h22"]]

    def det(m):
        minor = lambda a, b, c, d: f"({a} * {d} - {b} * {c})"
        return (f"({m[0][0]} * {minor(m[1][1], m[1][2], m[2][1], m[2][2])} - {m[0][1]} * {minor(m[1][0], m[1][2], m[2][0], m[2][2])}"
                f" + {m[0][2]} * {minor(m[1][0], m[1][1], m[2][0], m[2][1])})")

    step = [f"b{j} - {det([[f'g{i}' if c == j else h[i][c] for c in range(3)] for i in range(3)])} / {det(h)}" for j in range(3)]
    n = name
    return f"""{SQL.folds_sql(['C_subject_key'], 5, 1, SEED, base, name=n + 'f')},
{n}m AS (SELECT m.fold, avg(age) AS mu, stddev_pop(age) AS sd FROM (SELECT DISTINCT fold FROM {n}f) m JOIN {n}f t ON t.fold <> m.fold GROUP BY m.fold),
{n}t AS (SELECT m.fold, (age - mu) / sd AS a, (sex = 'M')::INTEGER::DOUBLE AS b, label AS y FROM {n}m m JOIN {n}f t ON t.fold <> m.fold),
{n}i AS (SELECT fold, 0 AS i, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM {n}m
  UNION ALL SELECT fold, i + 1, {', '.join(step)} FROM (
    SELECT fold, i, b0, b1, b2, sum(p - y) AS g0, sum((p - y) * a) + b1 AS g1, sum((p - y) * b) + b2 AS g2, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * a) AS h01,
      sum(p * (1 - p) * b) AS h02, sum(p * (1 - p) * a * a) + 1 AS h11, sum(p * (1 - p) * a * b) AS h12, sum(p * (1 - p) * b * b) + 1 AS h22
    FROM (SELECT s.*, a, b, y, 1 / (1 + exp(-(b0 + b1 * a + b2 * b))) AS p FROM {n}i s JOIN {n}t USING (fold) WHERE i < 20) GROUP BY fold, i, b0, b1, b2)),
{n} AS (SELECT subject_id, max(label) AS label, round(avg(1 / (1 + exp(-(b0 + b1 * (age - mu) / sd + b2 * (sex = 'M')::INTEGER)))), 9) AS score
  FROM {n}f JOIN {n}m USING (fold) JOIN {n}i USING (fold) WHERE i = 20 GROUP BY subject_id)"""


DEMO = f"""dall AS (SELECT * FROM fc), dbat AS (SELECT * FROM fc WHERE batch = {MATCHED_BATCH}), {demographic_sql('dall', 'da')}, {demographic_sql('dbat', 'db')},
{SQL.ci_sql('da', [], 'subject_id', N_BOOT, SEED, 'dac')}, {SQL.ci_sql('db', [], 'subject_id', N_BOOT, SEED, 'dbc')}"""


@query("e14_negative_controls", f"""WITH RECURSIVE {FT}, {DEMO}, {BATCH}, {NULL_SQL}
SELECT 'age + sex only (full)' AS control, {CI_OUT} FROM dac UNION ALL SELECT 'age + sex only (batch_matched)', {CI_OUT} FROM dbc UNION ALL SELECT 'batch, cases only', {CI_OUT} FROM bci
UNION ALL SELECT 'label permutation null mean (' || arm || ')', {s6('avg(auroc)')}, {s6('quantile_cont(auroc, 0.025)')}, {s6('quantile_cont(auroc, 0.975)')}, (SELECT count(*) FROM subj) FROM null_a GROUP BY arm""")
def e14(spark, sf):
    fc = feature_cohort(spark, sf)
    n = fc.agg(F.countDistinct("subject_id")).scalar()
    null = permutation(spark, sf).select(
        F.concat(F.lit("label permutation null mean ("), "arm", F.lit(")")).alias("control"),
        F.col("null_mean").alias("auroc"), F.col("null_lo").alias("ci_lo"), F.col("null_hi").alias("ci_hi"), n.alias("n"),
    )
    rows = null.unionByName(E.control_row("batch, cases only", batch_ci(spark, sf)))
    for name, cohort_rows in (("full", fc), ("batch_matched", fc.where(F.col("batch") == MATCHED_BATCH))):
        ci = R.bootstrap_ci(M.to_participants(demographic(cohort_rows)), [], n_boot=N_BOOT)
        rows = rows.unionByName(E.control_row(f"age + sex only ({name})", ci))
    return rounded(rows, "auroc", "ci_lo", "ci_hi")
