"""Models, gates, harmonisation and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.draws import poisson_sql
from ...operators import boosting as BO
from ...operators import forest as FO
from ...operators import identity as I
from ...operators import metrics as M
from ...operators import models as ML
from ...operators import regression as RG
from ...operators import report
from ...operators import resample as R
from ...operators import stats as H
from ...session import materialise
from ...sources import tables
from .. import experiment as E
from .. import harmonise
from .. import oracle as SQL
from ..registry import query
from ..views import FT, feature_cohort, feature_table, r6, s6, table
from .audit import META, meta
from .experiments import ABC, AR, LINES, N_BOOT, OOF, SEED, demographic, demographic_sql, rounded
from .sources_scalars import NAMES2, names2

# -- logistic fits on embeddings -------------------------------------------------------

DIMENSIONS = 64
CORPORA = [0, 1]


def embedded(spark, sf):
    """Five neighbouring vectors with the same label make a participant."""
    emb = table(spark, sf, "embeddings")
    label = (F.col("label") < 5).cast("int")
    return emb.select(
        F.col("vec_id").alias("recording_id"), (F.floor(F.col("vec_id") / 5) * 2 + label).cast("bigint").alias("subject_id"),
        (F.col("vec_id") % 2).cast("int").alias("corpus"), label.alias("label"), F.col("embedding").cast("array<double>").alias("x"),
    )


EMB = """emb AS (SELECT vec_id AS recording_id, (vec_id // 5) * 2 + (label < 5)::INTEGER AS subject_id, (vec_id % 2)::INTEGER AS corpus, '' AS folder_path, (label < 5)::INTEGER AS label FROM embeddings)"""


def by_participant(scored):
    """Mean over repeats per recording, then over recordings."""
    oof = scored.groupBy("recording_id", "subject_id", "label").agg(F.avg("score").alias("score"))
    return M.to_participants(oof).select("subject_id", "label", r6("score").alias("score"))


@query("e01_random_forest")
def e01(spark, sf):
    """A hundred trees in every fold of every repeat."""
    return by_participant(FO.cross_validated(RG.with_fold_roles(embedded(spark, sf), seed=SEED), DIMENSIONS, trees=100))


BAGS = f"""bag AS (SELECT f.repeat, f.fold, t, label, {poisson_sql(SEED, '(f.repeat * 5 + f.fold) * 100 + t', 'recording_id')} AS w
  FROM (SELECT m.repeat, m.fold, recording_id, label FROM (SELECT DISTINCT repeat, fold FROM folds) m JOIN folds t ON t.repeat = m.repeat AND t.fold <> m.fold) f, (SELECT unnest(range(100)) AS t))"""


@query("e01_random_forest_bags", f"""WITH {EMB}, {SQL.folds_sql(['C_subject_key'], 5, 5, SEED, 'emb')}, {BAGS}
SELECT repeat::INTEGER AS repeat, fold::INTEGER AS fold, t::INTEGER AS tree, sum(w)::BIGINT AS n_weight, {s6('sum(w * label) / sum(w)::DOUBLE')} AS share FROM bag GROUP BY ALL""")
def e01_bags(spark, sf):
    """The roots of all trees: weight and share of class 1 in each tree's bag."""
    data, cuts = FO.prepared(RG.with_fold_roles(embedded(spark, sf), seed=SEED), DIMENSIONS)
    forests = [FO.Forest(r, f, 100, max_depth=0) for r in range(5) for f in range(5)]
    return rounded(FO.roots(data, cuts, forests, SEED).withColumnRenamed("outer", "repeat"), "share")


def five_by_five(spark, sf, c, l1=0.0):
    return RG.cross_validated(RG.with_fold_roles(embedded(spark, sf), seed=SEED), DIMENSIONS, c, l1)


TRAINED = f"""WITH {EMB}, {SQL.folds_sql(['C_subject_key'], 5, 5, SEED, 'emb')}
SELECT m.repeat::INTEGER AS repeat, m.fold::INTEGER AS fold, count(*)::BIGINT AS n_train, sum(label)::BIGINT AS n_pos, 0.0::DOUBLE AS residual
FROM (SELECT DISTINCT repeat, fold FROM folds) m JOIN folds t ON t.repeat = m.repeat AND t.fold <> m.fold GROUP BY ALL"""


def fits_table(spark, models):
    """Each fit with its training set and the largest violation of its optimality conditions."""
    rows = [(m.fit.outer, m.fit.fold, m.n_train, m.n_pos, round(m.residual, 6)) for m in models]
    return spark.createDataFrame(rows, "repeat int, fold int, n_train bigint, n_pos bigint, residual double")


@query("e02_logistic_l2")
def e02(spark, sf):
    return by_participant(five_by_five(spark, sf, 0.1)[0])


@query("e02_logistic_l2_optimality", TRAINED)
def e02_fits(spark, sf):
    return fits_table(spark, five_by_five(spark, sf, 0.1)[1])


@query("e03_elastic_net")
def e03(spark, sf):
    return by_participant(five_by_five(spark, sf, 0.2, 0.3)[0])


@query("e03_elastic_net_optimality", TRAINED)
def e03_fits(spark, sf):
    return fits_table(spark, five_by_five(spark, sf, 0.2, 0.3)[1])


#: Settings of the search over boosted trees; both numbers of rounds are read off one fit.
BOOST_SHAPES = [{"depth": d, "alpha": a, "rate": r} for d in (2, 3) for a in (0.1, 1.0) for r in (0.05, 0.1)]
BOOST_ROUNDS = [50, 100]


def boosted(spark, sf):
    rows = RG.with_corpus_roles(embedded(spark, sf), CORPORA, 3, SEED)
    return BO.nested_search(rows, DIMENSIONS, "GradientBoosting", BOOST_SHAPES, BOOST_ROUNDS, len(CORPORA))


@query("e04_boosted_trees")
def e04(spark, sf):
    """The setting that is best in inner folds, for every held-out corpus."""
    return rounded(M.to_participants(boosted(spark, sf)[0], ["corpus"]), "score")


#: Settings of the forest search; every one has a hundred trees.
FOREST_GRID = [{"max_depth": d, "min_leaf": m} for d in (3, 5) for m in (2, 4)]


def forest_search(spark, sf):
    rows = RG.with_corpus_roles(embedded(spark, sf), CORPORA, 3, SEED)
    return FO.nested_search(rows, DIMENSIONS, "RandomForest", FOREST_GRID, len(CORPORA), seed=SEED)


@query("e05_tuned_forest")
def e05(spark, sf):
    """The setting that is best in inner folds, for every held-out corpus."""
    return rounded(M.to_participants(forest_search(spark, sf)[0], ["corpus"]), "score")


@query("e06_demographic_baseline", f"WITH RECURSIVE {FT}, {demographic_sql('fc', 'dg')} SELECT subject_id, label, {s6('score')} AS score FROM dg")
def e06(spark, sf):
    people = M.to_participants(demographic(feature_cohort(spark, sf)))
    return people.select("subject_id", "label", r6("score").alias("score"))


#: Settings of the searched grids, ``(inverse strength, share of the lasso)``.
LOGISTIC_GRIDS = {
    "Logistic_L2": [(0.01, 0.0), (0.1, 0.0), (1.0, 0.0), (10.0, 0.0)],
    "Logistic_ElasticNet": [(c, share) for c in (0.05, 0.2, 1.0) for share in (0.3, 0.7)],
}


def nested(spark, sf):
    rows = RG.with_corpus_roles(embedded(spark, sf), CORPORA, 3, SEED)
    return RG.nested_search(rows, DIMENSIONS, LOGISTIC_GRIDS, len(CORPORA))


@query("e10_nested_search")
def e10(spark, sf):
    """All four searches: pooled AUROC with its interval, and that of each corpus."""
    columns = ["model", "corpus", "subject_id", "recording_id", "label", "score"]
    searches = [nested(spark, sf)[0], forest_search(spark, sf)[0], boosted(spark, sf)[0]]
    scored = reduce(DataFrame.unionByName, [s.select(*columns) for s in searches])
    people = M.to_participants(scored, ["model", "corpus"])
    pooled = R.bootstrap_ci(people.withColumn("subject_id", F.col("subject_id") * 2 + F.col("corpus")), ["model"], n_boot=N_BOOT)
    each = M.auroc(people, ["model", "corpus"]).groupBy("model").pivot("corpus", CORPORA).agg(F.max("auroc"))
    each = each.select("model", *[F.col(f"`{c}`").alias(f"auroc_corpus_{c}") for c in CORPORA])
    out = pooled.join(each, "model").withColumnRenamed("n", "n_participants")
    return rounded(out, "auroc", "ci_lo", "ci_hi", *[f"auroc_corpus_{c}" for c in CORPORA])


@query("e10_nested_search_optimality", f"""WITH g AS (SELECT unnest([{', '.join(f"{{'model': '{n}', 'c': {c}::DOUBLE, 'l1_ratio': {r}::DOUBLE}}" for n, grid in LOGISTIC_GRIDS.items() for c, r in grid)}]) AS g)
SELECT g.model AS model, corpus::INTEGER AS corpus, g.c AS c, g.l1_ratio AS l1_ratio, 0.0::DOUBLE AS residual FROM g, (SELECT DISTINCT vec_id % 2 AS corpus FROM embeddings)""")
def e10_fits(spark, sf):
    """Every setting for every held-out corpus, with the worst of its fits."""
    _, told = nested(spark, sf)
    rows = [(name, outer, c, share, round(residual, 6)) for name, outer, c, share, _, _, residual in told]
    return spark.createDataFrame(rows, "model string, corpus int, c double, l1_ratio double, residual double")


def elsewhere(spark, sf):
    return RG.train_elsewhere(RG.with_corpus_roles(embedded(spark, sf), CORPORA, 3, SEED), DIMENSIONS, 0.1, 0.0, len(CORPORA))


@query("e13_train_elsewhere")
def e13(spark, sf):
    return rounded(M.to_participants(elsewhere(spark, sf)[0], ["corpus"]), "score")


@query("e13_train_elsewhere_optimality", """SELECT h::INTEGER AS held_out, count(*)::BIGINT AS n_train, sum((label < 5)::INTEGER)::BIGINT AS n_pos, 0.0::DOUBLE AS residual
FROM embeddings, (SELECT unnest(range(2)) AS h) WHERE vec_id % 2 <> h GROUP BY h""")
def e13_fits(spark, sf):
    rows = [(m.fit.outer, m.n_train, m.n_pos, round(m.residual, 6)) for m in elsewhere(spark, sf)[1]]
    return spark.createDataFrame(rows, "held_out int, n_train bigint, n_pos bigint, residual double")


#: Forest sizes of the convergence curve.
OOB_SIZES = [10, 25, 50, 75, 100, 150, 200, 300, 500]


def oob(spark, sf):
    return FO.out_of_bag_error(embedded(spark, sf), DIMENSIONS, OOB_SIZES, SEED)


@query("m14_out_of_bag_error")
def m14(spark, sf):
    return rounded(oob(spark, sf).select("n_trees", "oob_error", "n_scored"), "oob_error")


@query("m14_out_of_bag_votes", f"""WITH {EMB}, w AS (SELECT recording_id, t, {poisson_sql(SEED, 't', 'recording_id')} AS w FROM emb, (SELECT unnest(range({max(OOB_SIZES)})) AS t)),
s AS (SELECT unnest([{', '.join(map(str, OOB_SIZES))}]) AS n_trees)
SELECT n_trees::INTEGER AS n_trees, count(DISTINCT recording_id)::BIGINT AS n_scored, count(*)::BIGINT AS n_votes FROM s JOIN w ON t < n_trees WHERE w = 0 GROUP BY n_trees""")
def m14_votes(spark, sf):
    return oob(spark, sf).select("n_trees", "n_scored", "n_votes")


# -- gates ---------------------------------------------------------------------------

POOLED = lambda feats, tag: f"""{SQL.folds_sql(['D_leave_one_corpus_out'], 1, 1, 0, name=tag + 'f')}, {SQL.models_sql(feats, AR, tag + 'f', tag + 'm')}, {SQL.scored_sql(feats, AR, tag + 'f', tag + 'm', tag + 's')},
{tag}p AS (SELECT subject_id, max(label) AS label, round(avg(score), 9) AS score FROM {tag}s GROUP BY ALL)"""  # noqa: E731
GATES = f"""{POOLED(['header'], 'ga')}, {SQL.auroc_sql('gap', [], 'gaa')}, {POOLED(LINES, 'gb')}, {SQL.ci_sql('gbp', [], 'subject_id', N_BOOT, SEED, 'gbc')},
px AS (SELECT corpus, subject_id, max(label) AS label, round(avg(age), 9) AS score FROM fc GROUP BY ALL), {SQL.auroc_sql('px', ['corpus'], 'pxa')},
sv AS (SELECT subject_id, avg(header) AS score, max(f_lines) AS s1, max(f_qty) AS s2 FROM fc GROUP BY ALL),
sr AS (SELECT {', '.join(f'rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r{c}' for c in ('score', 's1', 's2'))} FROM sv),
rho AS (SELECT least(corr(rscore, rs1), corr(rscore, rs2)) AS r FROM sr),
gate AS (SELECT 'A' AS gate, auroc AS value, 0.65::DOUBLE AS threshold, auroc <= 0.65 AS passed FROM gaa
 UNION ALL SELECT 'B', ci_lo, (SELECT max(greatest(auroc, 1 - auroc)) FROM pxa), ci_lo > (SELECT max(greatest(auroc, 1 - auroc)) FROM pxa) FROM gbc
 UNION ALL SELECT 'C', r, 0.3::DOUBLE, r > 0.3 FROM rho)"""


def pooled(fc, features):
    return M.to_participants(E.train_elsewhere(fc, features))


def acceptance(spark, sf):
    # Read by every gate, so it is made once.
    fc = materialise(feature_cohort(spark, sf).select(*E.KEYS, *LINES, "header", "age"))
    control = M.auroc(pooled(fc, ["header"]), [])
    headline = R.bootstrap_ci(pooled(fc, LINES), [], n_boot=N_BOOT)
    proxy = M.to_participants(fc, ["corpus"], score="age")
    proxy = M.auroc(proxy, ["corpus"]).agg(F.max(M.direction_free(F.col("auroc"))).alias("auroc"))
    people = fc.groupBy("subject_id").agg(
        F.avg("header").alias("score"), F.max("f_lines").alias("s1"), F.max("f_qty").alias("s2"), F.lit(1).alias("one")
    )
    rho = [H.spearman(people, ["one"], s, "score", p_value=False).select("one", F.col("rho").alias(f"rho_{i}")) for i, s in ((1, "s1"), (2, "s2"))]
    return report.gates(control, headline, proxy, rho[0].join(rho[1], "one"))


@query("m15_acceptance_gates", f"WITH {FT}, {GATES} SELECT gate, {s6('value')} AS value, {s6('threshold')} AS threshold, passed FROM gate")
def m15(spark, sf):
    return rounded(acceptance(spark, sf), "value", "threshold")


SAVED = [f"ext{i:02d}" for i in range(64)]
EV = f"""ev AS (SELECT vec_id AS recording_id, (vec_id // 5) * 2 + (label < 5)::INTEGER AS subject_id, (vec_id % 2)::INTEGER AS corpus, '' AS folder_path, (label < 5)::INTEGER AS label,
 {', '.join(f'embedding[{i + 1}]::DOUBLE AS {c}' for i, c in enumerate(SAVED))} FROM embeddings)"""


def external(spark, sf):
    emb = table(spark, sf, "embeddings")
    label = (F.col("label") < 5).cast("int")
    return emb.select(
        F.col("vec_id").alias("recording_id"), (F.floor(F.col("vec_id") / 5) * 2 + label).cast("bigint").alias("subject_id"),
        (F.col("vec_id") % 2).cast("int").alias("corpus"), F.lit("").alias("folder_path"), label.alias("label"),
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(SAVED)],
    )


EV_GATES = f"""{SQL.auroc_sql('ev', [], 'ea', score='ext00')}, {SQL.folds_sql(['C_subject_key'], 5, 5, SEED, 'ev', name='evf')}, {SQL.models_sql(SAVED, AR, 'evf', 'evm')}, {SQL.scored_sql(SAVED, AR, 'evf', 'evm', 'evs')},
evo AS (SELECT recording_id, subject_id, label, avg(score) AS score FROM evs GROUP BY ALL), evp AS (SELECT subject_id, max(label) AS label, round(avg(score), 9) AS score FROM evo GROUP BY ALL),
{SQL.ci_sql('evp', [], 'subject_id', N_BOOT, SEED, 'evc')},
ok AS (SELECT (SELECT auroc FROM ea) <= 0.65 AND (SELECT ci_lo FROM evc) > (SELECT greatest(auroc, 1 - auroc) FROM ea) AS saved)"""


def external_gates(spark, sf):
    """Control and proxy: one external feature. Headline: all of them, cross-validated."""
    ev = external(spark, sf)
    single = M.auroc(ev, [], score="ext00")
    headline = R.bootstrap_ci(E.participant_scores(ev, ["C_subject_key"], SAVED), [], n_boot=N_BOOT)
    proxy = single.select(M.direction_free(F.col("auroc")).alias("auroc"))
    severity = ev.agg(F.corr("ext00", "label").alias("rho_1"), F.corr("ext01", "label").alias("rho_2"))
    return report.gates(single, headline, proxy, severity)


@query("e15_persist_model", f"""WITH {EV}, {EV_GATES}
SELECT 'Logistic_L2' AS estimator, saved, CASE WHEN saved THEN (SELECT count(*) FROM ev) END AS n_rows, CASE WHEN saved THEN {s6('(SELECT avg(label) FROM ev)')} END AS pi_train FROM ok""")
def e15(spark, sf):
    """The metadata of the model when gates A and B pass, else a row that says no."""
    path = tables.scratch_folder(spark, "model")
    saved = ML.persist_if_passed(
        external(spark, sf), external_gates(spark, sf), lambda n: ML.logistic(n, 0.1), SAVED, "Logistic_L2", path
    )
    if not saved:
        return spark.createDataFrame([("Logistic_L2", False, None, None)], "estimator string, saved boolean, n_rows bigint, pi_train double")
    kept = spark.read.parquet(f"{path}/metadata")
    return kept.select("estimator", F.lit(True).alias("saved"), "n_rows", r6("pi_train").alias("pi_train"))


@query("e16_batch_scoring")
def e16(spark, sf):
    """A model saved without gates, loaded and applied to every row."""
    path = tables.scratch_folder(spark, "model")
    rows = external(spark, sf)
    ML.persist_if_passed(rows, external_gates(spark, sf), lambda n: ML.logistic(n, 0.1), SAVED, "Logistic_L2", path, required=())
    scored = ML.batch_score(rows, path)
    return rounded(scored.select("recording_id", "score", "corrected"), "score", "corrected")


# -- harmonised corpora and reports ------------------------------------------------------


@query("e17_harmonise", f"""
WITH {META}, {NAMES2}, k AS (SELECT DISTINCT "group", subject_key FROM meta),
n AS (SELECT "group", subject_key, row_number() OVER (PARTITION BY "group" ORDER BY sha256(subject_key)) AS i FROM k),
a AS (SELECT 'ipvs' AS corpus, 'IPVS_' || m."group" || (CASE WHEN i < 10 THEN '0' || i::VARCHAR ELSE i::VARCHAR END) AS subject_id, CASE WHEN m."group" = 'case' THEN 'PD' ELSE 'HC' END AS "group",
  (m."group" = 'case')::INTEGER AS label, 'read_passage' AS task, task_rep, 'it' AS language, (2017 - (1900 + birth_year))::DOUBLE AS age, sex,
  NULL::DOUBLE AS severity_hy, NULL::DOUBLE AS severity_u2, NULL::DOUBLE AS severity_u3, CASE WHEN m."group" = 'case' THEN string_split(folder_path, '/')[1] END AS severity_bin,
  (CASE WHEN m."group" = 'case' THEN '28 People/' ELSE 'Control/' END) || folder_path AS folder_path, name AS path
  FROM meta m JOIN n ON m."group" = n."group" AND m.subject_key = n.subject_key WHERE m."group" IN ('case','control') AND task_base = 'B'),
b AS (SELECT 'mdvr_kcl' AS corpus, 'KCL_ID' || (CASE WHEN length(f.id) < 2 THEN '0' || f.id ELSE f.id END) AS subject_id, upper(f.g) AS "group", (upper(f.g) = 'PD')::INTEGER AS label,
  'read_passage' AS task, 1 AS task_rep, 'en' AS language, NULL::DOUBLE AS age, NULL::VARCHAR AS sex, f.hy::DOUBLE AS severity_hy, f.u2::DOUBLE AS severity_u2, f.u3::DOUBLE AS severity_u3,
  NULL::VARCHAR AS severity_bin, 'root/ReadText' AS folder_path, 'root/ReadText/' || name AS path
  FROM (SELECT name, regexp_extract(name, '{I.N.SECOND_PATTERN}', ['id','g','hy','u2','u3']) AS f, c_custkey FROM names2 WHERE c_custkey % 2 = 0 AND NOT starts_with(name, 'invalid')))
SELECT * FROM a UNION ALL SELECT * FROM b""")
def e17(spark, sf):
    m = meta(spark, sf).drop("subject_id")
    m = m.join(I.pseudonyms(m, "group", "subject_key"), ["group", "subject_key"])
    prefix = F.when(F.col("group") == "case", "28 People/").otherwise("Control/")
    m = m.withColumn("folder_path", F.concat(prefix, "folder_path")).withColumn("path", F.col("name"))
    m = m.withColumn("task", I.N.task_label(F.col("task_base")))
    first = harmonise.first_corpus(m, "ipvs", "it", "case", ["case", "control"], "28 People")
    folder = F.when(F.col("c_custkey") % 2 == 0, "root/ReadText/").otherwise("root/SpontaneousDialogue/")
    second, _ = harmonise.second_corpus(names2(spark, sf).select(F.concat(folder, "name").alias("path")), "mdvr_kcl", "en")
    return harmonise.harmonise(first, second)


PUBLISHED = [("Published single-corpus study", "5-fold, single corpus", "Accuracy 0.85-0.95"), ("Published cross-corpus study", "Cross-database", "Accuracy drop 20-30 %")]


@query("e18_comparison_table", f"""WITH {FT}, {OOF}, {SQL.ci_sql('people', ['arm'], 'subject_id', N_BOOT, SEED, 'pc')},
best AS (SELECT * FROM pc ORDER BY auroc DESC NULLS LAST, arm LIMIT 1)
SELECT 'Published single-corpus study' AS study, '5-fold, single corpus' AS scheme, 'Accuracy 0.85-0.95' AS metric UNION ALL SELECT 'Published cross-corpus study', 'Cross-database', 'Accuracy drop 20-30 %'
UNION ALL SELECT 'This data', arm, 'AUROC ' || printf('%.3f [%.3f, %.3f]', round(auroc, 6), round(ci_lo, 6), round(ci_hi, 6)) FROM best""")
def e18(spark, sf):
    people = E.participant_scores(feature_cohort(spark, sf), ABC, LINES)
    ci = R.bootstrap_ci(people, ["arm"], n_boot=N_BOOT).withColumnRenamed("auroc", "auroc_participant")
    return report.comparison_table(ci, PUBLISHED, "This data")


CUTS = [0.0, 100000.0, 200000.0, 300000.0, 400000.0, 500000.0]


@query("e19_plot_data", f"""WITH {FT}, h AS (SELECT "group", least(floor(header / 100000), 4)::INTEGER AS b, count(*) AS n FROM ft WHERE header BETWEEN 0 AND 500000 GROUP BY ALL)
SELECT "group", 'histogram' AS kind, b::VARCHAR AS item, n::DOUBLE AS value FROM h
UNION ALL SELECT "group", 'box', unnest(['q_0','q_1','q_2']), unnest([{s6('quantile_cont(header, 0.25)')}, {s6('quantile_cont(header, 0.5)')}, {s6('quantile_cont(header, 0.75)')}]) FROM ft GROUP BY "group\"""")
def e19(spark, sf):
    return rounded(report.plot_data(feature_table(spark, sf), ["group"], "header", CUTS), "value")
