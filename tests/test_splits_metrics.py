import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import calibrate as Cal
from plumbline.operators import metrics as M
from plumbline.operators import resample as R
from plumbline.operators import scorer as S
from plumbline.operators import splits as X
from plumbline.operators import stats as H
from plumbline.plans.experiment import _complete


def brute_auroc(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    num = den = 0.0
    for i in np.flatnonzero(y == 1):
        for j in np.flatnonzero(y == 0):
            den += w[i] * w[j]
            num += w[i] * w[j] * ((s[i] > s[j]) + 0.5 * (s[i] == s[j]))
    return num / den if den else None


@pytest.fixture(scope="module")
def toy(spark):
    rows = []
    for i in range(8):
        folders = ["PD/1-5/A", "PD/11-16/A"] if i == 0 else [f"PD/1-5/S{i}"]
        rows += [(f"PD{i:02d}", f, 1, s + 1, rep) for s, f in enumerate(folders) for rep in (1, 2)]
    rows += [(f"eHC{i:02d}", f"eHC/{i}", 0, 1, rep) for i in range(8) for rep in (1, 2)]
    rows = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "recording_id bigint, subject_id string, folder_path string, label int, session_index int, task_rep int")


def test_participant_arm_is_disjoint_and_complete(spark, toy):
    folds = X.assign_folds(toy, ["C_subject_key"], 5, 3).toPandas()
    assert folds.groupby(["repeat", "subject_id"]).fold.nunique().max() == 1
    assert (folds.groupby(["repeat", "recording_id"]).size() == 1).all() and len(folds) == 34 * 3
    assert folds.groupby("repeat").fold.nunique().eq(5).all()


def test_recording_arm_leaks_and_folder_arm_leaks_one(spark, toy):
    folds = X.assign_folds(toy, ["A_recording", "B_folder_path", "C_subject_key"], 5, 5)
    rates = {r["arm"]: r for r in X.check_contrast(X.leakage_rates(X.leakage_report(folds))).collect()}
    assert rates["A_recording"]["folds_with_leakage"] > 0 and rates["C_subject_key"]["folds_with_leakage"] == 0
    per = folds.where("arm = 'B_folder_path'").toPandas().groupby(["repeat", "subject_id"]).fold.nunique()
    assert set(per[per > 1].index.get_level_values(1)) <= {"PD00"}


def test_contrast_check_fails_loudly(spark):
    bad = spark.createDataFrame([("C_subject_key", 5, 1)], "arm string, folds int, folds_with_leakage int")
    with pytest.raises(PySparkException, match="contrast"):
        X.check_contrast(bad).collect()


def test_leave_one_corpus_out(spark):
    rows = [(i, f"s{i // 2}", "ab"[i // 8], (i // 2) % 2) for i in range(16)]
    df = spark.createDataFrame(rows, "recording_id bigint, subject_id string, corpus string, label int")
    folds = X.assign_folds(df, ["D_leave_one_corpus_out"], n_repeats=1).toPandas()
    assert len(folds) == 16 and folds.groupby("fold").corpus.nunique().tolist() == [1, 1]
    assert (X.leakage_report(X.assign_folds(df, ["D_leave_one_corpus_out"], n_repeats=1)).toPandas().n_leaked_participants == 0).all()


def test_unknown_arm_and_missing_column(spark, toy):
    with pytest.raises(KeyError, match="unknown arm"):
        X.assign_folds(toy, ["E"])
    with pytest.raises(KeyError, match="corpus"):
        X.assign_folds(toy, ["D_leave_one_corpus_out"])


def test_rows_without_a_unit_are_told_and_refused(spark, toy):
    holes = toy.withColumn("corpus", F.when(F.col("recording_id") != 3, F.lit("x"))).withColumn(
        "folder_path", F.when(F.col("recording_id") != 5, F.col("folder_path"))
    )
    arms = ["B_folder_path", "C_subject_key", "D_leave_one_corpus_out"]
    told = {r["recording_id"]: r["error"] for r in X.without_unit(holes, arms).collect()}
    assert told == {3: "no corpus for D_leave_one_corpus_out", 5: "no folder_path for B_folder_path"}
    for arm in (arms[0], arms[2]):
        with pytest.raises(PySparkException, match="cannot be dealt"):
            X.assign_folds(holes, [arm], 4, 1).collect()
    assert X.assign_folds(holes, [arms[1]], 4, 1).count() == 34


def test_models_sent_in_parts_meet_the_same_rows(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7, i % 3, float(i)) for i in range(60)], "arm int, fold int, v double")
    models = spark.createDataFrame([(a, f, a * 10.0 + f) for a in range(7) for f in range(3)], "arm int, fold int, m double")
    whole = S.attach(rows, models, ["arm", "fold"], 21, 5).collect()
    monkeypatch.setattr(S, "MODEL_BYTES", 1500)
    parts = S.attach(rows, models, ["arm", "fold"], 21, 5)
    assert sorted(parts.collect()) == sorted(whole) and len(whole) == 60
    assert "Exchange hashpartitioning" not in parts._jdf.queryExecution().toString()


def test_a_recording_that_is_not_scored_everywhere_stops_the_run(spark):
    oof = spark.createDataFrame([(1, 1, 5), (2, 0, 4)], "recording_id bigint, label int, _scored bigint")
    assert _complete(oof.where("recording_id = 1"), 5).count() == 1
    with pytest.raises(PySparkException, match="recording 2 was not scored"):
        _complete(oof, 5).collect()


def test_training_subsets(spark, toy):
    folds = X.assign_folds(toy, ["C_subject_key"], 4, 1)
    own = {r["subject_id"]: r["fold"] for r in folds.select("subject_id", "fold").distinct().collect()}
    sub = X.training_subsets(folds, [0.1, 0.5, 1.0]).toPandas()
    assert all(own[r.subject_id] != r.fold for r in sub.itertuples())
    sizes = sub.groupby(["fold", "fraction"]).size().unstack()
    assert (sizes[0.1] == 4).all() and (sizes[1.0] == 12).all() and (sizes[0.5] == 6).all()


def test_participant_aggregation(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 1, 0.7), ("b", 0, 0.2), ("b", 0, 0.4), ("c", 1, 0.8)], "subject_id string, label int, score double")
    out = {r["subject_id"]: r["score"] for r in M.to_participants(df).collect()}
    assert len(out) == 3 and out["a"] == pytest.approx(0.8)
    bad = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.2)], "subject_id string, label int, score double")
    with pytest.raises(PySparkException, match="more than one label"):
        M.to_participants(bad).collect()


def test_auroc_equals_pair_count(spark, plan):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 300), "label": rng.integers(0, 2, 300), "score": rng.integers(0, 12, 300) / 4.0, "w": rng.integers(0, 4, 300)})
    pdf.loc[pdf.k == 2, "label"] = 1
    df = spark.createDataFrame(pdf)
    plain = M.auroc(df, ["k"]).toPandas().set_index("k").auroc
    weighted = M.auroc(df, ["k"], weight="w").toPandas().set_index("k").auroc
    for k in (0, 1):
        g = pdf[pdf.k == k]
        assert plain[k] == pytest.approx(brute_auroc(g.label.values, g.score.values))
        assert weighted[k] == pytest.approx(brute_auroc(g.label.values, g.score.values, g.w.values))
    assert pd.isna(plain[2])


def _people(spark, n):
    rng = np.random.default_rng(0)
    y = np.r_[np.ones(n // 2), np.zeros(n // 2)].astype(int)
    s = np.r_[rng.normal(1, 1, n // 2), rng.normal(0, 1, n // 2)]
    return spark.createDataFrame(pd.DataFrame({"subject_id": np.arange(n), "label": y, "score": s}))


@pytest.mark.parametrize("method", ["poisson", "multinomial"])
def test_interval_widens_with_fewer_participants(spark, method):
    def width(n):
        r = R.bootstrap_ci(_people(spark, n), [], n_boot=200, method=method).first()
        assert r["ci_lo"] <= r["auroc"] <= r["ci_hi"] and r["n"] == n
        return r["ci_hi"] - r["ci_lo"]

    assert width(40) > width(400)


def test_bootstrap_is_the_same_in_both_plans(spark, plan):
    r = R.bootstrap_ci(_people(spark, 400), [], n_boot=100).first()
    from plumbline.functions import draws as D

    p = _people(spark, 400).toPandas()
    got = [brute_auroc(p.label.values, p.score.values, D.poisson_np(42, d, p.subject_id.values)) for d in range(3)]
    drawn = {x["draw"]: x["auroc"] for x in R.poisson_draws(_people(spark, 400), [], "subject_id", 3, 42).collect()}
    assert [drawn[d] for d in range(3)] == pytest.approx(got)
    assert (round(r["ci_lo"], 9), round(r["ci_hi"], 9)) == test_bootstrap_is_the_same_in_both_plans.__dict__.setdefault("seen", (round(r["ci_lo"], 9), round(r["ci_hi"], 9)))


def test_paired_delta_of_a_score_with_itself(spark):
    p = _people(spark, 60).select("subject_id", "label", F.col("score").alias("a"), F.col("score").alias("b"))
    r = R.paired_delta(p, [], "a", "b", n_boot=50).first()
    assert r["delta"] == r["ci_lo"] == r["ci_hi"] == 0.0 and r["p"] == 1.0


def test_permuted_labels_keep_the_class_sizes(spark, plan):
    out = R.permuted_labels(_people(spark, 60), [], 5).toPandas()
    assert out.groupby("perm").label_perm.sum().tolist() == [30] * 5
    assert out.pivot(index="subject_id", columns="perm", values="label_perm").T.drop_duplicates().shape[0] == 5


def test_held_out_models_equal_a_rescan(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"fold": rng.integers(0, 4, 400), "label": rng.integers(0, 2, 400), "x": rng.normal(1e6, 1.0, 400)})
    m = S.held_out_models(S.class_moments(spark.createDataFrame(pdf), ["fold"], ["x"]), [], ["x"]).toPandas().set_index("fold")
    for f in range(4):
        rest = pdf[pdf.fold != f]
        for y in (0, 1):
            v = rest[rest.label == y].x
            assert m[f"_x_m{y}"][f] == pytest.approx(v.mean(), rel=1e-12)
            assert m[f"_x_v{y}"][f] == pytest.approx(v.var(ddof=0) + 1e-9, rel=1e-6)


def test_prior_correction(spark):
    df = spark.createDataFrame([(0.5,), (0.8,), (0.95,)], "p double")
    out = [r[0] for r in df.select(Cal.prior_correction(F.col("p"), 0.5, 0.015)).collect()]
    assert out[0] == pytest.approx(0.015, rel=1e-3) and all(c < p for c, p in zip(out, (0.5, 0.8, 0.95)))


def test_predictive_value(spark):
    r = spark.range(1).select(Cal.predictive_value(F.lit(0.9), F.lit(0.9)).alias("p"), Cal.predictive_value(F.lit(0.0), F.lit(1.0)).alias("z")).first()
    assert r["p"] == pytest.approx(0.1206, abs=1e-3) and r["z"] == 0.0


Y = [1, 1, 0, 0, 1, 0, 1, 0, 0, 1]


def test_murphy_identity(spark):
    p = [0.9, 0.7, 0.1, 0.2, 0.8, 0.3, 0.6, 0.4, 0.1, 0.85]
    r = Cal.brier_decomposition(spark.createDataFrame(list(zip(Y, p)), "y int, p double"), "y", "p", 5).first()
    assert r["brier_binned"] == pytest.approx(r["reliability"] - r["resolution"] + r["uncertainty"], abs=1e-9)


def test_bins_follow_the_edges(spark):
    edges = Cal.edges(10)
    values = [0.0, 0.1, 0.3, 0.6, 0.7, 0.999, 1.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "p double").select(Cal.bin_index(F.col("p"), edges)).collect()]
    assert got == [int(min(max(np.digitize(v, edges) - 1, 0), 9)) for v in values]


def test_decision_curve(spark):
    p = [0.95, 0.9, 0.05, 0.1, 0.85, 0.1, 0.8, 0.15, 0.05, 0.9]
    d = Cal.decision_curve(spark.createDataFrame(list(zip(Y, p)), "y int, p double"), "y", "p", [0.1, 0.3, 0.5]).toPandas()
    assert len(d) == 3 and (d.net_benefit_model >= 0).all()
    y, q = np.array(Y), np.array(p)
    for r in d.itertuples():
        hit = q >= r.threshold
        want = (hit & (y == 1)).mean() - (hit & (y == 0)).mean() * r.threshold / (1 - r.threshold)
        assert r.net_benefit_model == pytest.approx(want)


def test_tails_against_table_values():
    assert H.t_two_sided(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert H.t_two_sided(12.706, 1) == pytest.approx(0.05, abs=1e-4)
    assert H.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert H.fisher_two_sided(3, 1, 1, 3) == pytest.approx(0.4857142857)
    assert H.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503497)


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 3.0), (1, 1.0, 4.0)], "k int, a double, b double")
    assert df.groupBy("k").agg(H.correlation(F.col("a"), F.col("b")).alias("r")).first()["r"] is None
    assert H.spearman(df, ["k"], "a", "b").first()["rho"] is None
