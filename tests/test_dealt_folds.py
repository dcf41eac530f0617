"""Folds, leaks and scores from one row per recording, against the long form."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException

from plumbline.operators import scorer as S
from plumbline.operators import splits as X
from plumbline.plans import experiment as E

ARMS = ["A_recording", "B_folder_path", "D_leave_one_corpus_out"]


@pytest.fixture(scope="module")
def recordings(spark):
    rng = np.random.default_rng(5)
    person = rng.integers(0, 40, 400)
    pdf = pd.DataFrame({
        "cell": np.where(rng.random(400) < 0.3, "x", "y"), "recording_id": np.arange(400), "subject_id": person, "label": person % 2,
        "corpus": person % 3, "folder_path": [f"{p}/{q}" for p, q in zip(person, rng.integers(0, 3, 400))],
        "f": rng.normal(0, 1, 400) + person % 2, "g": rng.normal(9, 2, 400),
    })
    df = spark.createDataFrame(pdf)
    return df.selectExpr(
        "cell", "recording_id", "IF(subject_id = 7, NULL, subject_id) AS subject_id", "CAST(label AS int) AS label", "corpus", "folder_path",
        "IF(recording_id % 11 = 0, NULL, f) AS f", "g",
    )


def test_leaks_need_no_row_per_arm_and_repeat(spark, plan, recordings):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # participants go on in the next batch
    try:
        dealt = X.materialise(X.deal_folds(recordings, ARMS, 4, 3, cell=["cell"]))
        told = X.leakage_of_dealt(dealt, ARMS, 3, ["cell"])
        assert "Generate" not in told._jdf.queryExecution().toString()
        got = told.toPandas()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = X.leakage_report(X.unpack_folds(X.with_entries(dealt, ARMS)), ["cell"]).toPandas()
    key = ["cell", "arm", "repeat", "fold"]
    pd.testing.assert_frame_equal(
        got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)[got.columns], check_dtype=False
    )
    assert got.n_test_recordings.sum() == 400 * 3 * 3 and 0 < got.n_leaked_recordings.sum() < 400 * 3 * 3


def test_scores_are_those_of_the_long_form(spark, plan, recordings):
    sets = {"one": ["f"], "both": ["f", "g"]}
    dealt = X.materialise(X.deal_folds(recordings, ARMS, 4, 3, cell=["cell"]))
    means = E.out_of_fold_means(dealt, ARMS, sets, ["f", "g"], ["cell"], 3).toPandas().set_index("recording_id").scores
    folds = X.unpack_folds(X.with_entries(dealt, ARMS))
    for j, fs in enumerate(sets.values()):
        scored = E.score_out_of_fold(folds, fs, ["cell"], 100).groupBy("arm", "recording_id").agg({"score": "avg"}).toPandas()
        for i, arm in enumerate(ARMS):
            want = scored[scored.arm == arm].set_index("recording_id")["avg(score)"].sort_index()
            got = means.map(lambda v: v[i * len(sets) + j]).astype(float).sort_index()
            assert got.isna().sum() == 37 and np.allclose(got, want, atol=1e-10, equal_nan=True)
    slots = E._Slots(dealt, ARMS, ["cell"], 3)
    models = E.held_out_arrays(dealt, slots, ["f", "g"], ["cell"])
    keys = ["cell", "arm", "repeat"]
    want = {
        (m["cell"], m["arm"], m["repeat"], m["fold"]): m
        for m in S.held_out_models(S.class_moments(folds, [*keys, "fold"], ["f", "g"]), keys, ["f", "g"]).collect()
    }
    for i, key in enumerate(slots.rows()):
        assert models.prior[i] == pytest.approx(want[key]["_prior"]) and models.var[i, 1, 0] == pytest.approx(want[key]["_f_v1"])


def test_a_recording_twice_stops_the_grid(spark, recordings):
    rows = recordings.where("subject_id IS NOT NULL")
    with pytest.raises(PySparkException, match="recording 3 was not scored"):
        E.run_arms(rows.unionByName(rows.where("recording_id = 3")), ["A_recording"], {"both": ["f", "g"]}, ["cell"], n_repeats=2, n_boot=0)
