"""Exact AUROC of many selections against pair counts."""

import numpy as np
import pandas as pd
import pytest

from plumbline.operators import selections as L
from plumbline.operators import splits as X
from plumbline.operators.blocks import matrix
from plumbline.plans import experiment as E


def brute_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean())


def log_odds(train, x):
    out = np.log((train.label == 1).sum()) - np.log((train.label == 0).sum())
    for y, sign in ((1, -1.0), (0, 1.0)):
        v = train.x[train.label == y]
        out = out + sign * (np.log(v.var(ddof=0) + 1e-9) + (x - v.mean()) ** 2 / (v.var(ddof=0) + 1e-9)) / 2
    return np.asarray(out)


@pytest.mark.parametrize("range_rows", [1 << 18, 50])
def test_selections_in_one_and_in_many_ranges(spark, monkeypatch, range_rows):
    monkeypatch.setattr(L, "RANGE_ROWS", range_rows)
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": np.round(rng.normal(0, 1, 600), 1), "label": rng.integers(0, 2, 600)})
    pdf["v"] = [[v, -v, v * 1e-7, 1.0] for v in pdf.x]
    df = spark.createDataFrame(pdf[["v", "label"]]).repartition(5)

    def scored(b):
        v = matrix(b.column(0)).T.copy()
        v[0, v[0] > 1] = np.nan
        return v, b.column(1).to_numpy()

    got = {r["sel"]: r["auroc"] for r in L.auroc_of_selections(df, 4, scored).collect()}
    x, y = pdf.x.to_numpy(), pdf.label.to_numpy()
    want = [brute_auroc(y[x <= 1], x[x <= 1]), brute_auroc(y, -x), brute_auroc(y, x), 0.5]
    assert [got[i] for i in range(4)] == pytest.approx(want, abs=1e-12)


@pytest.fixture(scope="module")
def faint(spark):
    """Log odds of all recordings lie within some thousandths."""
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"recording_id": np.arange(400), "subject_id": np.arange(400) // 2, "folder_path": "f", "corpus": 0})
    pdf["label"] = (pdf.subject_id % 2).astype("int32")
    x = rng.normal(0, 1, 400)
    for y in (0, 1):
        x[pdf.label == y] = (x[pdf.label == y] - x[pdf.label == y].mean()) / x[pdf.label == y].std() + 1e-4 * y
    return spark.createDataFrame(pdf.assign(x=x)), pdf.assign(x=x)


def test_learning_curve_compares_exact_scores(spark, faint):
    df, pdf = faint
    folds = X.assign_folds(df, ["C_subject_key"], 5, 1, 42).toPandas()
    got = E.learning_curve(df, ["x"], (1.0,), 5, 1, 42).collect()
    assert len(got) == 5
    for r in got:
        train, test = folds[folds.fold != r["fold"]], folds[folds.fold == r["fold"]]
        for name, part in (("auroc_train", train), ("auroc_test", test)):
            assert r[name] == pytest.approx(brute_auroc(part.label.to_numpy(), log_odds(train, part.x)), abs=1e-9)


def test_optimism_equals_fits_one_by_one(spark, faint):
    df, _ = faint
    arms = ["C_subject_key", "A_recording"]
    folds = X.assign_folds(df, arms, 5, 2, 42).toPandas()
    got = E.optimism(df, arms, ["x"], 5, 2, 42).collect()
    assert len(got) == 2 * 2 * 5 * 2
    for r in got:
        here = folds[(folds.arm == r["arm"]) & (folds.repeat == r["repeat"])]
        train = here[here.fold != r["fold"]]
        part = train if r["side"] == "train" else here[here.fold == r["fold"]]
        assert r["auroc"] == pytest.approx(brute_auroc(part.label.to_numpy(), log_odds(train, part.x)), abs=1e-9)


def test_optimism_makes_no_row_per_model(spark, faint):
    df, _ = faint
    plan = E.optimism(df, ["C_subject_key"], ["x"], 5, 2, 42)._jdf.queryExecution().optimizedPlan().toString()
    assert "_range" in plan and "model_fold" not in plan
