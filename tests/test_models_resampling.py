"""Permutation nulls, the multinomial tree, many regressions and many forests against plain versions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.functions import draws as D
from plumbline.operators import boosting as BO
from plumbline.operators import forest as FO
from plumbline.operators import permute as P
from plumbline.operators import regression as RG
from plumbline.operators import resample as R
from plumbline.operators import scorer as S


def brute_auroc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])).mean())


# -- permutations -------------------------------------------------------------------------


@pytest.mark.parametrize("n, n_pos", [(5000, 1234), (40, 17), (10, 10), (10, 0)])
def test_cut_is_the_last_positive(spark, n, n_pos):
    units = np.arange(n) * 7 + 3
    df = spark.createDataFrame(pd.DataFrame({"unit": units})).repartition(6)
    cut, cut_unit = P.permutation_cuts(df, n_pos, 20, 42)
    labels = P.labels_np(42, units, cut, cut_unit)
    for p in range(20):
        order = sorted(range(n), key=lambda i: (int(D.draw_np(42, p, units[i])), units[i]))
        want = np.zeros(n, bool)
        want[order[:n_pos]] = True
        assert (labels[p] == want).all()


def test_null_equals_refits_one_by_one(spark):
    rng = np.random.default_rng(3)
    rec = pd.DataFrame({"subject_id": np.repeat(np.arange(60), 3), "a": rng.normal(1e4, 1, 180), "b": rng.normal(0, 1, 180)})
    rec["label"] = (rec.subject_id % 3 == 0).astype(int)
    rec.loc[rec.label == 1, "b"] += 1
    parts = []
    for arm, fold in (("one", rec.subject_id % 4), ("two", pd.Series(rng.integers(0, 4, 180)))):
        parts.append(rec.assign(arm=arm, fold=np.asarray(fold)))
    folds = pd.concat(parts)
    base = S.moments(spark.createDataFrame(folds), ["arm", "subject_id", "fold"], ["a", "b"])
    got = P.permutation_null(base, ["one", "two"], ["a", "b"], 20, 6, 4, 42, F.col("subject_id")).collect()
    assert len(got) == 12
    units = np.arange(60)
    for r in got:
        y_unit = np.zeros(60, int)
        y_unit[np.lexsort((units, D.draw_np(42, r["perm"], units)))[:20]] = 1
        f = folds[folds.arm == r["arm"]].copy()
        f["y"] = y_unit[f.subject_id]
        score = np.zeros(len(f))
        for k in range(4):
            train, test = f[f.fold != k], (f.fold == k).to_numpy()
            s = np.full(test.sum(), np.log((train.y == 1).sum()) - np.log((train.y == 0).sum()))
            for c in "ab":
                for y, sign in ((1, -1), (0, 1)):
                    v = train[train.y == y][c]
                    var = v.var(ddof=0) + S.FLOOR
                    s = s + sign * (np.log(var) + (f[c][test] - v.mean()) ** 2 / var) / 2
            score[test] = s
        people = pd.Series(score).groupby(f.subject_id.to_numpy()).mean()
        assert r["auroc"] == pytest.approx(brute_auroc(y_unit, np.floor(people.to_numpy() * P.LEVELS)), abs=1e-9)


# -- draws with replacement -----------------------------------------------------------------


def test_tree_deals_n_draws_and_goes_on_where_it_stopped():
    n, draws = 5000, np.arange(8)
    root = np.full((8, 1), n)
    depth = int(R.tree_depth(n, R.LEAF_DRAWS))
    whole, first = R._descend(7, draws, root, 0, 0, depth, (0.0, 1.0))
    assert first == 0 and whole.shape == (8, 1 << depth) and (whole.sum(axis=1) == n).all()
    upper, _ = R._descend(7, draws, root, 0, 0, 3, (0.0, 1.0))
    part, at = R._descend(7, draws, upper[:, 2:4], 2, 3, depth, (0.3, 0.45))
    assert (part == whole[:, at:at + part.shape[1]]).all()
    assert at <= 0.3 * (1 << depth) and at + part.shape[1] >= 0.45 * (1 << depth)
    assert abs(whole.mean() - n / (1 << depth)) < 1e-9 and 0.5 < whole.var() / whole.mean() < 1.5


def test_multinomial_weights_in_both_plans(spark, plan):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": ["a"] * 300 + ["b"] * 20, "subject_id": np.arange(320), "label": rng.integers(0, 2, 320), "score": rng.integers(0, 90, 320) / 8.0})
    got = {(r["k"], r["draw"]): r["auroc"] for r in R.multinomial_draws(spark.createDataFrame(pdf), ["k"], "subject_id", 5, 42).collect()}
    assert len(got) == 10
    for k, g in pdf.groupby("k"):
        g = g.sort_values(["score", "subject_id"])
        n, depth = len(g), int(R.tree_depth(len(g), R.LEAF_DRAWS))
        leaves, _ = R._descend(42, np.arange(5), np.full((5, 1), n), 0, 0, depth, (0.0, 1.0))
        for d in range(5):
            pick = []
            for leaf, count in enumerate(leaves[d]):
                u = D.draw_np(43, d, (1 << depth) + leaf, np.arange(count))
                pick += list(((leaf + (u + 0.5) / D.PRIME) / (1 << depth) * n).astype(int))
            assert len(pick) == n
            y, s = g.label.to_numpy()[pick], g.score.to_numpy()[pick]
            assert got[k, d] == pytest.approx(brute_auroc(y, s))


# -- regressions ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (240, 5)) * [1, 10, 0.1, 3, 1] + [0, 100, 5, 0, 0]
    x[:, 4] = 2.0  # constant
    y = (rng.random(240) < 1 / (1 + np.exp(-(x[:, 0] + (x[:, 1] - 100) / 10)))).astype(int)
    pdf = pd.DataFrame({"recording_id": np.arange(240), "subject_id": np.arange(240) // 2 * 2 + y, "corpus": np.arange(240) % 2, "label": y, "x": list(x)})
    return spark.createDataFrame(pdf).withColumn("x", F.col("x").cast("array<double>")), pdf


def penalised_loss(beta, z, y, fit):
    eta = beta[0] + z @ beta[1:]
    return np.logaddexp(0, eta).sum() - y @ eta + fit.ridge / 2 * (beta[1:] ** 2).sum() + fit.lasso * np.abs(beta[1:]).sum()


def test_every_fit_is_at_its_own_optimum(table):
    df, pdf = table
    rows = RG.with_fold_roles(df, k=3, n_repeats=2)
    fits = [RG.Fit(r, f, c, share) for r in range(2) for f in (0, 2) for c, share in ((0.1, 0.0), (10.0, 0.0), (0.2, 0.7))]
    models, centre = RG.fit_all(rows, fits, 5)
    roles = np.stack(rows.orderBy("recording_id").toPandas().roles)
    x, y = np.stack(pdf.x), pdf.label.to_numpy()
    for m in models:
        at = roles[:, m.fit.outer] != m.fit.fold
        assert m.n_train == at.sum() and m.n_pos == y[at].sum() and m.residual <= RG.TOLERANCE
        sd = np.where(x[at].std(axis=0) > 1e-12, x[at].std(axis=0), 1.0)
        z = (x[at] - x[at].mean(axis=0)) / sd
        beta = np.r_[0.0, m.weights[1:] * sd]
        beta[0] = m.weights[0] + (x[at].mean(axis=0) - centre) @ m.weights[1:]
        best = penalised_loss(beta, z, y[at], m.fit)
        rng = np.random.default_rng(1)
        for scale in (1e-1, 1e-3, 1e-5):
            for _ in range(30):
                assert penalised_loss(beta + rng.normal(0, scale, 6), z, y[at], m.fit) >= best - 1e-7
    assert any((m.weights[1:] == 0).any() for m in models if m.fit.lasso)


def test_scores_come_from_the_fit_without_the_row(table):
    df, pdf = table
    scored, models = RG.cross_validated(RG.with_fold_roles(df, k=3, n_repeats=2), 5, 0.5, k=3, n_repeats=2)
    out = scored.toPandas()
    assert len(out) == 480 and out.groupby("outer").recording_id.nunique().tolist() == [240, 240]
    assert len(models) == 6 and brute_auroc(out.label.to_numpy(), out.score.to_numpy()) > 0.7


def test_nested_search_uses_the_smallest_inner_loss(table):
    df, _ = table
    grids = {"ridge": [(0.001, 0.0), (1.0, 0.0)], "net": [(0.5, 0.5)]}
    rows = RG.with_corpus_roles(df, [0, 1], 3)
    roles = rows.select("corpus", "roles").toPandas()
    assert all(r.roles[r.corpus] == RG.HELD_OUT and r.roles[1 - r.corpus] in (0, 1, 2) for r in roles.itertuples())
    scored, told = RG.nested_search(rows, 5, grids, 2)
    assert len(told) == 6 and all(t[-1] <= RG.TOLERANCE for t in told)
    for o in range(2):
        ridge = [t for t in told if t[0] == "ridge" and t[1] == o]
        assert [t[5] for t in ridge] == [t[4] == min(r[4] for r in ridge) for t in ridge]
    out = scored.toPandas()
    assert (out.outer == out.corpus).all() and out.groupby("model").size().to_dict() == {"net": 240, "ridge": 240}


# -- forests --------------------------------------------------------------------------------


def test_level_passes_and_local_growth_make_the_same_trees(table):
    df, _ = table
    data, cuts = FO.prepared(RG.with_fold_roles(df, k=3, n_repeats=1), 5)
    forests = [FO.Forest(0, 0, 4, 6, 1), FO.Forest(0, None, 3, 3, 4)]
    one, two, three = (FO.grow(data, cuts, forests, 42, n) for n in (1 << 14, 0, 60))
    for other in (two, three):
        for name in ("tree", "node", "feature", "bin"):
            assert (getattr(one, name) == getattr(other, name)).all()
        assert np.allclose(one.share, other.share)
    assert set(one.tree) == set(range(7)) and one.node.max() < 1 << 7


def test_branches_come_back_packed_and_not_node_by_node(table, monkeypatch):
    df, _ = table
    data, cuts = FO.prepared(RG.with_fold_roles(df, k=3, n_repeats=1), 5)
    collected, per_node = [], FO._per_node
    monkeypatch.setattr(FO, "_per_node", lambda pieces, way: collected.append(per_node(pieces, way)) or collected[-1])
    trees = FO.grow(data, cuts, [FO.Forest(0, 0, 4, 6, 1)], 42)
    assert len(collected) == 1 and len(collected[0]) == 4
    assert sum(len(r["nodes"]) for r in collected[0]) == FO.NODES.itemsize * len(trees.node) > 4 * FO.NODES.itemsize


def test_root_split_is_the_best_of_its_candidates(table):
    df, pdf = table
    data, cuts = FO.prepared(df.withColumn("roles", F.array(F.lit(0))), 5)
    trees = FO.grow(data, cuts, [FO.Forest(0, None, 5, 1)], 42)
    x, y = np.stack(pdf.x), pdf.label.to_numpy()
    assert np.allclose(cuts[0], np.quantile(x[:, 0], np.arange(1, 32) / 32))
    for t in range(5):
        w = D.poisson_np(42, t, pdf.recording_id.to_numpy())
        best = (np.inf, None)
        for f in FO.candidates(42, t, 1, 5, 2):
            for b in range(31):
                left = x[:, f] <= cuts[f, b]
                impurity = 0.0
                for side in (left, ~left):
                    n, n1 = w[side].sum(), (w * y)[side].sum()
                    impurity += 2 * n1 * (n - n1) / n if n else np.inf
                best = min(best, (round(impurity, 9), (f, b)))
        at = trees.first[t]
        assert (trees.feature[at], trees.bin[at]) == best[1]


def test_out_of_bag_error_counts_only_rows_out_of_the_bag(table):
    df, pdf = table
    got = FO.out_of_bag_error(df, 5, [1, 5, 30], 42, max_depth=4).collect()
    out = np.stack([D.poisson_np(42, t, pdf.recording_id.to_numpy()) == 0 for t in range(30)])
    assert [(r["n_scored"], r["n_votes"]) for r in got] == [(int(out[:s].any(axis=0).sum()), int(out[:s].sum())) for s in (1, 5, 30)]
    assert got[-1]["oob_error"] < 0.45


# -- boosting -------------------------------------------------------------------------------


def test_boosting_in_one_task_and_by_passes_makes_the_same_trees(table):
    df, pdf = table
    data, _ = FO.prepared(RG.with_fold_roles(df, k=3, n_repeats=1), 5)
    fits = [BO.Boost(0, 0, 2, 0.1, 0.1, 4), BO.Boost(0, None, 3, 1.0, 0.3, 3)]
    one, two = BO.fit_all(data, 5, fits), BO.fit_all(data, 5, fits, 0)
    for a, b in zip(one, two):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)
        assert (a.feature[:, 1] >= 0).all()


def test_kept_margins_change_no_tree_and_histograms_stay_with_the_reducers(table, monkeypatch):
    df, _ = table
    data, _ = FO.prepared(RG.with_fold_roles(df, k=3, n_repeats=1), 5)
    fits, sizes, summed = [BO.Boost(0, 0, 2, 0.1, 0.1, 5), BO.Boost(0, None, 1, 1.0, 0.3, 2)], [], BO.summed
    monkeypatch.setattr(BO, "summed", lambda df, kernel, size: sizes.append(size) or summed(df, kernel, size))
    one = BO.fit_all(data, 5, fits, 0)
    monkeypatch.setattr(BO, "KEPT_ROUNDS", 2)
    two = BO.fit_all(data, 5, fits, 0)
    for a, b in zip(one, two):
        assert (a.feature == b.feature).all() and (a.bin == b.bin).all() and np.allclose(a.value, b.value)
    # Rows per training set are all that the driver adds up.
    assert sizes == [2, 2]


def test_each_round_lowers_the_loss_and_a_stump_is_the_best_one(table):
    df, pdf = table
    data, cuts = FO.prepared(df.withColumn("roles", F.array(F.lit(0))), 5)
    model = BO.fit_all(data, 5, [BO.Boost(0, None, 1, 0.0, 0.5, 20)])[0]
    x, y = np.stack(pdf.x), pdf.label.to_numpy()
    bins = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    loss = [np.logaddexp(0, -(2 * y - 1) * model.margin(bins, r)).mean() for r in range(21)]
    assert all(b < a for a, b in zip(loss, loss[1:]))
    g = 0.5 - y
    best = -1.0
    for f in range(5):
        for b in range(31):
            left = bins[:, f] <= b
            if 0 < left.sum() < len(y):
                gain = sum(g[s].sum() ** 2 / (0.25 * s.sum() + BO.RIDGE) for s in (left, ~left)) - g.sum() ** 2 / (0.25 * len(y) + BO.RIDGE)
                best = max(best, gain)
    left = bins[:, model.feature[0, 1]] <= model.bin[0, 1]
    found = sum(g[s].sum() ** 2 / (0.25 * s.sum() + BO.RIDGE) for s in (left, ~left)) - g.sum() ** 2 / (0.25 * len(y) + BO.RIDGE)
    assert found == pytest.approx(best)
    assert model.value[0, 2] == pytest.approx(-0.5 * g[left].sum() / (0.25 * left.sum() + BO.RIDGE))


def test_poisson_kernel_equals_pair_counts_by_hand():
    """Ties longer than a run, single classes and every draw; few bytes held whatever the range's length."""
    import tracemalloc

    rng = np.random.default_rng(4)
    for places, n in ((0, 3000), (1, 700), (6, 700)):
        pdf = pd.DataFrame({"unit": rng.integers(0, 10**12, n), "label": rng.integers(0, 2, n), "score": rng.normal(size=n).round(places)})
        got = R._poisson_kernel([], 40, 5, 42)(pdf.assign(_range=3, _block=2))
        assert got.draw.tolist() == list(range(2, 40, 5)) and (got._range == 3).all()
        s, y = pdf.score.to_numpy(), pdf.label.to_numpy() == 1
        wins = (s[y][:, None] > s[~y]) + (s[y][:, None] == s[~y]) / 2
        for r in got.itertuples(index=False):
            w = D.poisson_np(42, r[1], pdf.unit.to_numpy())
            assert (r[2], r[3], r[4]) == (w[y].sum(), w[~y].sum(), w[y] @ wins @ w[~y])
    n = 200_000
    pdf = pd.DataFrame({"unit": np.arange(n), "label": np.arange(n) % 2, "score": rng.normal(size=n), "_range": 0, "_block": 0})
    tracemalloc.start()
    R._poisson_kernel([], 20, 1, 42)(pdf)
    assert tracemalloc.get_traced_memory()[1] < 24_000_000
    tracemalloc.stop()
