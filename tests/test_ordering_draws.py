import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import draws as D
from plumbline.operators import ordering as O
from plumbline.session import is_small, materialise


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds more than a third of the rows; values are full of ties."""
    n = 6000
    return materialise(spark.range(n).select(
        F.when(F.col("id") % 5 < 2, 0).otherwise(F.col("id") % 50).alias("k"),
        (D.draw(3, F.col("id")) % 97).cast("double").alias("v"), "id",
    ))


def test_draws_agree_in_all_spellings(spark):
    ids = [0, 1, 2**31, 2**33 + 5, 987654321]
    rows = spark.createDataFrame([(i,) for i in ids], "i bigint").select(
        "i", D.draw(7, 2, F.col("i")).alias("d"), D.poisson(7, 2, F.col("i")).alias("w"), D.normal(7, F.col("i")).alias("z")
    ).collect()
    sql = duckdb.sql(f"SELECT i, {D.draw_sql(7, 2, 'i')}, {D.poisson_sql(7, 2, 'i')}, {D.normal_sql(7, 'i')} FROM (SELECT unnest({ids}) AS i)").fetchall()
    want = {r[0]: r[1:] for r in sql}
    for r in rows:
        assert r["d"] == want[r["i"]][0] == int(D.draw_np(7, 2, [r["i"]])[0])
        assert r["w"] == want[r["i"]][1] == int(D.poisson_np(7, 2, [r["i"]])[0])
        assert r["z"] == pytest.approx(want[r["i"]][2])


def test_draws_look_random():
    ids = np.arange(20000)
    u = np.stack([D.draw_np(1, d, ids) / D.PRIME for d in range(20)])
    counts = np.apply_along_axis(lambda x: np.histogram(x, 20, (0, 1))[0], 1, u)
    chi = ((counts - 1000) ** 2 / 1000).sum(axis=1)
    assert chi.mean() == pytest.approx(19, abs=5) and chi.max() < 60
    corr = np.corrcoef(u)
    assert np.abs(corr[np.triu_indices(20, 1)]).max() < 0.04
    assert abs(np.corrcoef(u[0][:-1], u[0][1:])[0, 1]) < 0.03
    w = D.poisson_np(1, 5, ids)
    assert w.mean() == pytest.approx(1, abs=0.03) and w.var() == pytest.approx(1, abs=0.05)


def test_running_totals_on_a_hot_key(spark, skewed, plan):
    got = O.running_totals(skewed, ["k"], "v", {"n": F.count(F.lit(1))}, descending=True).toPandas()
    pdf = skewed.toPandas()
    for k, g in pdf.groupby("k"):
        want = g.groupby("v").size().sort_index(ascending=False).cumsum()
        have = got[got.k == k].set_index("v").cum_n.sort_index(ascending=False)
        assert have.to_dict() == want.to_dict()


def test_dense_position_and_rank(spark, skewed, plan):
    pdf = skewed.toPandas().sort_values(["k", "v", "id"])
    pdf["want"] = pdf.groupby("k").cumcount() + 1
    got = O.dense_position(skewed, ["k"], ["v", "id"]).toPandas().set_index("id").position
    assert got.to_dict() == pdf.set_index("id").want.to_dict()
    hashed = skewed.withColumn("u", D.draw(9, F.col("id")))
    h = O.dense_position(hashed, ["k"], ["u", "id"], hashed=True).toPandas().sort_values(["k", "u", "id"])
    assert (h.position == h.groupby("k").cumcount() + 1).all()
    ranks = O.average_rank(skewed, ["k"], "v").toPandas()
    pdf["r"] = pdf.groupby("k").v.rank()
    want = pdf.groupby(["k", "v"]).r.first()
    assert ranks.set_index(["k", "v"]).avg_rank.sort_index().to_dict() == want.to_dict()


def test_exact_quantiles(spark, skewed, plan):
    got = O.exact_quantiles(skewed, ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0]).toPandas().set_index("k")
    for k, g in skewed.toPandas().groupby("k"):
        assert got.loc[k].tolist() == pytest.approx(np.quantile(g.v, [0.0, 0.25, 0.5, 0.9, 1.0]).tolist())


def test_null_keys_survive_both_plans(spark, plan):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 3.0)], "k string, v double")
    got = {(r["k"], r["v"]): r["position"] for r in O.dense_position(df, ["k"], ["v"]).collect()}
    assert got == {(None, 1.0): 1, (None, 2.0): 2, ("a", 3.0): 1}


def test_neighbours_cross_chunk_borders(spark):
    df = spark.range(1000).select(F.lit(1).alias("k"), F.col("id").alias("pos"), (F.col("id") * 10).alias("x"))
    got = O.neighbours(df, ["k"], "pos", "x", [-4, 1], chunk=16).toPandas().set_index("pos")
    assert len(got) == 1000
    assert all(got.v_m4[p] == (p - 4) * 10 for p in range(4, 1000))
    assert all(got.v_1[p] == (p + 1) * 10 for p in range(999))
    assert got.v_m4[:4].isna().all() and np.isnan(got.v_1[999])


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_do_not_depend_on_partitioning(spark, skewed, parts):
    from plumbline.operators import splits as X

    df = skewed.select(F.col("id").alias("recording_id"), F.col("k").alias("subject_id"), (F.col("k") % 2).cast("int").alias("label"))
    ref = {tuple(r) for r in X.assign_folds(df, ["A_recording", "C_subject_key"], 5, 2).collect()}
    assert {tuple(r) for r in X.assign_folds(df.repartition(parts), ["A_recording", "C_subject_key"], 5, 2).collect()} == ref


def test_null_nan_and_ties_agree_in_both_plans(spark, plan):
    """NULL sorts first, NaN last, whichever plan the size of the input chooses."""
    values = [None, 3.0, float("nan"), 1.0, 3.0, None, -2.0, float("nan"), 7.5] * 3
    rows = spark.createDataFrame([("k" if i % 4 else None, v) for i, v in enumerate(values)], "key string, v double")
    assert is_small(rows) == (plan == "small")
    for descending in (False, True):
        got = O.running_totals(rows, ["key"], "v", {"n": F.count(F.lit(1))}, descending=descending).collect()
        for key in (None, "k"):
            own = [v for i, v in enumerate(values) if ("k" if i % 4 else None) == key]
            rank = lambda v: (0, 0.0) if v is None else ((2, 0.0) if v != v else (1, v))
            expected, total = [], 0
            for r in sorted({rank(v) for v in own}, reverse=descending):
                total += sum(rank(v) == r for v in own)
                expected.append((r, total))
            found = [(rank(r["v"]), r["cum_n"]) for r in got if r["key"] == key]
            assert sorted(found) == sorted(expected)
