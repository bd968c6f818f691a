"""Tests, associations, ANOVA and regression against independent arithmetic."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statspark.functions import dist
from statspark.operators import anova as V
from statspark.operators import association as A
from statspark.operators import hypothesis as H
from statspark.operators import profile as P
from statspark.operators import regression as G
from statspark.operators import sampling as M


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(11)
    n = 600
    y = rng.choice(["neg", "pos"], n, p=[0.6, 0.4])
    f = rng.choice(["p", "q", "r"], n)
    x = rng.normal(10, 2, n) + (y == "pos") * 0.5
    z = np.round(rng.exponential(3, n), 1)
    return pd.DataFrame({"k": range(n), "y": y, "f": f, "x": x, "z": z})


@pytest.fixture(scope="module")
def df(spark, pdf):
    return spark.createDataFrame(pdf)


def test_two_sample_t_equals_one_way_f(df):
    t = H.student_t(H.two_group_moments(df, ["x"], "y", "neg", "pos")).first()
    f = V.one_way(df, ["y"], ["x"]).first()
    assert t["statistic"] ** 2 == pytest.approx(f["f"])
    assert t["p_value"] == pytest.approx(f["p_value"])


def test_mann_whitney_sides(df, pdf):
    a = H.mann_whitney(df, ["z"], "y", "neg", "pos").first()
    b = H.mann_whitney(df, ["z"], "y", "pos", "neg").first()
    n1, n2 = (pdf.y == "neg").sum(), (pdf.y == "pos").sum()
    assert a["statistic"] + b["statistic"] == n1 * n2
    assert a["p_value"] == pytest.approx(b["p_value"])
    lo, hi = pdf.z[pdf.y == "neg"].to_numpy(), pdf.z[pdf.y == "pos"].to_numpy()
    wins = (lo[:, None] > hi[None, :]).sum() + 0.5 * (lo[:, None] == hi[None, :]).sum()
    assert a["statistic"] == wins


def test_levene_against_direct(df, pdf):
    got = H.levene(df, ["x"], "y", "neg", "pos").first()["statistic"]
    zs = [np.abs(g - g.median()) for _, g in pdf.groupby("y")["x"]]
    n, grand = len(pdf), np.concatenate(zs).mean()
    between = sum(len(z) * (z.mean() - grand) ** 2 for z in zs)
    within = sum(((z - z.mean()) ** 2).sum() for z in zs)
    assert got == pytest.approx((n - 2) * between / within)


def test_chooser_reports_one_test_per_column(df):
    rows = {r["feature"]: r for r in H.choose_tests(df, ["x", "z"], ["k"], "y", "neg", "pos").collect()}
    assert rows["z"]["test"] == "Mann-Whitney U test"
    assert rows["x"]["test"] in ("Student's t-test", "Welch's t-test")


def test_constant_and_tiny_columns(spark):
    df = spark.createDataFrame(
        [(i, "ab"[i % 2], 1.0, None if i else 2.0) for i in range(6)], "k long, g string, c double, tiny double"
    )
    assert H.welch_t(H.two_group_moments(df, ["c", "tiny"], "g", "a", "b")).collect()[0]["p_value"] is None
    m = H.mann_whitney(df, ["c"], "g", "a", "b").first()
    assert (m["statistic"], m["z"], m["p_value"]) == (4.5, None, 1.0)
    assert [r["feature"] for r in H.two_group_moments(df, ["c", "tiny"], "g", "a", "b").collect()] == ["c"]
    assert A.outcome_correlations(df, ["c"], "g", "a").first()["r"] is None


def test_ks_matches_direct(df, pdf):
    got = H.ks_normal(df, ["x"]).first()
    x = np.sort(pdf.x.to_numpy())
    cdf = dist.norm_cdf_array((x - x.mean()) / x.std())
    n = len(x)
    want = max((np.arange(1, n + 1) / n - cdf).max(), (cdf - np.arange(n) / n).max())
    assert got["ks_d"] == pytest.approx(want)


def test_ks_matrix_and_series_meet():
    exact = 1 - dist._ks_matrix(0.05, 400)
    assert dist.ks_two_sided(0.05, 400) == pytest.approx(exact, rel=1e-9)
    assert dist.ks_two_sided(0.0265, 2900) == pytest.approx(1 - dist._ks_matrix(0.0265, 2900), rel=2e-3)


def test_ks_sum_and_expansion_meet(monkeypatch):
    exact = [dist.ks_two_sided(d, 100_000) for d in (0.0048, 0.006, 0.01)]
    monkeypatch.setattr(dist, "KS_SUM", 1000)
    assert [dist.ks_two_sided(d, 100_000) for d in (0.0048, 0.006, 0.01)] == pytest.approx(exact, rel=1e-6)
    assert 0 < dist.ks_two_sided(1e-5, 10**12) < 1e-80


def test_normal_cdf_column(spark):
    z = [-40.0, -9.0, -7.07, -3.1, -0.4, 0.0, 0.2, 2.5, 7.5, 40.0]
    got = spark.createDataFrame([(v,) for v in z], "z double").select("z", dist.norm_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        want = 0.5 * math.erfc(-r["z"] / math.sqrt(2))
        assert r["p"] == pytest.approx(want, rel=1e-7 if r["z"] < -5 else 1e-13, abs=1e-300)
    assert spark.range(1).select(dist.norm_cdf(F.lit(float("nan")))).first()[0] is None


def test_normality_reads_all_rows(spark):
    df = spark.range(12_000).select("id", ((F.xxhash64("id") % 1000) / 10).alias("x"))
    r = H.normality_table(df, ["x"], ["id"]).first()
    assert (r["n_sample"], r["n_total"]) == (5000, 12_000)
    assert r["ks_d"] == pytest.approx(H.ks_normal(df, ["x"]).first()["ks_d"])


def test_tail_functions():
    assert dist.chi2_tail([3.0], [2.0])[0] == pytest.approx(math.exp(-1.5))
    assert dist.t_two_sided([1.0], [1.0])[0] == pytest.approx(0.5)
    assert dist.f_tail([1.0], [7.0], [7.0])[0] == pytest.approx(0.5)
    assert dist.chi2_tail([0.0, 5000.0], [1.0, 3.0])[0] == 1.0
    assert dist.fisher_two_sided(8, 2, 1, 5) == pytest.approx(0.03496503496503495)


# --- contingency ------------------------------------------------------------


def crossed(spark, table):
    rows = [(chr(97 + i), f"o{j}", int(n)) for i, r in enumerate(table) for j, n in enumerate(r)]
    return spark.createDataFrame([r for r in rows if r[2]], "f string, y string, n long")


def direct_chi2(table):
    t = np.array(table, float)
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    gap = np.abs(t - e)
    if t.shape == (2, 2):
        gap = gap - np.minimum(0.5, gap)
    return (gap**2 / e).sum()


@pytest.mark.parametrize(
    "table", [[[12, 5], [3, 9]], [[0, 7], [6, 2]], [[5, 0, 3], [2, 8, 0]], [[1, 2], [3, 4], [0, 9]], [[10, 10], [10, 10]]]
)
def test_chi_square(spark, table):
    got = A.association_scan(crossed(spark, table), ["f"], "y", "n").first()
    assert got["chi2"] == pytest.approx(direct_chi2(table), abs=1e-9)


def test_single_level_factor(spark):
    got = A.association_scan(crossed(spark, [[4, 6]]), ["f"], "y", "n").first()
    assert (got["chi2"], got["dof"], got["p_value"], got["cramers_v"]) == (0.0, 0, 1.0, None)


def test_odds_ratio_swaps_and_zero_cells(spark):
    src = crossed(spark, [[12, 5], [3, 9]])
    r = {x["level"]: x for x in A.risk_table(src, ["f"], "y", "o0", "n").collect()}
    assert r["a"]["odds_ratio"] == pytest.approx(1 / r["b"]["odds_ratio"])
    zero = {x["level"]: x for x in A.risk_table(crossed(spark, [[0, 7], [6, 2]]), ["f"], "y", "o0", "n").collect()}
    assert zero["a"]["odds_ratio"] == 0.0 and zero["a"]["ci_lower"] is None
    assert zero["b"]["risk_ratio"] is None and zero["b"]["odds_ratio"] is None
    assert zero["a"]["test"] == "Fisher's exact test"
    assert zero["a"]["p_value"] == pytest.approx(dist.fisher_two_sided(0, 7, 6, 2))


def test_missing_level_counts_as_unexposed(spark):
    src = spark.createDataFrame(
        [("Yes", 1), ("Yes", 0), ("No", 0), (None, 1), (None, 0), (None, 1)], "f string, y int"
    )
    r = {x["level"]: x for x in A.risk_table(src, ["f"], "y", 1).collect()}
    assert set(r) == {"Yes", "No"}
    assert r["Yes"]["risk_unexposed"] == pytest.approx(2 / 4)


def test_spearman_with_gaps(spark, pdf):
    gappy = pdf[["x", "z", "k"]].copy().astype(float)
    gappy.loc[::7, "x"] = np.nan
    got = {
        (r["feature_1"], r["feature_2"]): r["r"]
        for r in A.spearman_pairs(spark.createDataFrame(gappy), ["x", "z", "k"]).collect()
    }
    want = gappy.corr("spearman")
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b])


# --- ANOVA and regression ---------------------------------------------------


def rss(design, y):
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    return ((y - design @ beta) ** 2).sum()


def test_two_way_against_nested_fits(df, pdf):
    got = V.two_way(df, ["f"], ["x"], "y", "pos").first()
    a = pd.get_dummies(pdf.f).to_numpy(float)
    b = pd.get_dummies(pdf.y).to_numpy(float)
    full = np.column_stack([a[:, i] * b[:, j] for i in range(3) for j in range(2)])
    ra, rb, rab, rf = (rss(m, pdf.x.to_numpy()) for m in (a, b, np.hstack([a, b]), full))
    scale = rf / (len(pdf) - 6)
    assert got["f_factor"] == pytest.approx((rb - rab) / 2 / scale)
    assert got["f_outcome"] == pytest.approx((ra - rab) / scale)
    assert got["f_inter"] == pytest.approx((rab - rf) / 2 / scale)


def test_hc3_against_numpy(df, pdf):
    coef, fit = G.ols_hc3(df.withColumn("w", F.col("k") / 100), ["x", "w"], "z")
    x = np.column_stack([np.ones(len(pdf)), pdf.x, pdf.k / 100])
    y = pdf.z.to_numpy()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    cov = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    rows = {r["term"]: r for r in coef.collect()}
    for i, t in enumerate(("const", "x", "w")):
        assert rows[t]["coef"] == pytest.approx(beta[i])
        assert rows[t]["std_err"] == pytest.approx(math.sqrt(cov[i, i]))
    n, r2 = len(y), 1 - (e @ e) / ((y - y.mean()) ** 2).sum()
    m = fit.first()
    loglik = -n / 2 * (math.log(2 * math.pi * (e @ e) / n) + 1)
    assert (m["r2"], m["aic"]) == pytest.approx((r2, 6 - 2 * loglik))


def test_logistic_against_newton(df, pdf):
    got = {r["term"]: r for r in G.logistic_inference(df.withColumn("flat", F.lit(1.0)), ["x", "flat"], ["f"], "y", "pos").collect()}
    assert set(got) == {"x", "f_q", "f_r", "const"}  # constants and the first level are left out
    x = np.column_stack([pdf.x, pdf.f == "q", pdf.f == "r", np.ones(len(pdf))]).astype(float)
    y = (pdf.y == "pos").to_numpy(float)
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        cov = np.linalg.inv((x.T * (p * (1 - p))) @ x)
        beta = beta + cov @ x.T @ (y - p)
    for i, t in enumerate(("x", "f_q", "f_r", "const")):
        assert got[t]["coef"] == pytest.approx(beta[i], abs=1e-6)
        assert got[t]["std_err"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-4)


# --- sampling ---------------------------------------------------------------


def test_split_and_sample_do_not_depend_on_layout(spark):
    src = spark.range(2000)
    seen = set()
    for parts in (1, 7, 32):
        train, test = M.train_test_split(src.repartition(parts), ["id"])
        keys = tuple(sorted(r["id"] for r in test.collect()))
        assert train.count() + len(keys) == 2000
        sample = tuple(sorted(r["id"] for r in M.fixed_sample(src.repartition(parts), ["id"], 50).collect()))
        seen.add((keys, sample))
    assert len(seen) == 1


def test_strata_are_exact(spark):
    src = spark.range(1000).withColumn("s", F.when(F.col("id") % 10 == 0, "rare").otherwise("hot"))
    got = M.stratified_flags(src, ["id"], "s").groupBy("s").agg(F.count_if("is_test").alias("n")).collect()
    assert {r["s"]: r["n"] for r in got} == {"rare": 20, "hot": 180}


def test_samples_of_all_columns_at_once(spark):
    """Equal to a sorted sample of each column and group; columns with few values, NaN and none; any layout."""
    df = spark.range(3000).selectExpr(
        "id", "IF(id % 10 = 0, 'a', IF(id % 50 = 1, 'b', NULL)) AS g", "CAST(id AS DOUBLE) AS x",
        "IF(id % 100 = 0, CAST(id AS FLOAT), CAST('NaN' AS FLOAT)) AS few", "CAST(NULL AS DOUBLE) AS none",
    )
    for n in (1, 40, 5000):
        want = set()
        for c in ("x", "few"):
            for g in ("a", "b"):
                rows = df.where((F.col("g") == g) & ~F.isnan(c)).select("id", F.col(c).cast("double").alias("v"))
                want |= {(c, g, r["v"]) for r in M.fixed_sample(rows, ["id"], n).collect()}
        for parts in (1, 9):
            got = H.column_samples(df.repartition(parts), ["x", "few", "none"], ["id"], n, group="g", group_levels=["a", "b"]).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want
    whole = H.column_samples(df, ["x"], ["id"], 70).collect()
    assert {r["value"] for r in whole} == {float(r["id"]) for r in M.fixed_sample(df, ["id"], 70).collect()} and len(whole) == 70
    assert H.column_samples(df.limit(0), ["x", "few"], ["id"], 70).count() == 0


def test_nan_is_missing_everywhere(spark):
    rows = [(1.0, 2.0), (2.0, 4.5), (3.0, 5.0), (float("nan"), 9.0), (4.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    r = A.pearson_pairs(df, ["a", "b"], True).where("feature_1 = 'a' and feature_2 = 'b'").first()
    assert r["n"] == 3 and r["r"] == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.5, 5])[0, 1])
    assert {x["feature"]: x["n_missing"] for x in P.missing_report(df).collect()} == {"a": 1, "b": 1}
    got = {x["feature"]: (x["n"], x["mean"], x["max"]) for x in P.numeric_summary(df, ["a", "b"]).collect()}
    assert got == {"a": (4, 2.5, 4.0), "b": (4, 5.125, 9.0)}
