"""Feature engineering, models, evaluation and persistence."""

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from statspark.functions import scalars as S
from statspark.operators import chartdata as C
from statspark.operators import features as X
from statspark.operators import fits
from statspark.operators import models as M
from statspark.operators import profile as P
from statspark.plans import analyses
from statspark.session import scratch_dir
from statspark.sources import models as store
from statspark.sources import tables as IO


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(5)
    n = 800
    x = rng.normal(0, 1, n)
    f = rng.choice(["a", "b", "c"], n)
    y = np.where(x + (f == "a") + rng.normal(0, 0.7, n) > 0.3, "pos", "neg")
    out = pd.DataFrame({"id": range(n), "x": x, "w": np.exp(rng.normal(0, 1, n)), "f": f, "y": y})
    out.loc[::29, "x"] = np.nan
    return out


@pytest.fixture(scope="module")
def df(spark, pdf):
    return IO.nan_to_null(spark.createDataFrame(pdf))


def test_yeo_johnson_identity_and_likelihood(df, pdf):
    same = X.yeo_johnson(df.select("id", "w"), {"w": 1.0}).toPandas().set_index("id")["w"].sort_index()
    np.testing.assert_allclose(same, pdf.w)
    lam = X.fit_yeo_johnson(df, ["w"])["w"]

    def score(v):
        t = np.log1p(pdf.w) if abs(v) < 1e-12 else ((pdf.w + 1) ** v - 1) / v
        return -len(pdf) / 2 * math.log(t.var(ddof=0)) + (v - 1) * np.log1p(pdf.w).sum()

    grid = np.arange(-4, 4.001, 0.01)
    assert score(lam) >= max(score(v) for v in grid) - 1e-4


def test_outliers_and_domain_features(spark):
    d = spark.createDataFrame([(float(v),) for v in [0] * 30 + [100]], "v double")
    kept = X.remove_outliers(d, X.fit_moments(d, ["v"]))
    assert kept.where("v is null").count() == 1
    stage = X.domain_stage([("r", "a", "b")], [("band", "a", [0, 30, 50, 70, 100])])
    rows = spark.createDataFrame([(0.0, 0.0), (30.0, 2.0), (30.5, 1.0), (100.0, -1.0), (101.0, 1.0)], "a double, b double")
    got = [(r["r"], r["band"]) for r in stage.transform(rows).collect()]
    assert got == [(None, 1.0), (15.0, 1.0), (30.5, 2.0), (-100.0, 4.0), (101.0, None)]


def test_one_hot_unknown_level_is_zero(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "f string")
    index, encode = X.one_hot_stages(["f"])
    ix = index.fit(train)
    enc = encode.fit(ix.transform(train))
    test = spark.createDataFrame([("b",), ("zz",), (None,)], "f string")
    got = [list(r["v"]) for r in enc.transform(ix.transform(test)).select(vector_to_array("f__oh").alias("v")).collect()]
    assert got == [[0.0, 1.0, 0.0], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]


def test_preprocessor_survives_saving(spark, df):
    pre = X.fit_preprocessor(df, ["x", "w"], ["f"], power=True, outlier_z=3.0, max_categories=2)
    path = store.save_model(pre, scratch_dir(spark, "pre"))
    a = [r["features"] for r in pre.transform(df).orderBy("id").select("features").collect()]
    b = [r["features"] for r in store.load_model(path).transform(df).orderBy("id").select("features").collect()]
    assert a == b
    names = X.vector_names(pre.transform(df))
    assert names[:2] == ["x__num", "w__num"] and any(X.INFREQUENT in n for n in names)


def test_missing_model(spark):
    with pytest.raises(store.ModelNotFound):
        store.load_model(scratch_dir(spark, "nothing"))


def test_frequency_encode_hot_and_unknown_levels(spark):
    src = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise(F.concat(F.lit("l"), "id")).alias("f"))
    codes = X.frequency_codes(src.where("id < 950"), "f")
    got = X.frequency_encode(src, "f", "code", codes)
    assert got.count() == 1000
    r = got.agg(F.sum("code").alias("s"), F.count_if(F.col("code").isNull()).alias("unknown")).first()
    assert r["unknown"] == 50 and r["s"] == pytest.approx(900 * 900 / 950 + 50 / 950)


# --- evaluation -------------------------------------------------------------


@pytest.fixture(scope="module")
def judged(spark):
    rng = np.random.default_rng(2)
    y = rng.integers(0, 2, 500)
    s = np.round(rng.normal(y * 0.8, 1), 1)
    return pd.DataFrame({"s": s, "y": y})


def test_auc(spark, judged):
    d = spark.createDataFrame(judged)
    auc = M.roc_auc(d, "s", "y").first()["auc"]
    flipped = M.roc_auc(d.withColumn("s", -F.col("s")), "s", "y").first()["auc"]
    pos, neg = judged.s[judged.y == 1].to_numpy(), judged.s[judged.y == 0].to_numpy()
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(want) and auc + flipped == pytest.approx(1)
    roc = M.roc_points(d, "s", "y").toPandas().sort_values("threshold", ascending=False)
    area = np.trapezoid(np.r_[0, roc.tpr], np.r_[0, roc.fpr])
    assert area == pytest.approx(want)


def test_threshold_sweep(spark, judged):
    got = M.threshold_sweep(spark.createDataFrame(judged), "s", "y").toPandas().sort_values("ordinal")
    pct = judged.s.rank(pct=True)
    for _, r in got.iterrows():
        pred = pct > r["threshold"]
        tp = (pred & (judged.y == 1)).sum()
        assert r["precision"] == pytest.approx(tp / pred.sum())
        assert r["recall"] == pytest.approx(tp / judged.y.sum())
    best = M.best_threshold(M.threshold_sweep(spark.createDataFrame(judged), "s", "y")).first()
    assert best["f1"] == pytest.approx(got.f1.max())


def test_report_with_class_never_predicted(spark):
    d = spark.createDataFrame([(0, 0), (0, 0), (1, 0)], "y int, p int")
    rows = {r["label"]: r for r in M.classification_report(d, "y", "p").collect()}
    assert (rows["1"]["precision"], rows["1"]["recall"], rows["1"]["f1"]) == (0, 0, 0)
    assert rows["accuracy"]["f1"] == pytest.approx(2 / 3) and rows["macro avg"]["support"] == 3


# --- models -----------------------------------------------------------------


def test_classification_analysis(spark, df):
    models = {
        "Logistic Regression": LogisticRegression(maxIter=20),
        "Random Forest": RandomForestClassifier(numTrees=5, maxDepth=4, seed=42),
    }
    lr = models["Logistic Regression"]
    train, test = M.stratified_split(M.labelled(df, "y", "pos"), ["id"], "y")
    results = M.compare_classifiers(train, test, ["x", "w"], ["f"], models)
    assert all(r.auc > 0.7 for r in results.values())
    best = M.best_model(results)
    assert best.auc == max(r.auc for r in results.values())
    names = {r["feature"] for r in M.feature_importance(results["Random Forest"].model, train).collect()}
    assert {"x", "w", "f_a"} <= names
    n_test = test.count()
    for row in M.comparison_table(spark, results).collect():
        assert row["tn"] + row["fp"] + row["fn"] + row["tp"] == n_test
    reports = {(r["model"], r["label"]): r for r in M.model_reports(results, test).collect()}
    for name, fit in results.items():
        assert reports[name, "1"]["support"] == fit.metrics["fn"] + fit.metrics["tp"]
        assert reports[name, "accuracy"]["f1"] == pytest.approx((fit.metrics["tn"] + fit.metrics["tp"]) / n_test)
    ends = M.model_roc(results, test).groupBy("model").agg({"fpr": "max", "tpr": "max", "threshold": "max"}).collect()
    assert len(ends) == len(results)
    assert all(r["max(fpr)"] == r["max(tpr)"] == 1.0 and r["max(threshold)"] == float("inf") for r in ends)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.01, 10.0]).build()
    tuned, scores = M.tune(train, ["x", "w"], ["f"], ["id"], "Logistic Regression", lr, grid, folds=3)
    assert scores.count() == 2
    path = store.save_model(tuned, scratch_dir(spark, "tuned"))
    one = M.predict(store.load_model(path), {"x": 2.0, "w": 1.0, "f": "a"}, spark, ("neg", "pos")).first()
    assert one["predicted"] == "pos" and 0.5 < one["probability"] <= 1
    with pytest.raises(ValueError):
        M.predict(tuned, 17, spark)


def test_slot_names_lose_only_their_own_mark():
    names = ["x__num", "a__num_b__num", "f__cat__oh_a", "a__num_b__cat__oh_z__num"]
    assert [X.plain_slot(n) for n in names] == ["x", "a__num_b", "f_a", "a__num_b_z__num"]


def test_tuning_grids_have_the_full_size():
    sizes = {
        name: len(M.tuning_grid(name, est, 100)) for name, est in M.default_classifiers(100).items()
    }
    assert sizes == {"Logistic Regression": 10, "Random Forest": 27, "Gradient Boosting": 81}


def test_regressors_keep_their_own_models(spark, df):
    src = df.withColumn("t", F.coalesce(F.col("x"), F.lit(0.0)) * 3 + F.col("id") % 5)
    models = {"Ridge": LinearRegression(regParam=1e-6), "Lasso": LinearRegression(regParam=0.5, elasticNetParam=1.0)}
    run = M.compare_regressors(src, "t", ["x", "w"], ["f"], ["id"], ratios=[("xw", "x", "w")], models=models)
    assert not run.log_target and len(run.results) == 8
    assert len({id(f.model.stages[-1]) for f in run.results.values()}) == 8
    for f in run.results.values():
        again = M.regression_metrics(f.model.transform(run.test), "label", "prediction").first()
        assert again["r2"] == pytest.approx(f.metrics["r2"])
    assert run.best.metrics["r2"] > 0.5


def test_log_target_decision(spark, df):
    assert X.target_profile(df, "w", ["id"]).first()["use_log1p"]
    assert not X.target_profile(df.withColumn("neg", -F.col("w")), "neg", ["id"]).first()["use_log1p"]


# --- profile, charts and whole runs -----------------------------------------


def test_profile_edges(spark):
    d = spark.createDataFrame([(1.0, "a"), (None, None)], "v double, f string")
    r = P.numeric_profile(d, ["v"]).first()
    assert (r["mean"], r["std"], r["skewness"], r["kurtosis"]) == (1.0, None, None, None)
    assert {x["feature"]: x["n_missing"] for x in P.missing_report(d).collect()} == {"v": 1, "f": 1}
    with pytest.raises(ValueError):
        P.levels(spark.range(20), "id", limit=10)
    assert P.mode_levels(spark.createDataFrame([("b",), ("a",)], "f string"), ["f"]).first()["level"] == "a"


def test_band_edges(spark):
    vals = [-1, 0, 30, 31, 100, 101]
    d = spark.createDataFrame([(v,) for v in vals], "v int")
    got = [r["b"] for r in d.select(S.band(F.col("v"), [0, 30, 50, 70, 100]).alias("b")).collect()]
    assert got == [None, 1, 1, 2, 4, None]


def test_charts(spark, df, pdf):
    h = C.histogram(df, "w", 20).toPandas()
    assert h.n.sum() == len(pdf)
    assert (h.density * (pdf.w.max() - pdf.w.min()) / 20).sum() == pytest.approx(1)
    k = C.kde(df, "w", bins=2000, points=50).toPandas().sort_values("point")
    band = len(pdf) ** -0.2 * pdf.w.std()
    want = [np.exp(-(((x - pdf.w) / band) ** 2) / 2).sum() / (len(pdf) * band * math.sqrt(2 * math.pi)) for x in k.x]
    np.testing.assert_allclose(k.density, want, rtol=0.02, atol=1e-4)
    qq = C.qq_points(df, "w").toPandas().sort_values("position")
    assert len(qq) == len(pdf) and np.allclose(qq["sample"], np.sort(pdf.w))
    assert C.histogram(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v", 5).first()["n"] == 2


def test_qq_line_reads_all_rows(spark):
    # far values between the thousand evenly spaced positions, and a tie of a third of the rows
    x = np.concatenate([np.linspace(-3, 3, 3000), np.full(2000, 0.5), np.geomspace(4, 5000, 7)])
    d = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    got = C.qq_line(d, "v", chunk=300).first()
    n, i = len(x), np.arange(2, len(x))
    p = np.concatenate([[1 - 0.5 ** (1 / n)], (i - 0.3175) / (n + 0.365), [0.5 ** (1 / n)]])
    z, s = np.array([NormalDist().inv_cdf(v) for v in p]), np.sort(x)
    slope, intercept = np.polyfit(z, s, 1)
    r = np.corrcoef(z, s)[0, 1]
    assert (got["slope"], got["intercept"], got["r"]) == pytest.approx((slope, intercept, r), rel=1e-6)
    whole = C.qq_line(d, "v").first()
    assert whole["slope"] == pytest.approx(slope, rel=1e-6)


def test_statistical_analysis_and_sinks(spark, df):
    out = analyses.statistical_analysis(df, "y", "neg", "pos", ["id"])
    assert out["findings"].count() >= 1
    assert out["group_tests"].count() == 2 and out["logistic"].count() == 5
    paths = analyses.save_results({k: out[k] for k in ("profile", "risks")}, scratch_dir(spark, "results"), "csv")
    assert IO.read_table(spark, paths["risks"], "csv").count() == 3


def test_records(spark):
    assert IO.as_records(spark, [{"a": 1}, {"a": 2}]).count() == 2
    with pytest.raises(ValueError):
        IO.as_records(spark, "text")


def test_dense_network_learns(spark, df):
    src = X.frequency_encode(M.labelled(df.na.drop(), "y", "pos"), "f", "f_code")
    model = M.dense_network(src, ["x", "w", "f_code"], hidden=(6,), max_iter=60)
    out = M.scored(model, src).select("score", "label")
    assert out.where("score < 0 or score > 1").count() == 0
    assert M.roc_auc(out, "score", "label").first()["auc"] > 0.75


def test_staged_scores_equal_separate_fits(spark, df):
    rows = X.fit_preprocessor(df, ["x", "w"], ["f"]).transform(M.labelled(df, "y", "pos")).select("label", "features").coalesce(1).persist()
    for share in (1.0, 0.8):
        est = GBTClassifier(maxIter=9, maxDepth=3, stepSize=0.1, seed=7, subsamplingRate=share)
        staged = fits.staged_scores(est.fit(rows), rows, [3, 6, 9])
        for j, size in enumerate((3, 6, 9)):
            alone = est.copy({est.maxIter: size}).fit(rows).transform(rows)
            want = M._auc(alone, "rawPrediction")
            assert M._auc(staged.select("label", F.col("staged")[j].alias("s")), "s") == pytest.approx(want, abs=1e-12)
    forest = RandomForestClassifier(numTrees=8, maxDepth=6, seed=7).fit(rows)
    got = fits.staged_scores(forest, rows, [1, 8], keep=("features",)).collect()
    whole = M.scored(forest, rows).select("features", "score").collect()
    assert [r["staged"][1] / 8 for r in got] == pytest.approx([r["score"] for r in whole])
    single = forest.trees[0]
    assert [r["staged"][0] for r in got[:40]] == pytest.approx([single.predictProbability(r["features"])[1] for r in got[:40]])


def test_tuning_goes_on_after_a_restart(spark, df, monkeypatch):
    train = M.labelled(df, "y", "pos")
    est = GBTClassifier(maxDepth=2, seed=3)
    grid = ParamGridBuilder().addGrid(est.maxIter, [2, 4]).addGrid(est.stepSize, [0.1, 0.3]).build()
    folder, fitted = scratch_dir(spark, "resume"), []
    fit = GBTClassifier.fit
    monkeypatch.setattr(GBTClassifier, "fit", lambda self, *a, **k: fitted.append(1) or fit(self, *a, **k))
    _, first = M.tune(train, ["x", "w"], ["f"], ["id"], "Gradient Boosting", est, grid, folds=2, resume=folder)
    assert len(fitted) == 2 * 2 + 1  # four grid points are two fits a fold
    _, again = M.tune(train, ["x", "w"], ["f"], ["id"], "Gradient Boosting", est, grid, folds=2, resume=folder)
    assert len(fitted) == 2 * 2 + 2 and sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    _, alone = M.tune(train, ["x", "w"], ["f"], ["id"], "Gradient Boosting", est, grid[:1], folds=2)
    assert alone.first()["auc"] == pytest.approx(first.orderBy("ordinal").first()["auc"])


def test_target_bundle(spark, df, monkeypatch):
    src = df.na.drop().withColumn("t", F.col("x") * 2 + F.col("id") % 3)
    models = {"Ridge": LinearRegression(regParam=1e-6)}
    options = {"models": models, "routes": ("PCA",), "resume": scratch_dir(spark, "resume")}
    found = M.multi_target(src, ["t"], ["x", "t"], ["f"], ["id"], **options)
    paths = found.save(scratch_dir(spark, "bundle"))
    assert {"t/variance", "t/sweep", "t/ols_terms", "t/models/PCA_-_Ridge", "summary"} <= set(paths)
    run = found.runs["t"]
    again = M.regression_metrics(store.load_model(paths["t/models/PCA_-_Ridge"]).transform(run.test), "label", "prediction").first()
    assert again["r2"] == pytest.approx(run.results["PCA - Ridge"].metrics["r2"]) and IO.read_table(spark, paths["summary"]).count() == 1
    monkeypatch.setattr(LinearRegression, "fit", None)  # everything is there already
    same = M.multi_target(src, ["t"], ["x", "t"], ["f"], ["id"], **options)
    assert same.runs["t"].best.metrics["r2"] == pytest.approx(run.best.metrics["r2"])


def test_forests_keep_nodes_beside_rows(spark, df):
    train = M.labelled(df, "y", "pos")
    forest = RandomForestClassifier(numTrees=6, maxDepth=12, seed=7)
    model = M.compare_classifiers(train, train, ["x", "w"], ["f"], {"Random Forest": forest})["Random Forest"].model
    assert model.stages[-1].getOrDefault("cacheNodeIds") and not forest.isSet(forest.cacheNodeIds)
    rows = PipelineModel(model.stages[:-1]).transform(train).select("label", "features").coalesce(1).persist()
    plain, own = forest.copy().setFeaturesCol("features").fit(rows), fits.prepared(forest).fit(rows)
    assert plain.toDebugString.splitlines()[1:] == own.toDebugString.splitlines()[1:]


def test_packed_has_no_more_partitions_than_cores_need(spark):
    rows, width = spark.range(0, 100, 1, 64), spark.sparkContext.defaultParallelism
    parts = [fits.packed(rows, n).rdd.getNumPartitions() for n in (0, 15_000, 30_000, 600_000, 2_000_000)]
    assert parts == [1, 1, 2, min(30, max(width, 3)), min(64, max(width, 10))]


def test_packed_spreads_what_was_read_in_one_task(spark):
    width = spark.sparkContext.defaultParallelism
    rows = spark.range(0, 600, 1, 1)
    assert fits.packed(rows, 60_000).rdd.getNumPartitions() == min(3, max(width, 1)) and fits.packed(rows, 600).rdd.getNumPartitions() == 1
    held = fits.packed(rows, 60_000).rdd.glom().map(len).collect()
    assert sum(held) == 600 and min(held) > 100


def test_routes_with_one_matrix_share_fits(spark, df, monkeypatch):
    src = df.na.drop().withColumn("t", F.col("x") * 2 + F.col("id") % 3)
    fitted, models = [], {"Forest": RandomForestRegressor(numTrees=3, maxDepth=4, seed=7)}
    fit = RandomForestRegressor.fit
    monkeypatch.setattr(RandomForestRegressor, "fit", lambda self, data, *a: fitted.append(data) or fit(self, data, *a))
    run = M.compare_regressors(src, "t", ["x", "w"], ["f"], ["id"], models=models)
    names = [f"{r} - Forest" for r in ("Basic", "Feature Selection", "PCA", "Domain Features")]
    assert len(fitted) == 2 and list(run.results) == names  # every slot is selected and nothing is derived
    trees = {n: run.results[n].model.stages[-1].toDebugString.splitlines()[1:] for n in names}
    assert trees[names[0]] == trees[names[1]] == trees[names[3]] != trees[names[2]]
    for name in names:
        found = run.results[name]
        alone = M.compare_regressors(src, "t", ["x", "w"], ["f"], ["id"], models=models, routes=(name.split(" - ")[0],)).results[name]
        again = M.regression_metrics(found.model.transform(run.test), "label", "prediction").first().asDict()
        assert found.name == name and found.metrics == pytest.approx(alone.metrics) and again == pytest.approx(found.metrics)
    fitted.clear()
    M.compare_regressors(src, "t", ["x", "w"], ["f"], ["id"], models=models, k=2, ratios=[("r", "x", "w")])
    assert len(fitted) == 4


def test_power_fit_multiplies_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x, w = rng.normal(-1, 2, 900), 5 + rng.exponential(3.0, 900)
    rows = [(None if i % 50 == 0 else float(a), float(b), None) for i, (a, b) in enumerate(zip(x, w))]
    d = spark.createDataFrame(rows, "x double, w double, none double").repartition(5)
    monkeypatch.setattr(F, "posexplode", None)
    got = X.fit_yeo_johnson(d, ["x", "w", "none"])
    assert got["none"] == 1.0
    for values, lam in ((x[np.arange(900) % 50 != 0], got["x"]), (w, got["w"])):
        def score(p, v=values):
            pos = np.log1p(np.maximum(v, 0)) if abs(p) < 1e-12 else ((np.maximum(v, 0) + 1) ** p - 1) / p
            neg = -np.log1p(np.maximum(-v, 0)) if abs(p - 2) < 1e-12 else -((np.maximum(-v, 0) + 1) ** (2 - p) - 1) / (2 - p)
            return -len(v) / 2 * math.log(np.where(v < 0, neg, pos).var()) + (p - 1) * (np.sign(v) * np.log1p(np.abs(v))).sum()

        assert score(lam) >= max(score(lam + s) for s in (-0.05, -0.02, 0.02, 0.05))


def test_routes_fit_a_column_once(spark, df, monkeypatch):
    src = df.na.drop().withColumn("t", F.col("x") * 2 + F.col("id") % 3)
    fitted, fit = [], X.fit_yeo_johnson
    monkeypatch.setattr(X, "fit_yeo_johnson", lambda data, cols: fitted.extend(cols) or fit(data, cols))
    models, made = {"Ridge": LinearRegression(regParam=1e-6)}, [("r", "x", "w")]
    run = M.compare_regressors(src, "t", ["x", "w"], ["f"], ["id"], ratios=made, models=models, routes=("Basic", "Domain Features"))
    assert fitted == ["x", "w", "r"]
    train, _ = M.train_test_split(src, ["id"], 0.2, 42)
    alone = X.fit_preprocessor(X.domain_stage(made).transform(train), ["x", "w", "r"], ["f"], power=True, outlier_z=3.0, max_categories=10)
    own, plain = run.results["Domain Features - Ridge"].model, X.domain_stage(made).transform(src)
    got, want = ([r["features"].toArray() for r in m.transform(t).orderBy("id").select("features").collect()] for m, t in ((own, src), (alone, plain)))
    np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_pool_keeps_order():
    assert fits.run_pool({"a": lambda: 1, "b": lambda: 2}, 4, {"a": 1, "b": 9}.get) == {"a": 1, "b": 2} and fits.run_pool({}, 4) == {}
    assert fits.cost(GBTClassifier(maxIter=100, maxDepth=5)) > fits.cost(RandomForestClassifier(numTrees=100, maxDepth=15)) > fits.cost(LinearRegression())


def test_multi_target_summary(spark, df):
    src = df.na.drop().withColumn("t", F.col("x") * 2 + F.col("id") % 3)
    models = {"Ridge": LinearRegression(regParam=1e-6)}
    row = M.multi_target_summary(src, ["t"], ["x", "w"], ["f"], ["id"], models=models, routes=("Basic",)).first()
    assert row["best_model"] == "Basic - Ridge" and row["r2"] > 0.7 and 0.6 < row["f1"] <= 1 and row["bic"] > row["aic"]


def test_violin_groups_integrate_to_one(df):
    v = C.violin(df, "w", "f", points=400).toPandas()
    for _, g in v.groupby("f"):
        g = g.sort_values("x")
        # the curve is cut at the ends of the data, so a little mass lies outside
        assert 0.8 < np.trapezoid(g.density, g.x) <= 1.01
        assert (g.q1 <= g["median"]).all() and (g["median"] <= g.q3).all()


def test_model_queries_fit_everything(spark, monkeypatch):
    from statspark.plans import queries_models as Q

    class Stop(Exception):
        pass

    def caught(name, query):
        calls = []

        def record(*args, **options):
            calls.append((args, options))
            raise Stop

        monkeypatch.setattr(M, name, record)
        with pytest.raises(Stop):
            Q.REG.queries[query](spark, "/root/testdata/sf0.001")
        return calls[0]

    for query in ("m24_compare_regressors", "m29_multi_target"):
        options = caught("compare_regressors", query)[1]
        assert options.get("models") is None and "routes" not in options
    # the grid of the model that won, not always the logistic one
    won = M.Fitted("Gradient Boosting", None, auc=0.9)
    monkeypatch.setattr(M, "compare_classifiers", lambda *a, **k: {"Logistic Regression": M.Fitted("Logistic Regression", None, auc=0.8), won.name: won})
    args, options = caught("tune", "m23_tune")
    assert args[4] == won.name and len(M.tuning_grid(won.name, args[5], 100)) == 81 and "grid" not in options
