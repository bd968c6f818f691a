"""Model comparison, tuning, evaluation and scoring on ``pyspark.ml``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statspark.functions import scalars as S
from statspark.operators import features as X
from statspark.operators import fits, trees
from statspark.operators.rank import exact_quantiles, ranked_values
from statspark.operators.regression import ols_hc3
from statspark.operators.sampling import flags_by_bounds, key_bucket, stratified_bounds, stratified_flags, train_test_split
from statspark.session import scratch_dir
from statspark.sources.models import save_model
from statspark.sources.tables import as_records, write_result


@contextmanager
def kept(df: DataFrame):
    """Hold a training set on the executors while several fits scan it; recomputed if lost."""
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield held
    finally:
        held.unpersist()


# --- evaluation -------------------------------------------------------------


def _stack(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def roc_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Exact AUC from the rank sum of the positive rows (ties count half)."""
    ranked = ranked_values(df, [score], tallies={"pos": F.when(F.col(y) == 1, 1).otherwise(0)})
    s = ranked.agg(
        F.sum(F.col("pos") * F.col("midrank")).alias("rank_sum"),
        F.max("total_pos").cast("double").alias("p"),
        F.max("total_n").cast("double").alias("n"),
    )
    p, q = F.col("p"), F.col("n") - F.col("p")
    auc = (F.col("rank_sum") - p * (p + 1) / 2) / F.nullif(p * q, F.lit(0.0))
    return s.select(auc.alias("auc"), p.cast("long").alias("n_pos"), q.cast("long").alias("n_neg"))


def roc_points(df: DataFrame, score: str, y: str) -> DataFrame:
    """False and true positive rate at every distinct threshold (score >= threshold is positive).

    The curve starts at threshold +infinity with both rates 0.
    """
    ranked = ranked_values(df, [score], tallies={"pos": F.when(F.col(y) == 1, 1).otherwise(0)})
    tp = F.col("total_pos") - F.col("below_pos")
    fp = (F.col("total_n") - F.col("total_pos")) - (F.col("below_n") - F.col("below_pos"))
    start = df.sparkSession.range(1).select(F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    points = ranked.select(
        F.col("value").alias("threshold"),
        F.try_divide(fp, F.col("total_n") - F.col("total_pos")).alias("fpr"),
        F.try_divide(tp, F.col("total_pos")).alias("tpr"),
    )
    return points.unionByName(start)


def confusion_matrix(df: DataFrame, y: str, pred: str, labels: Sequence) -> DataFrame:
    """Counts, one row per true label and one column per predicted label."""
    return (
        df.groupBy(F.col(y).alias("actual"))
        .pivot(pred, list(labels))
        .agg(F.count(F.lit(1)))
        .na.fill(0)
    )


def classification_report(df: DataFrame, y: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows.

    A zero denominator gives 0.
    """
    cells = df.groupBy(F.col(y).cast("string").alias("y"), F.col(pred).cast("string").alias("p")).agg(
        F.count(F.lit(1)).alias("n")
    )
    sides = cells.select(
        F.inline(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("long").alias("hit")),
            )
        )
    )
    g = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    precision = F.coalesce(F.try_divide(F.col("hit"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("hit"), F.col("predicted") + F.col("support")), F.lit(0.0))
    rows = g.select("label", precision.alias("precision"), recall.alias("recall"), f1.alias("f1"), "support", "hit")
    names = ("precision", "recall", "f1")
    weighted = {c: F.sum(F.col(c) * F.col("support")) / F.sum("support") for c in names}
    total = F.sum("support").alias("support")
    accuracy = (F.sum("hit") / F.sum("support")).alias("f1")
    return _stack(
        rows.drop("hit"),
        rows.agg(accuracy, total).withColumns({"label": F.lit("accuracy"), "precision": F.col("f1"), "recall": F.col("f1")}),
        rows.agg(*[F.avg(c).alias(c) for c in names], total).withColumn("label", F.lit("macro avg")),
        rows.agg(*[weighted[c].alias(c) for c in names], total).withColumn("label", F.lit("weighted avg")),
    )


def regression_metrics(df: DataFrame, y: str, pred: str, log_target: bool = False) -> DataFrame:
    """MSE, RMSE, MAE and R2. For a log1p target errors are on the original scale, R2 on the fitted one."""
    a, b = F.col(y).cast("double"), F.col(pred).cast("double")
    err = F.expm1(a) - F.expm1(b) if log_target else a - b
    g = df.agg(
        F.avg(err * err).alias("mse"),
        F.avg(F.abs(err)).alias("mae"),
        F.avg((a - b) * (a - b)).alias("rss"),
        F.var_pop(a).alias("tss"),
    )
    r2 = 1 - F.col("rss") / F.nullif(F.col("tss"), F.lit(0.0))
    return g.select("mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"))


# The threshold grid of the sweep.
SWEEP = tuple(round(0.30 + 0.02 * i, 2) for i in range(20))


def threshold_sweep(df: DataFrame, score: str, y: str, thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """Precision, recall and F1 of "percentile rank > threshold" for each threshold.

    Scores collapse to at most len(thresholds)+1 bands before thresholds are applied.
    """
    ranked = ranked_values(df, [score], tallies={"pos": F.when(F.col(y) == 1, 1).otherwise(0)})
    pct = F.col("midrank") / F.col("total_n")
    passed = reduce(lambda a, b: a + b, [(pct > F.lit(float(t))).cast("int") for t in thresholds])
    bands = ranked.groupBy(passed.alias("band")).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.max("total_pos").alias("total_pos")
    )
    grid = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(thresholds)])
    per = (
        bands.select("*", F.inline(grid))
        .groupBy("ordinal", "threshold")
        .agg(
            F.sum(F.when(F.col("band") > F.col("ordinal"), F.col("pos")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("band") > F.col("ordinal"), F.col("n")).otherwise(0)).alias("called"),
            F.max("total_pos").alias("actual"),
        )
    )
    zero = F.lit(0.0)
    return per.select(
        "ordinal",
        "threshold",
        F.coalesce(F.try_divide(F.col("tp"), F.col("called")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("tp"), F.col("actual")), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("called") + F.col("actual")), zero).alias("f1"),
    )


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row with the highest F1; the lowest threshold wins a tie."""
    return sweep.orderBy(F.col("f1").desc(), "ordinal").limit(1)


# --- classification ---------------------------------------------------------


def default_classifiers(n_train: int, seed: int = 42) -> dict[str, Estimator]:
    """The three compared models with the usual defaults (C=1 is regParam 1/n; 30 is Spark's depth limit)."""
    return {
        "Logistic Regression": LogisticRegression(
            maxIter=1000, regParam=1.0 / max(n_train, 1), elasticNetParam=0.0, standardization=False
        ),
        "Random Forest": RandomForestClassifier(numTrees=100, maxDepth=30, seed=seed),
        "Gradient Boosting": GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
    }


def labelled(df: DataFrame, outcome: str, positive) -> DataFrame:
    return df.withColumn("label", S.outcome01(outcome, positive).cast("double"))


def stratified_split(df: DataFrame, keys: Sequence[str], outcome: str, share: float = 0.2, seed: int = 42):
    """Train and test rows, an exact share of each level of ``outcome`` as test.

    A table of more than ``trees.FEW_ROWS`` rows is written once to the shared folder, and its test rows are those up to a
    key hash per level: later scans read it with no shuffle.
    """
    n = df.count()
    if n <= trees.FEW_ROWS:
        flagged = stratified_flags(df, keys, outcome, share, seed, "_test")
    else:
        spark = df.sparkSession
        rows = spark.read.parquet(write_result(fits.packed(df, n), scratch_dir(spark, "split")))
        flagged = flags_by_bounds(rows, keys, outcome, stratified_bounds(rows, keys, outcome, share, seed), seed, "_test")
    return flagged.where(~F.col("_test")).drop("_test"), flagged.where("_test").drop("_test")


def scored(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Prediction plus the positive-class probability as a plain double."""
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("score", F.element_at(vector_to_array("probability"), -1))
    return out


@dataclass
class Fitted:
    name: str
    model: PipelineModel
    auc: float | None = None
    metrics: dict = field(default_factory=dict)


def compare_classifiers(
    train: DataFrame,
    test: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    models: Mapping[str, Estimator] | None = None,
    seed: int = 42,
    parallelism: int = 3,
) -> dict[str, Fitted]:
    """Fit each classifier on one shared preprocessing and measure exact test AUC and the confusion counts.

    ``train`` and ``test`` carry a 0/1 ``label`` column. ``metrics`` holds tn, fp, fn, tp. ``parallelism`` fits run at a time.
    """
    cols = ["label", *numeric, *categorical]
    with kept(train.select(*cols)) as base, kept(test.select(*cols)) as held:
        pre = X.fit_preprocessor(base, numeric, categorical)
        n = base.count()
        rows = pre.transform(base).select("label", "features")
        # fits of many rows scan them twice or keep their own form, so the matrix is not stored as well
        with kept(fits.packed(rows, n)) if n <= trees.FEW_ROWS else nullcontext(rows) as ready:
            candidates = models or default_classifiers(n, seed)

            def fit(name: str) -> Fitted:
                model = PipelineModel([*pre.stages, trees.fitted(fits.prepared(candidates[name]), ready, n)])
                with kept(scored(model, held).select("score", "label", "prediction")) as judged:
                    cells = judged.agg(
                        *[
                            F.count_if((F.col("label") == y) & (F.col("prediction") == p)).alias(cell)
                            for cell, y, p in (("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0), ("tp", 1, 1))
                        ]
                    )
                    auc = roc_auc(judged, "score", "label").first()["auc"]
                    return Fitted(name, model, auc, cells.first().asDict())

            jobs = {name: lambda name=name: fit(name) for name in candidates}
            return fits.run_pool(jobs, parallelism, lambda name: fits.cost(candidates[name]))


def comparison_table(spark, results: Mapping[str, Fitted]) -> DataFrame:
    """One row per model: AUC, confusion counts, accuracy, and the scores of the positive class."""
    rows = [(i, r.name, r.auc, *[r.metrics[c] for c in ("tn", "fp", "fn", "tp")]) for i, r in enumerate(results.values())]
    table = spark.createDataFrame(rows, "ordinal int, model string, auc double, tn long, fp long, fn long, tp long")
    ratio = {
        "accuracy": ("tn + tp", "tn + fp + fn + tp"),
        "precision": ("tp", "tp + fp"),
        "recall": ("tp", "tp + fn"),
        "f1": ("2 * tp", "2 * tp + fp + fn"),
    }
    return table.withColumns({c: F.expr(f"coalesce(try_divide({a}, {b}), 0D)") for c, (a, b) in ratio.items()})


def _per_model(results: Mapping[str, Fitted], test: DataFrame, judge) -> DataFrame:
    parts = [judge(scored(r.model, test)).select(F.lit(r.name).alias("model"), "*") for r in results.values()]
    return _stack(*parts)


def model_reports(results: Mapping[str, Fitted], test: DataFrame) -> DataFrame:
    """The classification report of every fitted model."""
    return _per_model(results, test, lambda df: classification_report(df.withColumns(
        {c: F.col(c).cast("int") for c in ("label", "prediction")}), "label", "prediction"))


def model_roc(results: Mapping[str, Fitted], test: DataFrame) -> DataFrame:
    """The ROC points of every fitted model."""
    return _per_model(results, test, lambda df: roc_points(df.select("score", "label"), "score", "label"))


def best_model(results: Mapping[str, Fitted]) -> Fitted:
    """Highest AUC; the first one wins a tie."""
    return max(results.values(), key=lambda r: r.auc if r.auc is not None else -1.0)


def feature_importance(model: PipelineModel, df: DataFrame, k: int = 20) -> DataFrame:
    """Largest importances (tree models) or absolute coefficients, with feature names restored."""
    last = model.stages[-1]
    names = X.vector_names(PipelineModel(model.stages[:-1]).transform(df.limit(0)), last.getFeaturesCol())
    vector = last.featureImportances if hasattr(last, "featureImportances") else last.coefficients
    rows = [(X.plain_slot(n), abs(float(v))) for n, v in zip(names, vector.toArray())]
    table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature").limit(k)


def tuning_grid(name: str, estimator: Estimator, n_train: int) -> list:
    """The search grid per model family. C maps to regParam 1/(C·n), l1/l2 to elasticNetParam 1/0."""
    b = ParamGridBuilder()
    if name == "Logistic Regression":
        b.addGrid(estimator.regParam, [1.0 / (c * max(n_train, 1)) for c in (0.01, 0.1, 1, 10, 100)])
        b.addGrid(estimator.elasticNetParam, [1.0, 0.0])
    elif name == "Random Forest":
        b.addGrid(estimator.numTrees, [100, 200, 300])
        b.addGrid(estimator.maxDepth, [30, 10, 20])
        b.addGrid(estimator.minInstancesPerNode, [1, 2, 4])
    elif name == "Gradient Boosting":
        b.addGrid(estimator.maxIter, [100, 200, 300])
        b.addGrid(estimator.stepSize, [0.01, 0.1, 0.2])
        b.addGrid(estimator.maxDepth, [3, 5, 7])
        b.addGrid(estimator.subsamplingRate, [0.8, 0.9, 1.0])
    else:
        raise ValueError(f"no grid for {name}")
    return b.build()


def _families(grid: Sequence[dict], nested: str | None) -> list[list[int]]:
    """Indices of grid points that differ in the ensemble's size only, in the order of the grid."""
    groups: dict[tuple, list[int]] = {}
    for i, params in enumerate(grid):
        rest = tuple(sorted((p.name, v) for p, v in params.items() if p.name != nested))
        groups.setdefault(rest if nested else (i,), []).append(i)
    return list(groups.values())


def tune(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    keys: Sequence[str],
    name: str,
    estimator: Estimator,
    grid: list | None = None,
    folds: int = 5,
    parallelism: int = 8,
    seed: int = 42,
    resume: str | None = None,
) -> tuple[PipelineModel, DataFrame]:
    """Cross-validated grid search on AUC; folds come from the row key. Returns best model and scores.

    Medians, scales and levels are fitted anew on the training rows of each fold. Grid points of a tree ensemble that differ
    in its size only share one fit, of the largest; the smaller ones are scored as its first trees (for boosting that equals
    a fit of its own). All folds' fits go through one pool. With a ``resume`` folder the scores of each finished fit are kept
    there and a restart with the same arguments goes on from them.
    """
    spark = train.sparkSession
    fold = key_bucket(keys, seed + 1, folds).cast("int").alias("fold")
    estimator = fits.prepared(estimator)
    nested = fits.NESTED.get(type(estimator).__name__)
    with kept(train.select("label", fold, *numeric, *categorical)) as base:
        n = base.count()
        grid = grid or tuning_grid(name, estimator, n)
        families = _families(grid, nested)
        sides, jobs, weight = [], {}, {}

        def judge(k: int, family: list[int]) -> list[float]:
            ready, unseen = sides[k]
            sizes = [next((v for p, v in grid[i].items() if p.name == nested), None) for i in family]
            largest = family[max(range(len(family)), key=lambda j: sizes[j] or 0)]
            model = trees.fitted(estimator.copy(grid[largest]), ready, n)
            if len(family) == 1:
                return [_auc(model.transform(unseen), "rawPrediction")]
            with kept(fits.staged_scores(model, unseen, sizes)) as staged:
                return [_auc(staged.select("label", F.col("staged")[j].alias("score")), "score") for j in range(len(family))]

        try:
            for k in range(folds):
                rest, held = base.where(F.col("fold") != k), base.where(F.col("fold") == k)
                pre = X.fit_preprocessor(rest, numeric, categorical)
                pair = [fits.packed(pre.transform(rows).select("label", "features"), n).persist(StorageLevel.MEMORY_AND_DISK) for rows in (rest, held)]
                sides.append(pair)
                for g, family in enumerate(families):
                    path = f"{resume.rstrip('/')}/fold={k}/family={g}" if resume else None
                    jobs[f"{k}/{g}"] = lambda k=k, family=family, path=path: fits.kept_scores(spark, path, lambda: judge(k, family))
                    weight[f"{k}/{g}"] = fits.cost(estimator.copy(grid[family[-1]]))
            done = fits.run_pool(jobs, parallelism, weight.get)
        finally:
            for df in (df for pair in sides for df in pair):
                df.unpersist()
        sums = [0.0] * len(grid)
        for job, scores in done.items():
            for i, score in zip(families[int(job.split("/")[1])], scores):
                sums[i] += score
        best = max(range(len(grid)), key=lambda i: sums[i])
        pre = X.fit_preprocessor(base, numeric, categorical)
        with kept(fits.packed(pre.transform(base).select("label", "features"), n)) as ready:
            chosen = trees.fitted(estimator.copy(grid[best]), ready, n)
    rows = [
        (i, ", ".join(f"{p.name}={v}" for p, v in sorted(m.items(), key=lambda kv: kv[0].name)), a / folds)
        for i, (m, a) in enumerate(zip(grid, sums))
    ]
    table = spark.createDataFrame(rows, "ordinal int, params string, auc double")
    return PipelineModel([*pre.stages, chosen]), table


def _auc(df: DataFrame, score: str) -> float:
    judge = BinaryClassificationEvaluator(labelCol="label", rawPredictionCol=score, metricName="areaUnderROC", numBins=0)
    return judge.evaluate(df)


def predict(model: PipelineModel, data, spark=None, labels: Sequence = (0, 1)) -> DataFrame:
    """Score a DataFrame, a dict or a list of dicts: predicted label and positive probability."""
    if not isinstance(data, DataFrame) and spark is None:
        raise ValueError("pass a session to score plain records")
    rows = as_records(spark, data)
    out = scored(model, rows)
    keep = [F.col(c) for c in rows.columns]
    picked = F.when(F.col("prediction") == 1, F.lit(labels[1])).otherwise(F.lit(labels[0]))
    keep.append(picked.alias("predicted"))
    if "score" in out.columns:
        keep.append(F.col("score").alias("probability"))
    return out.select(*keep)


def dense_network(
    train: DataFrame, inputs: Sequence[str], hidden: Sequence[int] = (16, 8), max_iter: int = 100, seed: int = 42
) -> PipelineModel:
    """Small feed-forward scorer over numeric inputs (encode categories by frequency first)."""
    assemble = VectorAssembler(inputCols=list(inputs), outputCol="raw_features", handleInvalid="skip")
    scale = StandardScaler(inputCol="raw_features", outputCol="features", withMean=True)
    net = MultilayerPerceptronClassifier(
        layers=[len(inputs), *hidden, 2], maxIter=max_iter, seed=seed, featuresCol="features", labelCol="label"
    )
    return Pipeline(stages=[assemble, scale, net]).fit(train)


# --- regression -------------------------------------------------------------


def default_regressors(n_train: int, seed: int = 42) -> dict[str, Estimator]:
    """Ridge alpha=10, Lasso 0.5, elastic net 0.5/0.5, Huber 1.35, forest and boosting (ridge alpha is per n)."""
    plain = {"standardization": False}
    return {
        "Ridge": LinearRegression(regParam=10.0 / max(n_train, 1), elasticNetParam=0.0, **plain),
        "Lasso": LinearRegression(regParam=0.5, elasticNetParam=1.0, **plain),
        "ElasticNet": LinearRegression(regParam=0.5, elasticNetParam=0.5, **plain),
        "Huber": LinearRegression(loss="huber", epsilon=1.35, **plain),
        "Random Forest": RandomForestRegressor(numTrees=100, maxDepth=15, seed=seed),
        "Gradient Boosting": GBTRegressor(maxIter=100, maxDepth=5, seed=seed),
    }


@dataclass
class RegressionRun:
    results: dict[str, Fitted]
    log_target: bool
    test: DataFrame
    top_features: DataFrame
    pca_table: DataFrame
    ols: DataFrame
    ols_terms: DataFrame
    selected: list[str]

    @property
    def best(self) -> Fitted:
        return max(self.results.values(), key=lambda f: f.metrics["r2"] if f.metrics["r2"] is not None else -1e300)


def compare_regressors(
    df: DataFrame,
    target: str,
    numeric: Sequence[str],
    categorical: Sequence[str],
    keys: Sequence[str],
    ratios: Sequence = (),
    bands: Sequence = (),
    models: Mapping[str, Estimator] | None = None,
    routes: Sequence[str] = ("Basic", "Feature Selection", "PCA", "Domain Features"),
    k: int = 20,
    seed: int = 42,
    parallelism: int = 8,
    resume: str | None = None,
) -> RegressionRun:
    """Every regressor on every feature route, each keeping its own fitted model.

    The target is log1p-transformed when its profile says so; the split hangs on
    the row key, so all routes and the later threshold sweep share it. Training and
    test rows are prepared once per route; the fits of all routes go through one
    pool, the long ones first. Routes whose matrix is the basic one (a selection that
    keeps every slot, no derived columns) share its fits and get a pipeline each. With
    a ``resume`` folder every fitted model is kept there and a restart with the same
    arguments goes on from them.
    """
    rows = df.where(F.col(target).isNotNull())
    log_target = bool(X.target_profile(rows, target, keys, seed).first()["use_log1p"])
    y: Column = F.log1p(target) if log_target else F.col(target).cast("double")
    used = list(dict.fromkeys([*keys, target, *numeric, *categorical]))
    train, test = train_test_split(rows.select(*used, y.alias("label")), keys, 0.2, seed)
    options = {"power": True, "outlier_z": 3.0, "max_categories": 10}
    held_sets: list[DataFrame] = []

    def hold(data: DataFrame) -> DataFrame:
        held_sets.append(data.persist(StorageLevel.MEMORY_AND_DISK))
        return held_sets[-1]

    n_train = train.count()
    with kept(fits.packed(train, n_train)) as train, kept(fits.packed(test, n_train)) as judged:
        candidates = models or default_regressors(n_train, seed)
        try:
            fitted = X.fit_columns(train, numeric, categorical, **options)
            basic = X.fit_preprocessor(train, numeric, categorical, fitted=fitted, **options)
            ready, unseen = (hold(basic.transform(data).select("label", "features")) for data in (train, judged))
            names = X.vector_names(ready)
            picked = X.selector_stage(min(k, len(names))).fit(ready)
            pca, pca_table = X.fit_pca(ready)
            chosen = [names[i] for i in picked.selectedFeatures]
            spread = ready.select("label", vector_to_array("features").alias("v")).select(
                "label", *[F.col("v")[i].alias(names[i]) for i in picked.selectedFeatures]
            )
            top = X.f_regression(spread, chosen, "label")
            terms, ols = ols_hc3(spread, chosen, "label")
            matrices: dict[str, tuple[DataFrame, DataFrame, str]] = {"Basic": (ready, unseen, "features")}
            heads: dict[str, tuple[list, str, str]] = {}
            for route in routes:
                source = route
                if route == "Basic":
                    head, vector = basic.stages, "features"
                elif route == "Feature Selection":
                    head, vector = [*basic.stages, picked], "selected"
                    if len(chosen) == len(names):
                        source = "Basic"
                    else:
                        sides = (picked.transform(ready), picked.transform(unseen))
                elif route == "PCA":
                    head, vector, sides = [*basic.stages, pca], "components", (pca.transform(ready), pca.transform(unseen))
                elif ratios or bands:
                    # derived columns come before the preprocessing, where the names still exist
                    derive = X.domain_stage(ratios, bands)
                    made = [r[0] for r in ratios] + [b[0] for b in bands]
                    own = X.fit_preprocessor(derive.transform(train), [*numeric, *made], categorical, fitted=fitted, **options)
                    chain = PipelineModel([derive, *own.stages])
                    head, vector, sides = chain.stages, "features", (chain.transform(train), chain.transform(judged))
                else:
                    head, vector, source = [X.domain_stage(), *basic.stages], "features", "Basic"
                if source not in matrices:
                    matrices[source] = (*(hold(data.select("label", vector)) for data in sides), vector)
                heads[route] = (head, vector, source)
            jobs, weight, shared = {}, {}, {}
            for route, (head, vector, source) in heads.items():
                fit_on, judge_on, column = matrices[source]
                for name, est in candidates.items():
                    if (source, name) in shared:
                        continue
                    shared[source, name] = full = f"{route} - {name}"
                    path = f"{resume.rstrip('/')}/{full.replace(' ', '_')}" if resume else None

                    def fit(full=full, est=est, head=head, vector=vector, column=column, fit_on=fit_on, judge_on=judge_on, path=path) -> Fitted:
                        model = fits.kept_model(path, lambda: fits.refitted(head, trees.fitted(fits.prepared(est, column), fit_on, n_train), vector))
                        predicted = model.stages[-1].copy().setFeaturesCol(column).transform(judge_on)
                        return Fitted(full, model, metrics=regression_metrics(predicted, "label", "prediction", log_target).first().asDict())

                    jobs[full], weight[full] = fit, fits.cost(est)
            done = fits.run_pool(jobs, parallelism, weight.get)
            results = {}
            for route, (head, vector, source) in heads.items():
                for name in candidates:
                    full, first = f"{route} - {name}", done[shared[source, name]]
                    own = first.model if full == first.name else fits.refitted(head, first.model.stages[-1], vector)
                    results[full] = Fitted(full, own, metrics=dict(first.metrics))
        finally:
            for data in held_sets:
                data.unpersist()
    return RegressionRun(results, log_target, test, top, pca_table, ols, terms, chosen)


def regression_table(spark, run: RegressionRun) -> DataFrame:
    rows = [
        (i, f.name, f.metrics["mse"], f.metrics["rmse"], f.metrics["mae"], f.metrics["r2"])
        for i, f in enumerate(run.results.values())
    ]
    return spark.createDataFrame(
        rows, "ordinal int, model string, mse double, rmse double, mae double, r2 double"
    )


def above_median_sweep(df: DataFrame, run: RegressionRun, target: str) -> DataFrame:
    """Threshold sweep of the best regressor as a classifier of "target above its median"."""
    median = exact_quantiles(df, [target], [0.5]).first()["quantile"]
    pred = run.best.model.transform(run.test)
    y = F.when(F.col(target) > F.lit(median), 1).otherwise(0)
    return threshold_sweep(pred.select(y.alias("y"), "prediction"), "prediction", "y")


@dataclass
class TargetRuns:
    """Everything that a run over several targets found: fits, sweeps, and one summary row per target."""

    runs: dict[str, RegressionRun]
    sweeps: dict[str, DataFrame]
    summary: DataFrame

    def save(self, folder: str) -> dict[str, str]:
        """Store every fitted pipeline and table; returns name -> path. Models load back with ``load_model``."""
        spark, root, paths = self.summary.sparkSession, folder.rstrip("/"), {}
        for target, run in self.runs.items():
            for name, fitted in run.results.items():
                label = f"{target}/models/{name.replace(' ', '_')}"
                paths[label] = save_model(fitted.model, f"{root}/{label}")
            tables = {
                "metrics": regression_table(spark, run), "features": run.top_features, "variance": run.pca_table, "ols": run.ols,
                "ols_terms": run.ols_terms, "sweep": self.sweeps[target],
            }
            for name, table in tables.items():
                paths[f"{target}/{name}"] = write_result(table, f"{root}/{target}/{name}", "parquet")
        paths["summary"] = write_result(self.summary, f"{root}/summary", "parquet")
        return paths


def multi_target(
    df: DataFrame, targets: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], keys: Sequence[str], resume: str | None = None, **options
) -> TargetRuns:
    """``compare_regressors`` for each target on the other columns, and the threshold sweep of its best model."""
    runs, sweeps, rows = {}, {}, []
    for target in targets:
        own = f"{resume.rstrip('/')}/{target}" if resume else None
        run = compare_regressors(df, target, [c for c in numeric if c != target], categorical, keys, resume=own, **options)
        sweep = above_median_sweep(df, run, target)
        best, f1, ols = run.best, best_threshold(sweep).first()["f1"], run.ols.first()
        runs[target], sweeps[target] = run, sweep
        rows.append((target, best.name, best.metrics["r2"], best.metrics["rmse"], best.metrics["mae"], f1, ols["aic"], ols["bic"], run.log_target))
    schema = "target string, best_model string, r2 double, rmse double, mae double, f1 double, aic double, bic double, log_target boolean"
    return TargetRuns(runs, sweeps, df.sparkSession.createDataFrame(rows, schema))


def multi_target_summary(
    df: DataFrame, targets: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], keys: Sequence[str], **options
) -> DataFrame:
    """One summary row per target: best model, fit, best F1, AIC, BIC, whether log-transformed."""
    return multi_target(df, targets, numeric, categorical, keys, **options).summary
