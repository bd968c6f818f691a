"""Model comparison, evaluation, tuning, scoring and regression-inference queries."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from statspark.operators import chartdata as C
from statspark.operators import features as X
from statspark.operators import models as M
from statspark.operators import regression as G
from statspark.plans.queries_tests import OC, oc
from statspark.plans.registry import Registry, r, report, table
from statspark.plans.sqlmath import norm_p2
from statspark.session import scratch_dir
from statspark.sources.models import load_model, save_model

REG = Registry()
OC_NUM = ["o_totalprice", "c_acctbal"]
OC_CAT = ["o_orderpriority", "c_mktsegment"]

SCORED = "s AS (SELECT l_quantity AS score, (l_linestatus = 'F')::INT AS y, (l_quantity > 25)::INT AS pred FROM lineitem)"


def scored(spark, d):
    y = F.when(F.col("l_linestatus") == "F", 1).otherwise(0)
    return table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("score"), y.alias("y"), (F.col("l_quantity") > 25).cast("int").alias("pred")
    )


@REG.query(
    "m18_roc_auc",
    f"WITH {SCORED}, k AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) "
    "SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / "
    "(count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 9) AS auc, count(*) FILTER (y = 1) AS n_pos, count(*) FILTER (y = 0) AS n_neg FROM k",
)
def _(spark, d):
    return report(M.roc_auc(scored(spark, d), "score", "y"), 9)


@REG.query(
    "m19_roc_points",
    f"WITH {SCORED}, v AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM s GROUP BY 1) SELECT score AS threshold, "
    "round(sum(q) OVER (ORDER BY score DESC) / sum(q) OVER ()::DOUBLE, 6) AS fpr, "
    "round(sum(p) OVER (ORDER BY score DESC) / sum(p) OVER ()::DOUBLE, 6) AS tpr FROM v "
    "UNION ALL SELECT 'infinity'::DOUBLE, 0.0, 0.0",
)
def _(spark, d):
    return report(M.roc_points(scored(spark, d), "score", "y"))


@REG.query(
    "m20_confusion",
    f"WITH {SCORED} SELECT y::BIGINT AS actual, count(*) FILTER (pred = 0) AS \"0\", count(*) FILTER (pred = 1) AS \"1\" FROM s GROUP BY 1",
)
def _(spark, d):
    return report(M.confusion_matrix(scored(spark, d), "y", "pred", [0, 1]))


@REG.query(
    "m21_classification_report",
    f"WITH {SCORED}, c AS (SELECT k AS label, count(*) FILTER (y = k) AS support, count(*) FILTER (pred = k) AS called, "
    "count(*) FILTER (y = k AND pred = k) AS hit FROM s, (VALUES (0), (1)) t(k) GROUP BY 1), "
    "m AS (SELECT label::VARCHAR AS label, hit / called::DOUBLE AS precision, hit / support::DOUBLE AS recall, "
    "2.0 * hit / (called + support) AS f1, support, hit FROM c), "
    "o AS (SELECT label, precision, recall, f1, support FROM m UNION ALL SELECT 'accuracy', sum(hit) / sum(support), "
    "sum(hit) / sum(support), sum(hit) / sum(support), sum(support) FROM m UNION ALL SELECT 'macro avg', avg(precision), avg(recall), "
    "avg(f1), sum(support) FROM m UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), "
    "sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m) "
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6)::DOUBLE AS f1, support::BIGINT AS support FROM o",
)
def _(spark, d):
    return report(M.classification_report(scored(spark, d), "y", "pred"))


GUESS = "g AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS pred FROM lineitem)"


@REG.query(
    "m25_regression_metrics",
    f"WITH {GUESS} SELECT round(avg((y - pred) ** 2), 2) AS mse, round(sqrt(avg((y - pred) ** 2)), 4) AS rmse, "
    "round(avg(abs(y - pred)), 4) AS mae, round(1 - avg((y - pred) ** 2) / var_pop(y), 6) AS r2 FROM g",
)
def _(spark, d):
    src = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("pred"))
    return report(M.regression_metrics(src, "y", "pred"), 4, mse=2, r2=6)


@REG.query(
    "m25_regression_metrics_log",
    f"WITH {GUESS}, l AS (SELECT y, pred, ln(1 + y) AS ly, ln(1 + pred) AS lp FROM g) SELECT round(avg((y - pred) ** 2), 2) AS mse, "
    "round(sqrt(avg((y - pred) ** 2)), 4) AS rmse, round(avg(abs(y - pred)), 4) AS mae, "
    "round(1 - avg((ly - lp) ** 2) / var_pop(ly), 6) AS r2 FROM l",
)
def _(spark, d):
    src = table(spark, d, "lineitem").select(
        F.log1p("l_extendedprice").alias("y"), F.log1p(F.col("l_quantity") * 1500).alias("pred")
    )
    return report(M.regression_metrics(src, "y", "pred", log_target=True), 4, mse=2, r2=6)


SWEEP_SQL = (
    f"WITH {SCORED}, k AS (SELECT y, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) / count(*) OVER () AS pct "
    "FROM s), t AS (SELECT i AS ordinal, round(0.3 + 0.02 * i, 2)::DOUBLE AS threshold FROM range(0, 20) r(i)), "
    "c AS (SELECT ordinal, threshold, count(*) FILTER (pct > threshold AND y = 1) AS tp, count(*) FILTER (pct > threshold) AS called, "
    "count(*) FILTER (y = 1) AS actual FROM k, t GROUP BY ALL), "
    "f AS (SELECT ordinal, threshold, tp / called::DOUBLE AS precision, tp / actual::DOUBLE AS recall, 2.0 * tp / (called + actual) AS f1 FROM c) "
    "SELECT ordinal, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6)::DOUBLE AS f1 FROM f"
)


@REG.query("m26_threshold_sweep", SWEEP_SQL)
def _(spark, d):
    return report(M.threshold_sweep(scored(spark, d), "score", "y"))


@REG.query("m26_best_threshold", SWEEP_SQL + " ORDER BY f.f1 DESC, ordinal LIMIT 1")
def _(spark, d):
    return report(M.best_threshold(M.threshold_sweep(scored(spark, d), "score", "y")))


# --- fitted models ----------------------------------------------------------


def split(spark, d):
    src = M.labelled(oc(spark, d), "o_orderstatus", "F").select("o_orderkey", "o_orderstatus", *OC_NUM, *OC_CAT, "label")
    return M.stratified_split(src, ["o_orderkey"], "o_orderstatus")


@REG.query("m17_compare_classifiers")
def _(spark, d):
    train, test = split(spark, d)
    return report(M.comparison_table(spark, M.compare_classifiers(train, test, OC_NUM, OC_CAT)))


def forest(spark, d):
    train, test = split(spark, d)
    models = {"Random Forest": M.default_classifiers(train.count())["Random Forest"]}
    return M.compare_classifiers(train, test, OC_NUM, OC_CAT, models)["Random Forest"].model, train, test


@REG.query("m22_feature_importance")
def _(spark, d):
    model, train, _test = forest(spark, d)
    return report(M.feature_importance(model, train))


@REG.query("m23_tune")
def _(spark, d):
    train, test = split(spark, d)
    name = M.best_model(M.compare_classifiers(train, test, OC_NUM, OC_CAT)).name
    _, scores = M.tune(train, OC_NUM, OC_CAT, ["o_orderkey"], name, M.default_classifiers(train.count())[name])
    return report(scores)


@REG.query("s03_model_round_trip")
def _(spark, d):
    model, _train, test = forest(spark, d)
    again = load_model(save_model(model, scratch_dir(spark, "model")))
    a = M.scored(model, test).select("o_orderkey", F.col("score").alias("before"))
    b = M.scored(again, test).select("o_orderkey", F.col("score").alias("after"))
    return a.join(b, "o_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("before") != F.col("after")).alias("n_changed")
    )


@REG.query("m27_batch_scoring")
def _(spark, d):
    model, _train, test = forest(spark, d)
    out = M.predict(model, test.select("o_orderkey", *OC_NUM, *OC_CAT), labels=("not F", "F"))
    return report(out.select("o_orderkey", "predicted", "probability"))


@REG.query("m28_dense_network")
def _(spark, d):
    train, test = split(spark, d)
    codes = {c: X.frequency_codes(train, c) for c in OC_CAT}

    def encode(df):
        for c in OC_CAT:
            df = X.frequency_encode(df, c, f"{c}_code", codes[c])
        return df

    inputs = [*OC_NUM, *[f"{c}_code" for c in OC_CAT]]
    model = M.dense_network(encode(train), inputs)
    return report(M.scored(model, encode(test)).select("o_orderkey", "score"))


@REG.query("m24_compare_regressors")
def _(spark, d):
    li = table(spark, d, "lineitem")
    run = M.compare_regressors(
        li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["l_returnflag"],
        ["l_orderkey", "l_linenumber", "l_partkey"], ratios=[("q_tax", "l_quantity", "l_tax")],
        bands=[("q_band", "l_quantity", [0, 10, 25, 50])],
    )
    return report(M.regression_table(spark, run), 4)


@REG.query("m29_multi_target")
def _(spark, d):
    part = table(spark, d, "part")
    # no derived columns: each of them would hold one of the targets
    out = M.multi_target_summary(part, ["p_retailprice", "p_size"], ["p_size", "p_retailprice"], ["p_type", "p_brand"], ["p_partkey"])
    return report(out, 4)


# --- regression inference ---------------------------------------------------


@REG.query("t26_logistic_inference")
def _(spark, d):
    return report(G.logistic_inference(oc(spark, d), OC_NUM, OC_CAT, "o_orderstatus", "F"))


#: With one binary predictor the logistic fit has a closed form: the log odds ratio of the 2x2 table.
BINARY_LOGIT = (
    f"{OC}, n AS (SELECT count(*) FILTER (u AND y)::DOUBLE AS a, count(*) FILTER (u AND NOT y)::DOUBLE AS b, count(*) FILTER (NOT u AND y)::DOUBLE AS c, "
    "count(*) FILTER (NOT u AND NOT y)::DOUBLE AS d FROM (SELECT o_orderpriority = '1-URGENT' AS u, o_orderstatus = 'F' AS y FROM oc)), "
    "w AS (SELECT 'urgent' AS term, ln(a * d / (b * c)) AS coef, sqrt(1 / a + 1 / b + 1 / c + 1 / d) AS se FROM n "
    "UNION ALL SELECT 'const', ln(c / d), sqrt(1 / c + 1 / d) FROM n)"
)


def binary_logit(spark, d):
    src = oc(spark, d).withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("double"))
    return G.logistic_inference(src, ["urgent"], [], "o_orderstatus", "F")


@REG.query(
    "t26_logistic_binary",
    f"WITH {BINARY_LOGIT} SELECT term, round(coef, 5) AS coef, round(se, 5) AS std_err, round(coef / se, 4) AS z, round({norm_p2('coef / se')}, 5) AS p_value, "
    "round(exp(coef), 5) AS odds_ratio, round(exp(coef - 1.959963984540054 * se), 5) AS ci_lower, "
    f"round(exp(coef + 1.959963984540054 * se), 5) AS ci_upper, {norm_p2('coef / se')} < 0.05 AS significant FROM w",
)
def _(spark, d):
    return report(binary_logit(spark, d), 5, z=4)


@REG.query(
    "c10_forest_logistic",
    f"WITH {BINARY_LOGIT} SELECT term, round(exp(coef), 5) AS odds_ratio, round(exp(coef) - exp(coef - 1.959963984540054 * se), 5) AS error_low, "
    "round(exp(coef + 1.959963984540054 * se) - exp(coef), 5) AS error_high FROM w",
)
def _(spark, d):
    return report(C.forest_rows(binary_logit(spark, d)).select("term", "odds_ratio", "error_low", "error_high"), 5)


@REG.query(
    "c12_fitted_line",
    "WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), "
    "h AS (SELECT *, md5(concat_ws('|', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, '42')) AS k FROM lineitem), "
    "s AS (SELECT * FROM h ORDER BY k, l_orderkey, l_linenumber, l_partkey LIMIT 5000) "
    "SELECT count(*) AS n, round(avg(a + b * l_quantity), 2) AS mean_predicted, round(avg(l_extendedprice), 2) AS mean_actual, "
    "(SELECT min(l_extendedprice) FROM lineitem) AS low, (SELECT max(l_extendedprice) FROM lineitem) AS high FROM s, f",
)
def _(spark, d):
    rows = table(spark, d, "lineitem")
    data = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(rows)
    fitted = LinearRegression(labelCol="l_extendedprice", solver="normal").fit(data).transform(data)
    pairs, ends = C.actual_vs_predicted(fitted, "l_extendedprice", "prediction", ["l_orderkey", "l_linenumber", "l_partkey"])
    means = pairs.agg(F.count("*").alias("n"), F.avg("predicted").alias("mean_predicted"), F.avg("actual").alias("mean_actual"))
    return report(means.crossJoin(F.broadcast(ends)), 2)


@REG.query(
    "t27_ols_hc3",
    "WITH g AS (SELECT avg(l_quantity) AS mx, avg(l_extendedprice) AS my, count(*)::DOUBLE AS n, var_pop(l_quantity) * count(*) AS sxx, "
    "regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), "
    "e AS (SELECT mx, n, sxx, a, b, l_quantity AS x, (l_extendedprice - a - b * l_quantity) / (1 - 1 / n - (l_quantity - mx) ** 2 / sxx) AS u "
    "FROM lineitem, g), "
    "v AS (SELECT a, b, sqrt(sum((x - mx) ** 2 * u * u)) / sxx AS sb, sqrt(sum((1 / n - mx * (x - mx) / sxx) ** 2 * u * u)) AS sa "
    "FROM e GROUP BY a, b, sxx) "
    "SELECT 'l_quantity' AS term, round(b, 4) AS coef, round(sb, 4) AS std_err, round(b / sb, 3) AS z FROM v UNION ALL "
    "SELECT 'const', round(a, 4), round(sa, 4), round(a / sa, 3) FROM v",
)
def _(spark, d):
    coef, _ = G.ols_hc3(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return report(coef.select("term", "coef", "std_err", "z"), 4, z=3)


@REG.query(
    "t27_ols_fit",
    "WITH g AS (SELECT count(*) AS n, regr_r2(l_extendedprice, l_quantity) AS r2, var_pop(l_extendedprice) * count(*) AS tss FROM lineitem), "
    "l AS (SELECT *, -n / 2.0 * (ln(2 * pi()) + ln((1 - r2) * tss / n) + 1) AS ll FROM g) "
    "SELECT n, round(r2, 6) AS r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2, round(-2 * ll + 4, 2) AS aic, "
    "round(-2 * ll + 2 * ln(n), 2) AS bic FROM l",
)
def _(spark, d):
    _, fit = G.ols_hc3(table(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice")
    return report(fit.select("n", "r2", "adj_r2", "aic", "bic"), 6, aic=2, bic=2)


@REG.query(
    "t27_significant_terms",
    f"WITH {OC}, s AS (SELECT c_acctbal AS x, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0 END AS w, o_totalprice AS y FROM oc), "
    "g AS (SELECT count(*)::DOUBLE AS n, avg(x) AS mx, avg(w) AS mw, avg(y) AS my FROM s), "
    "c AS (SELECT n, mx, mw, my, x - mx AS x, w - mw AS w, y - my AS y FROM s, g), "
    "m AS (SELECT sum(x * x) AS xx, sum(w * w) AS ww, sum(x * w) AS xw, sum(x * y) AS xy, sum(w * y) AS wy FROM c), "
    "b AS (SELECT *, xx * ww - xw * xw AS det, (ww * xy - xw * wy) / (xx * ww - xw * xw) AS bx, (xx * wy - xw * xy) / (xx * ww - xw * xw) AS bw FROM m), "
    "i AS (SELECT n, mx, mw, my, bx, bw, (ww * x - xw * w) / det AS ix, (xx * w - xw * x) / det AS iw, "
    "(y - bx * x - bw * w) / (1 - 1 / n - (ww * x * x - 2 * xw * x * w + xx * w * w) / det) AS u FROM c, b), "
    "v AS (SELECT bx, bw, my - bx * mx - bw * mw AS a, sqrt(sum((ix * u) ** 2)) AS sx, sqrt(sum((iw * u) ** 2)) AS sw, "
    "sqrt(sum(((1 / n - mx * ix - mw * iw) * u) ** 2)) AS sa FROM i GROUP BY ALL), "
    "t AS (SELECT 'c_acctbal' AS term, bx AS coef, sx AS std_err FROM v UNION ALL SELECT 'urgent', bw, sw FROM v UNION ALL SELECT 'const', a, sa FROM v), "
    f"p AS (SELECT *, {norm_p2('coef / std_err')} AS p_value FROM t) "
    "SELECT term, round(coef, 4) AS coef, round(std_err, 4) AS std_err, round(p_value, 6) AS p_value FROM p WHERE p_value < 0.05",
)
def _(spark, d):
    src = oc(spark, d).withColumn("urgent", (F.col("o_orderpriority") == "1-URGENT").cast("double"))
    coef, _ = G.ols_hc3(src, ["c_acctbal", "urgent"], "o_totalprice")
    return report(G.significant_terms(coef).select("term", r("coef", 4), r("std_err", 4), r("p_value")))
