"""Feature-engineering and sampling queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from statspark.operators import features as X
from statspark.operators import sampling as M
from statspark.plans.queries_profile import priced, union_sql
from statspark.plans.queries_tests import OC, oc
from statspark.plans.registry import Registry, report, table
from statspark.plans.sqlmath import f_p

REG = Registry()

UNKNOWN_BALANCE = "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS bal FROM customer"


def unknown_balance(spark, d):
    bal = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal"))
    return table(spark, d, "customer").withColumn("bal", bal)


@REG.query(
    "m01_median_impute",
    f"WITH u AS ({UNKNOWN_BALANCE}) SELECT c_custkey, round(coalesce(bal, (SELECT quantile_cont(bal, 0.5) FROM u)), 6) AS bal FROM u",
)
def _(spark, d):
    u = unknown_balance(spark, d)
    return report(X.fill(u, X.fit_medians(u, ["bal"])).select("c_custkey", "bal"))


UNKNOWN_PRIORITY = "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS pri FROM orders"


def unknown_priority(spark, d):
    pri = F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))
    return table(spark, d, "orders").withColumn("pri", pri)


@REG.query(
    "m02_mode_impute",
    f"WITH u AS ({UNKNOWN_PRIORITY}), m AS (SELECT pri FROM u WHERE pri IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, pri LIMIT 1) "
    "SELECT o_orderkey, coalesce(pri, (SELECT pri FROM m)) AS pri FROM u",
)
def _(spark, d):
    u = unknown_priority(spark, d)
    return X.fill(u, X.fit_modes(u, ["pri"])).select("o_orderkey", "pri")


@REG.query(
    "m03_standardise",
    "WITH g AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b, avg(p_retailprice) AS c, stddev_pop(p_retailprice) AS e FROM part) "
    "SELECT p_partkey, round((p_size - a) / b, 6) AS p_size, round((p_retailprice - c) / e, 6) AS p_retailprice FROM part, g",
)
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return report(X.standardise(part, X.fit_moments(part, ["p_size", "p_retailprice"])))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@REG.query(
    "m04_one_hot",
    "SELECT p_partkey, " + ", ".join(f"(p_type = '{t}')::INT::DOUBLE AS {t.lower()}" for t in TYPES) + " FROM part",
)
def _(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type")
    index, encode = X.one_hot_stages(["p_type"])
    model = index.fit(part)
    out = encode.fit(model.transform(part)).transform(model.transform(part))
    v = out.withColumn("v", vector_to_array("p_type__oh"))
    return v.select("p_partkey", *[F.col("v")[i].alias(t.lower()) for i, t in enumerate(model.labelsArray[0])])


@REG.query(
    "m05_merge_infrequent",
    "WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 9) "
    "SELECT p_partkey, CASE WHEN p_brand IN (SELECT p_brand FROM t) THEN p_brand ELSE '__infrequent__' END AS p_brand FROM part",
)
def _(spark, d):
    part = table(spark, d, "part")
    return X.merge_infrequent(part, "p_brand", X.fit_frequent(part, "p_brand", 10)).select("p_partkey", "p_brand")


LATER = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@REG.query(
    "m06_drop_first_dummies",
    f"WITH u AS ({UNKNOWN_PRIORITY}) SELECT o_orderkey, "
    + ", ".join(f"coalesce(pri = '{v}', FALSE)::INT::DOUBLE AS \"pri_{v}\"" for v in LATER)
    + ", (pri IS NULL)::INT::DOUBLE AS pri_nan FROM u",
)
def _(spark, d):
    out, made = X.drop_first_dummies(unknown_priority(spark, d), ["pri"])
    return out.select("o_orderkey", *[F.col(f"`{c}`") for c in made])


@REG.query(
    "m07_outliers",
    "WITH g AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, "
    "CASE WHEN abs(value - m) <= 3 * s THEN value END AS value FROM events, g",
)
def _(spark, d):
    ev = table(spark, d, "events").select("event_id", "value")
    return X.remove_outliers(ev, X.fit_moments(ev, ["value"]))


@REG.query(
    "m08_domain_features",
    "SELECT c_custkey, round(c_acctbal / nullif(c_nationkey, 0), 6) AS per_nation, CASE WHEN c_nationkey < 0 OR c_nationkey > 20 THEN NULL "
    "WHEN c_nationkey <= 5 THEN 1.0::DOUBLE WHEN c_nationkey <= 10 THEN 2.0::DOUBLE ELSE 3.0::DOUBLE END AS band FROM customer",
)
def _(spark, d):
    stage = X.domain_stage([("per_nation", "c_acctbal", "c_nationkey")], [("band", "c_nationkey", [0, 5, 10, 20])])
    return report(stage.transform(table(spark, d, "customer")).select("c_custkey", "per_nation", "band"))


@REG.query(
    "m09_yeo_johnson_fixed",
    "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.3) - 1) / 0.3 "
    "ELSE -(pow(1 - c_acctbal, 1.7) - 1) / 1.7 END, 4) AS c_acctbal FROM customer",
)
def _(spark, d):
    return report(X.yeo_johnson(table(spark, d, "customer").select("c_custkey", "c_acctbal"), {"c_acctbal": 0.3}), 4)


@REG.query("m09_yeo_johnson_fit")
def _(spark, d):
    ev = table(spark, d, "events").select("value")
    lam = X.fit_yeo_johnson(ev, ["value"])
    after = X.yeo_johnson(ev, lam)
    return report(after.agg(F.skewness("value").alias("skewness")).withColumn("lam", F.lit(lam["value"])), 4)


@REG.query(
    "m10_frequency_encode",
    "SELECT o_orderkey, round(count(*) OVER (PARTITION BY o_orderpriority) * 1.0::DOUBLE / count(*) OVER (), 9) AS code FROM orders",
)
def _(spark, d):
    return report(X.frequency_encode(table(spark, d, "orders"), "o_orderpriority", "code").select("o_orderkey", "code"), 9)


HASH = "md5(concat_ws('|', o_orderkey::VARCHAR, '42'))"


@REG.query(
    "m11_split",
    f"SELECT o_orderkey, CASE WHEN concat('0x', {HASH}[1:8])::BIGINT % 10000 < 2000 THEN 'test' ELSE 'train' END AS side FROM orders",
)
def _(spark, d):
    train, test = M.train_test_split(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@REG.query(
    "m11_stratified_split",
    f"SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {HASH}, o_orderkey) <= "
    "round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS is_test FROM orders",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return M.stratified_flags(o, ["o_orderkey"], "o_orderstatus")


@REG.query("m12_fixed_sample", f"SELECT o_orderkey FROM orders ORDER BY {HASH}, o_orderkey LIMIT 5000")
def _(spark, d):
    return M.fixed_sample(table(spark, d, "orders").select("o_orderkey"), ["o_orderkey"])


@REG.query("m13_target_profile")
def _(spark, d):
    return report(X.target_profile(table(spark, d, "events"), "value", ["event_id"]))


@REG.query(
    "m14_preprocess",
    "WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price, "
    "CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS pri FROM orders), "
    "m AS (SELECT pri FROM p WHERE pri IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, pri LIMIT 1), "
    "f AS (SELECT o_orderkey, coalesce(price, (SELECT quantile_cont(price, 0.5) FROM p)) AS price, coalesce(pri, (SELECT pri FROM m)) AS pri FROM p) "
    "SELECT o_orderkey, round((price - avg(price) OVER ()) / stddev_pop(price) OVER (), 6) AS v0, "
    "(pri = '1-URGENT')::INT::DOUBLE AS v1, (pri = '5-LOW')::INT::DOUBLE AS v5 FROM f",
)
def _(spark, d):
    p = priced(spark, d).withColumn("pri", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    model = X.fit_preprocessor(p, ["price"], ["pri"])
    v = model.transform(p).withColumn("v", vector_to_array("features"))
    return report(v.select("o_orderkey", *[F.col("v")[i].alias(f"v{i}") for i in (0, 1, 5)]))


F_COLS = ["l_quantity", "l_discount", "l_tax"]


@REG.query(
    "m15_f_regression",
    "WITH c AS ("
    + union_sql("SELECT '{c}' AS feature, corr({c}, l_extendedprice) AS r, count(*) - 2.0::DOUBLE AS dof FROM lineitem", F_COLS)
    + "), f AS (SELECT feature, r * r * dof / (1 - r * r) AS f, dof FROM c) "
    f"SELECT feature, round(f, 3) AS f_score, dof, round({f_p('f', '1.0', 'dof')}, 6) AS p_value FROM f",
)
def _(spark, d):
    return report(X.f_regression(table(spark, d, "lineitem"), F_COLS, "l_extendedprice"), f_score=3)


@REG.query(
    "m16_pca",
    f"WITH {OC}, r AS (SELECT abs(corr(o_totalprice, c_acctbal)) AS r FROM oc) "
    "SELECT 1::BIGINT AS component, round((1 + r) / 2, 6) AS variance_ratio, round((1 + r) / 2, 6) AS cumulative, TRUE AS kept FROM r "
    "UNION ALL SELECT 2, round((1 - r) / 2, 6), 1.0::DOUBLE, TRUE FROM r",
)
def _(spark, d):
    src = oc(spark, d)
    ready = X.fit_preprocessor(src, ["o_totalprice", "c_acctbal"], []).transform(src)
    _, variance = X.fit_pca(ready)
    return report(variance)
