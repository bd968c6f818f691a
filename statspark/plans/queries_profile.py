"""Sources, projection, joins, profiling, ranks, top-k, reshape and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statspark.functions import scalars as S
from statspark.operators import ordered as O
from statspark.operators import profile as P
from statspark.operators import rank as R
from statspark.plans.registry import Registry, r, report, table
from statspark.session import scratch_dir
from statspark.sources import tables as IO

REG = Registry()
LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def union_sql(template: str, cols) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


# --- sources and sinks ------------------------------------------------------


@REG.query("s01_csv_scan", "SELECT * FROM part")
def _(spark, d):
    part = table(spark, d, "part")
    path = IO.write_result(part, scratch_dir(spark, "part"), "csv")
    return IO.read_table(spark, path, "csv", part.schema)


@REG.query(
    "s02_result_sink",
    "SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1",
)
def _(spark, d):
    out = (
        table(spark, d, "orders")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("n"), r(F.avg("o_totalprice"), 4).alias("mean"))
    )
    path = IO.write_result(out, scratch_dir(spark, "result"))
    return IO.read_table(spark, path, schema=out.schema)


@REG.query("s04_record_input", "SELECT count(*) AS n, max(p_size)::BIGINT AS max_size FROM part")
def _(spark, d):
    part = IO.as_records(spark, table(spark, d, "part"))
    return part.agg(F.count("*").alias("n"), F.max("p_size").cast("long").alias("max_size"))


@REG.query("s04_plain_records", "SELECT p_brand, max(p_size)::BIGINT AS p_size, round(min(p_retailprice), 2) AS p_retailprice FROM part GROUP BY 1")
def _(spark, d):
    parts = table(spark, d, "part").groupBy("p_brand").agg(F.max("p_size").alias("p_size"), F.min("p_retailprice").alias("p_retailprice"))
    records = [r.asDict() for r in parts.collect()]  # one per brand
    one, rest = IO.as_records(spark, records[0], parts.schema), IO.as_records(spark, records[1:], parts.schema)
    return report(one.unionByName(rest), 2)


@REG.query(
    "s06_chart_lookup",
    "SELECT p_type AS level, count(*) AS n FROM part GROUP BY 1",
)
def _(spark, d):
    part = table(spark, d, "part")
    charts = {
        c: part.groupBy(F.col(c).alias("level")).agg(F.count("*").alias("n")) for c in ("p_type", "p_brand")
    }
    path = IO.write_charts(charts, scratch_dir(spark, "charts"))
    return IO.read_chart(spark, path, "p_type").select("level", "n")


# --- projection, filter, labels ---------------------------------------------


@REG.query(
    "p01_numeric_columns",
    union_sql(
        "SELECT '{c}' AS feature, count({c}) AS n FROM lineitem",
        ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LI_NUM],
    ),
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    return P.per_column(li, P.numeric_columns(li), {"n": F.count})


@REG.query("p02_drop_columns", "SELECT p_partkey, p_type, p_size, p_retailprice FROM part")
def _(spark, d):
    return P.drop_columns(table(spark, d, "part"), ["p_name", "p_brand", "not_there"])


@REG.query("p03_group_values", "SELECT l_quantity FROM lineitem WHERE l_linestatus = 'F' AND l_quantity IS NOT NULL")
def _(spark, d):
    return P.group_values(table(spark, d, "lineitem"), "l_linestatus", "F", "l_quantity")


def priced(spark, d):
    """Orders whose price is not known while they are pending."""
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, d, "orders").withColumn("price", price)


@REG.query(
    "p04_drop_missing_target",
    "SELECT o_orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'P'",
)
def _(spark, d):
    return P.drop_missing_target(priced(spark, d), "price").select("o_orderkey", "price")


@REG.query(
    "p05_outcome01",
    "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS positives, "
    "count(*) AS n FROM lineitem GROUP BY 1",
)
def _(spark, d):
    y = S.outcome01("l_linestatus", "F")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(y).alias("positives"), F.count("*").alias("n"))


@REG.query(
    "p06_binarise_at_median",
    "SELECT p_partkey, CASE WHEN p_size > (SELECT quantile_cont(p_size, 0.5) FROM part) THEN 1 ELSE 0 END AS big FROM part",
)
def _(spark, d):
    return P.binarise_at_median(table(spark, d, "part"), "p_size", "big").select("p_partkey", "big")


@REG.query(
    "p07_effect_label",
    "WITH g AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer) "
    "SELECT c_custkey, CASE WHEN e < 0.5 THEN 'Small' WHEN e < 0.8 THEN 'Medium' ELSE 'Large' END AS label "
    "FROM (SELECT c_custkey, abs(c_acctbal - m) / s AS e FROM customer, g)",
)
def _(spark, d):
    c = table(spark, d, "customer")
    g = c.agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))
    e = F.abs(F.col("c_acctbal") - F.col("m")) / F.col("s")
    return c.crossJoin(F.broadcast(g)).select("c_custkey", S.effect_label(e).alias("label"))


@REG.query(
    "p10_flags",
    "SELECT l_discount, l_discount < 0.05 AS significant, l_discount > 0.05 AS normal, count(*) AS n "
    "FROM lineitem GROUP BY ALL",
)
def _(spark, d):
    p = F.col("l_discount")
    return (
        table(spark, d, "lineitem")
        .groupBy(p, S.significant(p).alias("significant"), S.normal_flag(p).alias("normal"))
        .agg(F.count("*").alias("n"))
    )


@REG.query(
    "p11_decide",
    "SELECT p_partkey, CASE WHEN p_size / 50.0 > 0.5 THEN 'high' ELSE 'low' END AS decision FROM part",
)
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", S.decide(F.col("p_size") / 50.0, "high", "low").alias("decision")
    )


@REG.query(
    "p12_round_report",
    "SELECT l_returnflag, round(avg(l_discount), 3) AS discount, round(avg(l_tax), 3) AS tax FROM lineitem GROUP BY 1",
)
def _(spark, d):
    out = table(spark, d, "lineitem").groupBy("l_returnflag").agg(
        F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
    )
    return S.rounded(out, 3)


@REG.query("p13_shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_cols FROM lineitem")
def _(spark, d):
    return P.shape(table(spark, d, "lineitem"))


@REG.query("p13_head", "SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 5)")
def _(spark, d):
    return P.head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"])


# --- joins ------------------------------------------------------------------


@REG.query(
    "j01_keep_top_levels",
    "WITH t AS (SELECT p_brand FROM part GROUP BY 1 ORDER BY count(*) DESC, p_brand LIMIT 10) "
    "SELECT p_partkey, p_brand FROM part WHERE p_brand IN (SELECT p_brand FROM t)",
)
def _(spark, d):
    return P.keep_top_levels(table(spark, d, "part"), "p_brand", 10).select("p_partkey", "p_brand")


@REG.query(
    "j03_code_lookup",
    "SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 1.0::DOUBLE WHEN '2-HIGH' THEN 0.5::DOUBLE END AS code FROM orders",
)
def _(spark, d):
    return P.lookup(
        table(spark, d, "orders"), {"1-URGENT": 1.0, "2-HIGH": 0.5}, "o_orderpriority", "code"
    ).select("o_orderkey", "code")


# --- profiling --------------------------------------------------------------


@REG.query(
    "a01_numeric_summary",
    union_sql(
        "SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        "min({c}) AS min, max({c}) AS max FROM lineitem",
        LI_NUM,
    ),
)
def _(spark, d):
    return report(P.numeric_summary(table(spark, d, "lineitem"), LI_NUM))


@REG.query(
    "a02_median_iqr",
    union_sql(
        "SELECT '{c}' AS feature, round(quantile_cont({c}, 0.5), 6) AS median, "
        "round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr FROM lineitem",
        LI_NUM,
    ),
)
def _(spark, d):
    return report(P.median_iqr(table(spark, d, "lineitem"), LI_NUM))


@REG.query(
    "a03_skewness",
    union_sql("SELECT '{c}' AS feature, round(skewness({c}), 6) AS skewness FROM lineitem", LI_NUM)
    + " UNION ALL SELECT 'value', round(skewness(value), 6) FROM events",
)
def _(spark, d):
    out = P.shape_moments(table(spark, d, "lineitem"), LI_NUM).unionByName(
        P.shape_moments(table(spark, d, "events"), ["value"])
    )
    return report(out.select("feature", "skewness"))


@REG.query(
    "a04_kurtosis",
    union_sql("SELECT '{c}' AS feature, round(kurtosis({c}), 6) AS kurtosis FROM lineitem", LI_NUM)
    + " UNION ALL SELECT 'value', round(kurtosis(value), 6) FROM events",
)
def _(spark, d):
    out = P.shape_moments(table(spark, d, "lineitem"), LI_NUM).unionByName(
        P.shape_moments(table(spark, d, "events"), ["value"])
    )
    return report(out.select("feature", "kurtosis"))


@REG.query(
    "a05_describe",
    union_sql(
        "SELECT '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        "min({c}) AS min, max({c}) AS max, round(quantile_cont({c}, 0.25), 6) AS q25, "
        "round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75 FROM lineitem",
        LI_NUM,
    ),
)
def _(spark, d):
    return report(P.describe(table(spark, d, "lineitem"), LI_NUM))


@REG.query(
    "a05_numeric_profile",
    "SELECT 'value' AS feature, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, "
    "round(stddev_samp(value), 6) AS std, min(value) AS min, max(value) AS max, "
    "round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr, "
    "round(skewness(value), 6) AS skewness, round(kurtosis(value), 6) AS kurtosis FROM events",
)
def _(spark, d):
    return report(P.numeric_profile(table(spark, d, "events"), ["value"]))


@REG.query(
    "a06_frequencies",
    union_sql(
        "SELECT '{c}' AS factor, {c} AS level, count(*) AS n, "
        "round(100.0 * count(*) / (SELECT count({c}) FROM lineitem), 6) AS pct FROM lineitem GROUP BY {c}",
        ["l_returnflag", "l_linestatus"],
    ),
)
def _(spark, d):
    return report(P.frequencies(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"]))


@REG.query(
    "a07_missing",
    "SELECT 'o_totalprice' AS feature, 'double' AS dtype, count(*) - count(o_totalprice) AS n_missing, "
    "round(100.0 * (count(*) - count(o_totalprice)) / count(*), 6) AS pct_missing FROM orders UNION ALL "
    "SELECT 'price', 'double', count(*) FILTER (o_orderstatus = 'P'), "
    "round(100.0 * count(*) FILTER (o_orderstatus = 'P') / count(*), 6) FROM orders",
)
def _(spark, d):
    return report(P.missing_report(priced(spark, d), ["o_totalprice", "price"]))


@REG.query(
    "a08_group_summary",
    union_sql(
        "SELECT l_linestatus, '{c}' AS feature, count({c}) AS n, round(avg({c}), 6) AS mean, "
        "round(stddev_samp({c}), 6) AS std, round(quantile_cont({c}, 0.5), 6) AS median FROM lineitem GROUP BY 1",
        LI_NUM,
    ),
)
def _(spark, d):
    return report(P.group_summary(table(spark, d, "lineitem"), "l_linestatus", LI_NUM))


CROSS = "count(*) FILTER (l_linestatus = 'F') AS \"F\", count(*) FILTER (l_linestatus = 'O') AS \"O\""


@REG.query("a09_crosstab", f"SELECT l_returnflag, {CROSS} FROM lineitem GROUP BY 1")
def _(spark, d):
    return P.crosstab(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@REG.query(
    "a10_crosstab_percent",
    "SELECT l_returnflag, round(100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 6) AS \"F\", "
    "round(100.0 * count(*) FILTER (l_linestatus = 'O') / count(*), 6) AS \"O\" FROM lineitem GROUP BY 1",
)
def _(spark, d):
    return report(P.crosstab_percent(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus"))


@REG.query(
    "a11_distinct_counts",
    union_sql(
        "SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct FROM lineitem",
        ["l_returnflag", "l_quantity", "l_discount", "l_suppkey"],
    ),
)
def _(spark, d):
    return P.distinct_counts(table(spark, d, "lineitem"), ["l_returnflag", "l_quantity", "l_discount", "l_suppkey"])


@REG.query("a11_distinct_values", "SELECT DISTINCT p_brand FROM part")
def _(spark, d):
    return P.distinct_values(table(spark, d, "part"), "p_brand")


@REG.query(
    "a12_mode",
    union_sql(
        "SELECT * FROM (SELECT '{c}' AS factor, {c} AS level, count(*) AS n FROM part GROUP BY {c} "
        "ORDER BY n DESC, {c} LIMIT 1)",
        ["p_type", "p_brand"],
    ),
)
def _(spark, d):
    return P.mode_levels(table(spark, d, "part"), ["p_type", "p_brand"])


@REG.query(
    "a14_positive_rates",
    "SELECT l_returnflag AS level, count(*) AS n, round(avg((l_linestatus = 'F')::INT), 6) AS rate, "
    "(SELECT round(avg((l_linestatus = 'F')::INT), 6) FROM lineitem) AS overall_rate FROM lineitem GROUP BY 1",
)
def _(spark, d):
    return report(P.positive_rates(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "F"))


@REG.query(
    "a15_two_factor_means",
    "SELECT l_returnflag, round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6) AS \"F\", "
    "round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6) AS \"O\" FROM lineitem GROUP BY 1",
)
def _(spark, d):
    return report(
        P.two_factor_means(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", ["F", "O"])
    )


@REG.query(
    "a16_tail_range",
    "SELECT 'value' AS feature, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95, "
    "min(value) AS min, max(value) AS max FROM events",
)
def _(spark, d):
    return report(P.tail_range(table(spark, d, "events"), ["value"]))


@REG.query(
    "a17_tukey_outliers",
    "WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events) "
    "SELECT 'value' AS feature, round(min(a - 1.5 * (b - a)), 6) AS lower, round(min(b + 1.5 * (b - a)), 6) AS upper, "
    "count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) AS n_outliers, "
    "round(100.0 * count(*) FILTER (value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)) / count(*), 6) "
    "AS pct_outliers FROM events, q",
)
def _(spark, d):
    return report(P.tukey_outliers(table(spark, d, "events"), ["value"]))


@REG.query(
    "a18_top_rate_level",
    "SELECT p_type AS level, round(avg((p_size > 25)::INT), 6) AS rate FROM part GROUP BY 1 "
    "ORDER BY avg((p_size > 25)::INT) DESC, 1 LIMIT 1",
)
def _(spark, d):
    part = table(spark, d, "part").withColumn("big", F.when(F.col("p_size") > 25, "yes").otherwise("no"))
    return report(P.top_rate_level(part, "p_type", "big", "yes"))


# --- ranks and running values -----------------------------------------------


@REG.query(
    "w01_midrank",
    "SELECT event_id, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0::DOUBLE AS midrank "
    "FROM events",
)
def _(spark, d):
    return R.with_midranks(table(spark, d, "events"), {"value": "midrank"}).select("event_id", "midrank")


@REG.query(
    "w02_percent_rank",
    "SELECT event_id, round((rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0) "
    "/ (count(*) OVER ()), 6)::DOUBLE AS pct_rank FROM events",
)
def _(spark, d):
    return report(R.with_percent_ranks(table(spark, d, "events"), "value").select("event_id", "pct_rank"))


@REG.query(
    "w03_cumulative_share",
    "WITH s AS (SELECT o_orderpriority, count(*) * 1.0 / (SELECT count(*) FROM orders) AS share FROM orders GROUP BY 1) "
    "SELECT o_orderpriority, round(share, 6)::DOUBLE AS share, "
    "round(sum(share) OVER (ORDER BY o_orderpriority), 6)::DOUBLE AS cum_share FROM s",
)
def _(spark, d):
    o = table(spark, d, "orders")
    share = (
        o.groupBy("o_orderpriority")
        .agg(F.count("*").alias("n"))
        .crossJoin(F.broadcast(o.agg(F.count("*").alias("total"))))
        .select("o_orderpriority", (F.col("n") / F.col("total")).alias("share"))
    )
    return report(R.cumulative(share, "o_orderpriority", "share", "cum_share"))


@REG.query(
    "w04_running_balance",
    "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
    "ROWS UNBOUNDED PRECEDING), 4) AS balance FROM events",
)
def _(spark, d):
    ev = table(spark, d, "events")
    return report(O.running_sum(ev, ["user_id"], ["ts", "event_id"], "value", "balance").select("event_id", "balance"), 4)


@REG.query(
    "w05_byte_budget",
    "SELECT conv_id, turn FROM (SELECT conv_id, turn, strlen(text) AS b, sum(strlen(text)) OVER "
    "(PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS w FROM conversations) WHERE w - b < 1500",
)
def _(spark, d):
    conv = table(spark, d, "conversations")
    return O.byte_budget(conv, ["conv_id"], ["turn"], "text", 1500).select("conv_id", "turn")


# --- sort and top-k ---------------------------------------------------------


@REG.query(
    "k01_by_magnitude",
    "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20",
)
def _(spark, d):
    return P.by_magnitude(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"], 20)


@REG.query(
    "k02_multi_key_sort",
    "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2 ORDER BY p_brand DESC, n DESC, p_type LIMIT 15",
)
def _(spark, d):
    g = table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return P.top_k(g, [F.desc("p_brand"), F.desc("n"), F.asc("p_type")], 15)


@REG.query(
    "k03_top_k",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return P.top_k(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@REG.query(
    "k04_top_levels",
    "SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10",
)
def _(spark, d):
    return P.top_levels(table(spark, d, "part"), "p_brand", 10)


@REG.query(
    "k05_best_by",
    "SELECT p_brand, round(avg(p_retailprice), 6) AS price FROM part GROUP BY 1 "
    "ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 1",
)
def _(spark, d):
    g = table(spark, d, "part").groupBy("p_brand").agg(F.avg("p_retailprice").alias("price"))
    return report(P.best_by(g, "price", "p_brand"))


# --- reshape ----------------------------------------------------------------


@REG.query(
    "r01_melt",
    "SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL "
    "SELECT p_partkey, 'p_retailprice', p_retailprice FROM part",
)
def _(spark, d):
    part = table(spark, d, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return P.melt(part, ["p_partkey"], ["p_size", "p_retailprice"])


@REG.query(
    "r02_pivot",
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"F\", count(*) FILTER (o_orderstatus = 'O') AS "
    "\"O\", count(*) FILTER (o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1",
)
def _(spark, d):
    return P.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@REG.query(
    "r03_transpose",
    "WITH s AS (SELECT avg(l_quantity) AS q, avg(l_tax) AS t, max(l_quantity) AS qx, max(l_tax) AS tx FROM lineitem) "
    "SELECT 'mean' AS statistic, round(q, 6) AS l_quantity, round(t, 6) AS l_tax FROM s UNION ALL "
    "SELECT 'max', round(qx, 6), round(tx, 6) FROM s",
)
def _(spark, d):
    s = P.numeric_summary(table(spark, d, "lineitem"), ["l_quantity", "l_tax"]).select("feature", "mean", "max")
    return report(P.transpose(s, "feature", ["l_quantity", "l_tax"]))


@REG.query(
    "r04_dummies",
    "SELECT o_orderkey, (o_orderstatus = 'F')::INT AS \"o_orderstatus_F\", (o_orderstatus = 'O')::INT AS "
    "\"o_orderstatus_O\" FROM orders",
)
def _(spark, d):
    out = P.dummies(table(spark, d, "orders"), "o_orderstatus", ["F", "O"])
    return out.select("o_orderkey", "o_orderstatus_F", "o_orderstatus_O")


@REG.query(
    "r05_stack_rows",
    "SELECT p_type AS level, count(*) AS n, NULL::DOUBLE AS price FROM part GROUP BY 1 UNION ALL "
    "SELECT p_brand, NULL, round(avg(p_retailprice), 6) FROM part GROUP BY 1",
)
def _(spark, d):
    part = table(spark, d, "part")
    a = part.groupBy(F.col("p_type").alias("level")).agg(F.count("*").alias("n"))
    b = part.groupBy(F.col("p_brand").alias("level")).agg(F.avg("p_retailprice").alias("price"))
    return report(P.stack_rows([a, b]))


# --- scalar functions -------------------------------------------------------


@REG.query(
    "f01_log_exp",
    "SELECT p_partkey, round(ln(p_retailprice), 6) AS ln, round(exp(-p_size / 10.0), 6) AS ex, "
    "round(sqrt(p_retailprice), 6) AS sq, abs(p_size - 25)::BIGINT AS ab FROM part",
)
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey",
        r(F.log("p_retailprice")).alias("ln"),
        r(F.exp(-F.col("p_size") / 10)).alias("ex"),
        r(F.sqrt("p_retailprice")).alias("sq"),
        F.abs(F.col("p_size") - 25).cast("long").alias("ab"),
    )


@REG.query(
    "f02_log1p_expm1",
    "SELECT p_partkey, round(ln(1 + p_retailprice), 6) AS l1, round(exp(p_size / 10.0) - 1, 6) AS e1 FROM part",
)
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", r(F.log1p("p_retailprice")).alias("l1"), r(F.expm1(F.col("p_size") / 10)).alias("e1")
    )


@REG.query(
    "f03_safe_ratio",
    "SELECT l_returnflag, round(sum(l_quantity / nullif(l_discount, 0)), 2) AS total, "
    "count(l_quantity / nullif(l_discount, 0)) AS n FROM lineitem GROUP BY 1",
)
def _(spark, d):
    ratio = S.safe_ratio(F.col("l_quantity"), F.col("l_discount"))
    return (
        table(spark, d, "lineitem")
        .groupBy("l_returnflag")
        .agg(r(F.sum(ratio), 2).alias("total"), F.count(ratio).alias("n"))
    )


@REG.query(
    "f04_not_finite",
    "SELECT c_custkey, CASE WHEN c_nationkey > 0 THEN c_acctbal END AS x FROM customer",
)
def _(spark, d):
    x = F.when(F.col("c_nationkey") == 0, F.lit(float("-inf"))).otherwise(F.col("c_acctbal"))
    return table(spark, d, "customer").select("c_custkey", S.null_if_not_finite(x).alias("x"))


@REG.query(
    "f05_band",
    "SELECT p_partkey, CASE WHEN p_size < 0 OR p_size > 45 THEN NULL WHEN p_size <= 10 THEN 1 WHEN p_size <= 25 THEN 2 "
    "WHEN p_size <= 40 THEN 3 ELSE 4 END AS band FROM part",
)
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", S.band(F.col("p_size"), [0, 10, 25, 40, 45]).alias("band"))


@REG.query(
    "f06_median_fill",
    "WITH p AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders) "
    "SELECT o_orderkey, round(coalesce(price, (SELECT quantile_cont(price, 0.5) FROM p)), 6) AS price FROM p",
)
def _(spark, d):
    p = priced(spark, d)
    median = R.quantile_map(p, ["price"], 0.5)["price"]
    return report(p.select("o_orderkey", F.coalesce("price", F.lit(median)).alias("price")))


@REG.query(
    "f07_normal_pdf",
    "WITH g AS (SELECT avg(p_size) AS m, stddev_samp(p_size) AS s FROM part) SELECT p_partkey, "
    "round(exp(-((p_size - m) / s) * ((p_size - m) / s) / 2) / (s * sqrt(2 * pi())), 9) AS pdf FROM part, g",
)
def _(spark, d):
    part = table(spark, d, "part")
    g = part.agg(F.avg("p_size").alias("m"), F.stddev_samp("p_size").alias("s"))
    pdf = S.normal_pdf(F.col("p_size"), F.col("m"), F.col("s"))
    return part.crossJoin(F.broadcast(g)).select("p_partkey", r(pdf, 9).alias("pdf"))


@REG.query(
    "f08_format",
    "SELECT p_partkey, printf('%.4f', p_retailprice) AS price, lower(replace(p_name, ' ', '_')) AS slug FROM part",
)
def _(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", S.fixed(F.col("p_retailprice"), 4).alias("price"), S.slug(F.col("p_name")).alias("slug")
    )


@REG.query(
    "f09_prefix_tag",
    "SELECT o_orderkey, substr(o_orderpriority, 1, 1)::INT AS tag, split_part(substr(o_orderpriority, 3), ' ', 1) AS word "
    "FROM orders",
)
def _(spark, d):
    p = F.col("o_orderpriority")
    rest = F.expr("substring(o_orderpriority, 3)")
    return table(spark, d, "orders").select(
        "o_orderkey", F.substring(p, 1, 1).cast("int").alias("tag"), F.split(rest, " ")[0].alias("word")
    )
