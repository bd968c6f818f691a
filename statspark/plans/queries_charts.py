"""Chart-data, findings and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statspark.operators import anova as V
from statspark.operators import association as A
from statspark.operators import chartdata as C
from statspark.operators import findings as E
from statspark.operators import hypothesis as H
from statspark.operators import regression as G
from statspark.plans.queries_actionlog import RESULTS, RN, event_log
from statspark.plans.queries_features import HASH
from statspark.plans.queries_profile import LI_NUM
from statspark.plans.queries_tests import (
    CHI_OUT, MOMENTS, MWU, OC, OC_FACTORS, OC_NUM, PBS, PT_COLS, PT_PAIRS, RISK_OUT, TEST_OUT, TESTED,
    chi_sql, corr_sql, li, oc, risk_sql,
)
from statspark.plans.registry import Registry, report, table
from statspark.plans.sqlmath import chi2_p, norm_p2
from statspark.session import scratch_dir
from statspark.streaming import logs as X

REG = Registry()


def ev(spark, d):
    return table(spark, d, "events")


# --- charts -----------------------------------------------------------------

EXT = "g AS (SELECT min(value) AS lo, max(value) AS hi, count(value) AS n, avg(value) AS m, stddev_samp(value) AS s FROM events)"


@REG.query(
    "c01_histogram",
    f"WITH {EXT}, b AS (SELECT least(floor((value - lo) / ((hi - lo) / 50)), 49)::BIGINT AS bin, lo, hi, n FROM events, g) "
    "SELECT bin, round(lo + bin * (hi - lo) / 50, 6) AS left_edge, count(*) AS n, round(count(*) / (n * (hi - lo) / 50), 9) AS density "
    "FROM b GROUP BY bin, lo, hi, b.n",
)
def _(spark, d):
    return report(C.histogram(ev(spark, d), "value"), left_edge=6, density=9)


@REG.query(
    "c01_normal_curve",
    f"WITH {EXT} SELECT i AS point, round(lo + (hi - lo) * i / 99, 6) AS x, "
    "round(exp(-1 * (((lo + (hi - lo) * i / 99 - m) / s) ** 2) / 2) / (s * sqrt(2 * pi())), 9) AS density FROM g, range(100) r(i)",
)
def _(spark, d):
    return report(C.normal_curve(ev(spark, d), "value"), density=9)


@REG.query(
    "c02_kde",
    f"WITH {EXT}, b AS (SELECT least(floor((value - lo) / ((hi - lo) / 1000)), 999) AS bin, count(*) AS c FROM events, g GROUP BY 1) "
    "SELECT i AS point, round(lo + (hi - lo) * i / 199, 6) AS x, round(sum(c * exp(-1 * (((lo + (hi - lo) * i / 199 - lo - (hi - lo) * (bin + 0.5) / 1000) "
    "/ (n ** (-0.2) * s)) ** 2) / 2) / (n ** (-0.2) * s * sqrt(2 * pi())) / n), 8) AS density FROM g, b, range(200) r(i) GROUP BY i, lo, hi",
)
def _(spark, d):
    return report(C.kde(ev(spark, d), "value"), density=8)


@REG.query(
    "c03_qq_points",
    "WITH v AS (SELECT value, row_number() OVER (ORDER BY value) AS i, count(*) OVER () AS n FROM events), "
    "k AS (SELECT floor(j * ((SELECT count(*) FROM events) - 1) / 999.0::DOUBLE)::BIGINT + 1 AS i FROM range(1000) r(j)) "
    "SELECT i AS position, round(CASE WHEN i = n THEN 0.5 ** (1.0 / n) WHEN i = 1 THEN 1 - 0.5 ** (1.0 / n) "
    "ELSE (i - 0.3175) / (n + 0.365) END, 6)::DOUBLE AS p, value AS sample FROM v JOIN k USING (i)",
)
def _(spark, d):
    return report(C.qq_points(ev(spark, d), "value").select("position", "p", "sample"))


@REG.query("c03_qq_line")
def _(spark, d):
    return report(C.qq_line(ev(spark, d), "value"))


@REG.query(
    "c04_box_stats",
    "WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 "
    "FROM events GROUP BY 1), f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q) "
    "SELECT event_type, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, min(value) FILTER (value BETWEEN lo AND hi) AS whisker_low, "
    "max(value) FILTER (value BETWEEN lo AND hi) AS whisker_high, count(*) FILTER (NOT value BETWEEN lo AND hi) AS n_outliers, "
    "round(avg(value), 6) AS mean FROM events JOIN f USING (event_type) GROUP BY event_type, q1, median, q3",
)
def _(spark, d):
    return report(C.box_stats(ev(spark, d), "value", "event_type"))


@REG.query(
    "c05_violin",
    "WITH g AS (SELECT event_type, min(value) AS lo, max(value) AS hi, count(value) AS n, stddev_samp(value) AS s, quantile_cont(value, 0.25) AS q1, "
    "quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1), "
    "b AS (SELECT event_type, least(floor((value - lo) / ((hi - lo) / 1000)), 999) AS bin, count(*) AS c FROM events JOIN g USING (event_type) GROUP BY ALL), "
    "k AS (SELECT event_type, i, lo + (hi - lo) * i / 49 AS x, lo + (hi - lo) * (bin + 0.5) / 1000 AS centre, n ** (-0.2) * s AS h, c / n AS share, "
    "q1, median, q3 FROM g JOIN b USING (event_type), range(50) r(i)) "
    "SELECT event_type, i AS point, round(x, 6) AS x, round(sum(share * exp(-1 * (((x - centre) / h) ** 2) / 2) / (h * sqrt(2 * pi()))), 6) AS density, "
    "round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3 FROM k GROUP BY ALL",
)
def _(spark, d):
    return report(C.violin(ev(spark, d), "value", "event_type", points=50))


@REG.query(
    "c06_percent_bars",
    "SELECT l_returnflag, y AS outcome, round(100.0 * count(*) FILTER (l_linestatus = y) / count(*), 6) AS pct "
    "FROM lineitem, (VALUES ('F'), ('O')) t(y) GROUP BY ALL",
)
def _(spark, d):
    return report(C.percent_bars(li(spark, d), "l_returnflag", "l_linestatus", ["F", "O"]))


@REG.query(
    "c07_heatmap",
    f"SELECT feature_1, feature_2, round(r, 6) AS r, n FROM ({corr_sql('part', [(a, b) for a in PT_COLS for b in PT_COLS])})",
)
def _(spark, d):
    return report(C.correlation_heatmap(table(spark, d, "part"), PT_COLS))


@REG.query(
    "c08_scatter_sample",
    f"SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY {HASH}, o_orderkey LIMIT 5000",
)
def _(spark, d):
    return C.scatter_sample(table(spark, d, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])


@REG.query(
    "c08_trend_line",
    "SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem",
)
def _(spark, d):
    return report(C.trend_line(li(spark, d), "l_quantity", "l_extendedprice"), intercept=4)


@REG.query(
    "c09_mosaic",
    "SELECT l_returnflag, l_linestatus, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 6) AS share FROM lineitem GROUP BY ALL",
)
def _(spark, d):
    return report(C.mosaic(li(spark, d), "l_returnflag", "l_linestatus"))


@REG.query(
    "c10_forest",
    risk_sql(OC, "oc", OC_FACTORS, "o_orderstatus = 'F'")
    + " SELECT factor, level, round(o_r, 6) AS odds_ratio, round(o_r - exp(ln(o_r) - m), 6) AS error_low, round(exp(ln(o_r) + m) - o_r, 6) AS error_high "
    "FROM z WHERE o_r > 0",
)
def _(spark, d):
    return report(C.forest_of_risks(oc(spark, d), OC_FACTORS, "o_orderstatus", "F"))


@REG.query(
    "c11_interaction_means",
    f"WITH {OC} "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS factor, '{c}' AS feature, {f} AS level, round(avg({c}) FILTER (o_orderstatus = 'F'), 4) AS \"F\", "
        f"round(avg({c}) FILTER (o_orderstatus = 'O'), 4) AS \"O\" FROM oc GROUP BY {f}"
        for f in OC_FACTORS for c in OC_NUM
    ),
)
def _(spark, d):
    # every interaction is shown: alpha above 1
    src = oc(spark, d)
    two = V.two_way(src, OC_FACTORS, OC_NUM, "o_orderstatus", "F")
    return report(C.interaction_means(src, two, "o_orderstatus", ["F", "O"], alpha=1.1), 4)


@REG.query(
    "c12_actual_vs_predicted",
    f"SELECT o_orderkey, o_totalprice AS actual, o_custkey * 100.0::DOUBLE AS predicted FROM orders ORDER BY {HASH}, o_orderkey LIMIT 5000",
)
def _(spark, d):
    o = table(spark, d, "orders").withColumn("pred", F.col("o_custkey") * 100.0)
    return C.actual_vs_predicted(o, "o_totalprice", "pred", ["o_orderkey"])[0]


@REG.query(
    "c13_outcome_bars",
    "SELECT l_linestatus AS label, count(*)::DOUBLE AS value FROM lineitem GROUP BY 1",
)
def _(spark, d):
    counts = li(spark, d).groupBy("l_linestatus").agg(F.count("*").alias("n"))
    return C.scored_bars(counts, "l_linestatus", "n")


# --- findings ---------------------------------------------------------------


@REG.query(
    "e01_top_correlates",
    TESTED.format(src=PBS) + f" SELECT feature, {TEST_OUT} FROM p ORDER BY abs(p.r) DESC, feature LIMIT 3",
)
def _(spark, d):
    return report(E.top_correlates(A.outcome_correlations(li(spark, d), LI_NUM, "l_linestatus", "F")))


# a status that depends on the price, so that there is something to find
DEAR = "dr AS (SELECT *, CASE WHEN l_extendedprice + l_orderkey % 7 * 9000 > 80000 THEN 'Yes' ELSE 'No' END AS dear FROM lineitem)"


def dear(spark, d):
    cost = F.col("l_extendedprice") + F.col("l_orderkey") % 7 * 9000
    return li(spark, d).withColumn("dear", F.when(cost > 80000, "Yes").otherwise("No"))


DEAR_MWU = MWU.replace("l_linestatus", "dear").replace("FROM lineitem", "FROM dr").replace("'F'", "'No'").replace("WITH r", f"WITH {DEAR}, r", 1)
DEAR_D = (
    "m AS (" + MOMENTS.removeprefix("WITH m AS (").replace("l_linestatus", "dear").replace("FROM lineitem", "FROM dr")
    .replace("'F'", "'No'").replace("'O'", "'Yes'")
)


@REG.query(
    "e02_top_differences",
    f"{DEAR_MWU}, {DEAR_D}, t AS (SELECT feature, u, {norm_p2('greatest(z, 0)')} AS p, abs(m1 - m2) / sqrt((v1 + v2) / 2) AS d FROM z JOIN m USING (feature)) "
    "SELECT feature, 'Mann-Whitney U test' AS test, u::DOUBLE AS statistic, round(p, 6) AS p_value, TRUE AS significant, round(d, 6) AS effect_size, "
    "CASE WHEN d < 0.5 THEN 'Small' WHEN d < 0.8 THEN 'Medium' ELSE 'Large' END AS magnitude FROM t WHERE p < 0.05 ORDER BY d DESC, feature LIMIT 5",
)
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return report(E.top_differences(H.choose_tests(dear(spark, d), LI_NUM, keys, "dear", "No", "Yes")))


DEAR_CHI = chi_sql(DEAR + ", dz AS (SELECT *, CASE WHEN l_extendedprice > 52000 THEN 'Yes' ELSE 'No' END AS many FROM dr)", "dz", ["l_returnflag", "many"], "dear")


def dear_many(spark, d):
    return dear(spark, d).withColumn("many", F.when(F.col("l_extendedprice") > 52000, "Yes").otherwise("No"))


@REG.query(
    "e03_top_associations",
    DEAR_CHI + f" SELECT factor, {CHI_OUT} FROM q WHERE p < 0.05 ORDER BY q.v DESC LIMIT 5",
)
def _(spark, d):
    out = E.top_associations(A.association_scan(dear_many(spark, d), ["l_returnflag", "many"], "dear"))
    return report(out)


SIZE = "sz AS (SELECT *, CASE WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END AS big, CASE WHEN c_acctbal < 0 THEN 'Yes' ELSE 'No' END AS debt, " \
    "CASE WHEN o_totalprice + c_acctbal * 3 > 255000 THEN 1 ELSE 0 END AS hit FROM oc)"


def sized(spark, d):
    yes = lambda c: F.when(c, "Yes").otherwise("No")
    return oc(spark, d).withColumns(
        {
            "big": yes(F.col("o_totalprice") > 250000),
            "debt": yes(F.col("c_acctbal") < 0),
            "hit": F.when(F.col("o_totalprice") + F.col("c_acctbal") * 3 > 255000, 1).otherwise(0),
        }
    )


@REG.query(
    "e04_top_risks",
    risk_sql(f"{OC}, {SIZE}", "sz", ["big", "debt", "o_orderpriority"], "hit = 1")
    + f" SELECT {RISK_OUT} FROM z WHERE {chi2_p('chi2', '1.0')} < 0.05 ORDER BY o_r DESC NULLS LAST, factor, level LIMIT 5",
)
def _(spark, d):
    return report(E.top_risks(A.risk_table(sized(spark, d), ["big", "debt", "o_orderpriority"], "hit", 1)))


@REG.query(
    "e05_top_pairs",
    TESTED.format(src=corr_sql("part", PT_PAIRS)) + f" SELECT feature_1, feature_2, {TEST_OUT} FROM p WHERE p < 0.05 ORDER BY abs(p.r) DESC LIMIT 5",
)
def _(spark, d):
    return report(E.top_pairs(A.with_correlation_test(A.pearson_pairs(table(spark, d, "part"), PT_COLS))))


@REG.query("e05_predictors")
def _(spark, d):
    return report(E.significant_predictors(G.logistic_inference(sized(spark, d), ["c_acctbal"], ["debt"], "hit", 1)))


@REG.query(
    "e06_key_findings",
    risk_sql(f"{OC}, {SIZE}", "sz", ["big", "debt"], "hit = 1")
    + ", kk AS (SELECT * FROM z WHERE " + chi2_p("chi2", "1.0") + " < 0.05 ORDER BY o_r DESC NULLS LAST, factor, level LIMIT 1), "
    "c AS (SELECT 'o_totalprice' AS feature, corr(hit, o_totalprice) AS r FROM sz UNION ALL SELECT 'c_acctbal', corr(hit, c_acctbal) FROM sz), "
    "b AS (SELECT * FROM c ORDER BY abs(r) DESC LIMIT 1) "
    "SELECT 2 AS rank, 'risk' AS kind, printf('%s = %s: %.2f times the odds of a positive outcome (95%% CI %.2f-%.2f)', factor, level, o_r, "
    "exp(ln(o_r) - m), exp(ln(o_r) + m)) AS text FROM kk UNION ALL SELECT 3, 'correlation', "
    "printf('%s correlates most with the outcome: %s, r = %.2f', feature, CASE WHEN r > 0 THEN 'positive' ELSE 'negative' END, r) FROM b",
)
def _(spark, d):
    src = sized(spark, d)
    return E.key_findings(
        risks=A.risk_table(src, ["big", "debt"], "hit", 1),
        outcome_corr=A.outcome_correlations(src, OC_NUM, "hit", 1),
    )


# --- streaming --------------------------------------------------------------


@REG.query(
    "x01_stream_totals",
    f"WITH {RN}, {RESULTS}, w AS (SELECT player, sum(delta)::BIGINT AS balance, count(*) AS awards FROM a GROUP BY 1) "
    "SELECT x.file AS player, count(*) + coalesce(max(awards), 0) AS n_events, count(*) FILTER (event_type <> 'error') AS n_actions, "
    "count(*) FILTER (event_type = 'error') AS n_faults, coalesce(max(balance), 0)::BIGINT AS balance FROM x LEFT JOIN w ON w.player = x.file GROUP BY 1",
)
def _(spark, d):
    path, out, state = (scratch_dir(spark, n) for n in ("lines", "totals", "state"))
    event_log(spark, d).select(F.col("line").alias("value")).write.text(path)
    X.run_totals(X.player_totals(X.stream_lines(spark, path, max_files=4)), out, state).awaitTermination()
    return X.latest_totals(spark, out)
