"""Hypothesis tests, associations, correlations and ANOVA queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from statspark.operators import anova as V
from statspark.operators import association as A
from statspark.operators import hypothesis as H
from statspark.operators import profile as P
from statspark.plans.queries_profile import LI_NUM, union_sql
from statspark.plans.registry import Registry, report, table
from statspark.plans.sqlmath import chi2_p, f_p, norm_cdf, norm_p2, t_p2

REG = Registry()


def li(spark, d):
    return table(spark, d, "lineitem")


# --- two groups -------------------------------------------------------------

MOMENTS = "WITH m AS (" + union_sql(
    "SELECT '{c}' AS feature, count({c}) FILTER (l_linestatus = 'F') AS n1, avg({c}) FILTER (l_linestatus = 'F') AS m1, "
    "var_samp({c}) FILTER (l_linestatus = 'F') AS v1, count({c}) FILTER (l_linestatus = 'O') AS n2, "
    "avg({c}) FILTER (l_linestatus = 'O') AS m2, var_samp({c}) FILTER (l_linestatus = 'O') AS v2 FROM lineitem",
    LI_NUM,
) + ")"
STUDENT = (
    "s AS (SELECT feature, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) "
    "AS t, (n1 + n2 - 2)::DOUBLE AS dof FROM m)"
)
WELCH = (
    "w AS (SELECT feature, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t, (v1 / n1 + v2 / n2) * (v1 / n1 + v2 / n2) / "
    "((v1 / n1) * (v1 / n1) / (n1 - 1) + (v2 / n2) * (v2 / n2) / (n2 - 1)) AS dof FROM m)"
)


def moments(spark, d):
    return H.two_group_moments(li(spark, d), LI_NUM, "l_linestatus", "F", "O")


@REG.query(
    "t06_student_t",
    f"{MOMENTS}, {STUDENT} SELECT feature, round(t, 6) AS statistic, dof, round({t_p2('t', 'dof')}, 6) AS p_value FROM s",
)
def _(spark, d):
    return report(H.student_t(moments(spark, d)))


@REG.query(
    "t07_welch_t",
    f"{MOMENTS}, {WELCH} SELECT feature, round(t, 6) AS statistic, round(dof, 4) AS dof, "
    f"round({t_p2('t', 'dof')}, 6) AS p_value FROM w",
)
def _(spark, d):
    return report(H.welch_t(moments(spark, d)), dof=4)


@REG.query(
    "t10_cohens_d",
    f"{MOMENTS}, e AS (SELECT feature, abs(m1 - m2) / sqrt((v1 + v2) / 2) AS d FROM m) SELECT feature, "
    "round(d, 6) AS effect_size, CASE WHEN d < 0.5 THEN 'Small' WHEN d < 0.8 THEN 'Medium' ELSE 'Large' END AS magnitude FROM e",
)
def _(spark, d):
    return report(H.cohens_d(moments(spark, d)))


@REG.query(
    "j02_attach_p",
    f"{MOMENTS}, {WELCH} SELECT m.feature, n1, CASE WHEN m.feature <> 'l_tax' THEN round({t_p2('t', 'dof')}, 6) END "
    "AS p_value FROM m JOIN w USING (feature)",
)
def _(spark, d):
    m = moments(spark, d)
    tests = H.welch_t(m).where("feature <> 'l_tax'").select("feature", "p_value")
    return report(P.attach(m.select("feature", "n1"), tests))


MEAN_DIFF = (
    f"{MOMENTS}, {WELCH} SELECT m.feature, round(m1, 4) AS mean_neg, round(m2, 4) AS mean_pos, "
    f"round(m2 - m1, 4) AS difference, round({t_p2('t', 'dof')}, 6) AS p_value FROM m JOIN w USING (feature)"
)


@REG.query("a13_mean_differences", MEAN_DIFF)
def _(spark, d):
    out = H.mean_differences(li(spark, d), LI_NUM, "l_linestatus", "F", "O")
    return report(out, 4, p_value=6)


LEVENE = union_sql(
    "SELECT '{c}' AS feature, l_linestatus AS g, abs({c} - median({c}) OVER (PARTITION BY l_linestatus)) AS z FROM lineitem",
    LI_NUM,
)


@REG.query(
    "t05_levene",
    f"WITH z AS ({LEVENE}), m AS (SELECT feature, count(*) FILTER (g = 'F') AS n1, avg(z) FILTER (g = 'F') AS m1, "
    "var_samp(z) FILTER (g = 'F') AS v1, count(*) FILTER (g = 'O') AS n2, avg(z) FILTER (g = 'O') AS m2, "
    "var_samp(z) FILTER (g = 'O') AS v2 FROM z GROUP BY 1), "
    "w AS (SELECT feature, (n1 + n2 - 2)::DOUBLE AS dof, (n1 + n2 - 2) * (n1::DOUBLE * n2 / (n1 + n2) * (m1 - m2) * (m1 - m2)) "
    "/ ((n1 - 1) * v1 + (n2 - 1) * v2) AS f FROM m) "
    f"SELECT feature, round(f, 6) AS statistic, dof, round({f_p('f', '1.0', 'dof')}, 6) AS p_value FROM w",
)
def _(spark, d):
    return report(H.levene(li(spark, d), LI_NUM, "l_linestatus", "F", "O"))


RANKED = union_sql(
    "SELECT '{c}' AS feature, l_linestatus AS g, rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 "
    "AS r, count(*) OVER (PARTITION BY {c})::DOUBLE AS t FROM lineitem WHERE {c} IS NOT NULL",
    LI_NUM,
)
MWU = (
    f"WITH r AS ({RANKED}), s AS (SELECT feature, sum(r) FILTER (g = 'F') AS r1, count(*) FILTER (g = 'F')::DOUBLE AS n1, "
    "count(*)::DOUBLE AS n, sum(t * t - 1) AS ties FROM r GROUP BY 1), "
    "u AS (SELECT feature, r1 - n1 * (n1 + 1) / 2 AS u, n1, n - n1 AS n2, "
    "sqrt(n1 * (n - n1) / 12 * (n + 1 - ties / (n * (n - 1)))) AS sd FROM s), "
    "z AS (SELECT feature, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd AS z FROM u)"
)


@REG.query(
    "t08_mann_whitney",
    f"{MWU} SELECT feature, u::DOUBLE AS statistic, round(z, 6) AS z, round({norm_p2('greatest(z, 0)')}, 6) AS p_value FROM z",
)
def _(spark, d):
    return report(H.mann_whitney(li(spark, d), LI_NUM, "l_linestatus", "F", "O"))


@REG.query(
    "t09_choose_test",
    f"{MWU}, {MOMENTS.removeprefix('WITH ')}, "
    f"t AS (SELECT feature, u, {norm_p2('greatest(z, 0)')} AS p, abs(m1 - m2) / sqrt((v1 + v2) / 2) AS d FROM z JOIN m USING (feature)) "
    "SELECT feature, 'Mann-Whitney U test' AS test, u::DOUBLE AS statistic, round(p, 6) AS p_value, p < 0.05 AS significant, "
    "round(d, 6) AS effect_size, CASE WHEN d < 0.5 THEN 'Small' WHEN d < 0.8 THEN 'Medium' ELSE 'Large' END AS magnitude FROM t",
)
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey"]
    return report(H.choose_tests(li(spark, d), LI_NUM, keys, "l_linestatus", "F", "O"))


# --- normality --------------------------------------------------------------

def prices(spark, d):
    """All order prices, long form."""
    o = table(spark, d, "orders").where(F.col("o_totalprice").isNotNull())
    return o.select(F.lit("o_totalprice").alias("feature"), F.col("o_totalprice").alias("value"))


@REG.query("t01_shapiro")
def _(spark, d):
    cust = table(spark, d, "customer")
    return report(H.shapiro(H.column_samples(cust, ["c_acctbal"], ["c_custkey"])))


def _k2_sql() -> str:
    return (
        f"WITH x AS (SELECT o_totalprice AS value FROM orders WHERE o_totalprice IS NOT NULL), b AS (SELECT count(*)::DOUBLE AS n, avg(value) AS m FROM x), "
        "c AS (SELECT n, avg((value - m) ** 2) AS m2, avg((value - m) ** 3) AS m3, avg((value - m) ** 4) AS m4 FROM x, b GROUP BY n), "
        "g AS (SELECT n, m3 / m2 ** 1.5 AS g1, m4 / (m2 * m2) AS b2 FROM c), "
        "s AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS y, 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) "
        "/ ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2, 3 * (n - 1) / (n + 1) AS e, "
        "24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5)) AS vb, 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) "
        "* sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rb FROM g), "
        "t AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, (b2 - e) / sqrt(vb) AS x, "
        "6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM s), "
        "u AS (SELECT n, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 1 + x * sqrt(2 / (a - 4)) AS q, a FROM t), "
        "k AS (SELECT n, z1, ((1 - 2 / (9 * a)) - sign(q) * ((1 - 2 / a) / abs(q)) ** (1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM u) "
        "SELECT 'o_totalprice' AS feature, n::BIGINT AS n, round(z1 * z1 + z2 * z2, 4) AS k2, "
        "round(exp(-(z1 * z1 + z2 * z2) / 2), 6) AS k2_p FROM k"
    )


@REG.query("t02_dagostino", _k2_sql())
def _(spark, d):
    return report(H.dagostino(prices(spark, d)), k2=4)


@REG.query(
    "t03_ks_normal",
    f"WITH x AS (SELECT o_totalprice AS value FROM orders WHERE o_totalprice IS NOT NULL), g AS (SELECT avg(value) AS mu, stddev_pop(value) AS sd, count(*) AS n FROM x), "
    "v AS (SELECT value, count(*) AS c, sum(count(*)) OVER (ORDER BY value) AS upto FROM x GROUP BY 1), "
    f"f AS (SELECT {norm_cdf('(value - mu) / sd')} AS cdf, (upto - c) / n AS lo, upto / n AS hi FROM v, g), "
    "e AS (SELECT max(greatest(abs(cdf - lo), abs(hi - cdf))) AS d, (SELECT n FROM g) AS n FROM f), "
    # the one-sided law, doubled: a term per number of values below the gap
    "p AS (SELECT d, n, 2 * d * (SELECT sum(exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + (j - 1) * ln(d + j / n) "
    "+ (n - j) * ln(greatest(1 - d - j / n, 1e-300)))) FROM range(n) r(j) WHERE j <= n * (1 - d)) AS p FROM e) "
    "SELECT 'value' AS feature, n::BIGINT AS n, round(d, 6) AS ks_d, round(least(p, 1), 6) AS ks_p FROM p",
)
def _(spark, d):
    return report(H.ks_normal(prices(spark, d), ["value"]))


@REG.query("t03_normality_table")
def _(spark, d):
    return report(H.normality_table(table(spark, d, "orders"), ["o_totalprice"], ["o_orderkey"]))


@REG.query("t04_group_normality")
def _(spark, d):
    ev = table(spark, d, "events")
    return report(H.group_normality(ev, ["value"], ["event_id"], "event_type", "view", "purchase"))


# --- contingency ------------------------------------------------------------

OC_FACTORS = ["o_orderpriority", "c_mktsegment"]
OC = "oc AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey)"


def oc(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey)


def chi_sql(ctes: str, source: str, factors, outcome: str) -> str:
    """Dense table of all level pairs, so that unseen cells count."""
    long = union_sql(f"SELECT '{{c}}' AS factor, {{c}}::VARCHAR AS level, {outcome} AS y FROM {source}", factors)
    return (
        f"WITH {ctes + ', ' if ctes else ''}l AS ({long}), "
        "n AS (SELECT factor, level, y, count(*)::DOUBLE AS o FROM l GROUP BY ALL), "
        "r AS (SELECT factor, level, sum(o) AS r FROM n GROUP BY ALL), c AS (SELECT factor, y, sum(o) AS c FROM n GROUP BY ALL), "
        "t AS (SELECT factor, sum(o) AS n, count(DISTINCT level) AS nr, count(DISTINCT y) AS nc FROM n GROUP BY ALL), "
        "x AS (SELECT r.factor, coalesce(o, 0) AS o, r * c / t.n AS e, t.n AS n, nr, nc FROM r JOIN c USING (factor) "
        "JOIN t USING (factor) LEFT JOIN n ON n.factor = r.factor AND n.level = r.level AND n.y = c.y), "
        "s AS (SELECT factor, max(n)::BIGINT AS n, (max(nr) - 1) * (max(nc) - 1) AS dof, least(max(nr), max(nc)) - 1 AS w, "
        "sum(CASE WHEN (nr - 1) * (nc - 1) = 1 THEN (abs(o - e) - least(0.5, abs(o - e))) ** 2 ELSE (o - e) ** 2 END / e) "
        "AS chi2 FROM x GROUP BY 1), "
        f"q AS (SELECT factor, chi2, dof, n, sqrt(chi2 / (n * w)) AS v, {chi2_p('chi2', 'dof')} AS p FROM s)"
    )


CHI_OUT = (
    "round(chi2, 6) AS chi2, dof, n, round(v, 6) AS cramers_v, round(p, 6) AS p_value, p < 0.05 AS significant, "
    "CASE WHEN v < 0.1 THEN 'Weak' WHEN v < 0.3 THEN 'Moderate' ELSE 'Strong' END AS strength"
)
LI_YN = "y AS (SELECT *, CASE WHEN l_tax > 0.04 THEN 'Yes' ELSE 'No' END AS taxed FROM lineitem)"


def li_yn(spark, d):
    return li(spark, d).withColumn("taxed", F.when(F.col("l_tax") > 0.04, "Yes").otherwise("No"))


@REG.query(
    "t11_chi_square",
    chi_sql(LI_YN, "y", ["l_returnflag", "taxed"], "l_linestatus") + " SELECT factor, round(chi2, 6) AS chi2, dof, "
    "round(p, 6) AS p_value FROM q",
)
def _(spark, d):
    out = A.chi_square(A.factor_counts(li_yn(spark, d), ["l_returnflag", "taxed"], "l_linestatus"))
    return report(out.select("factor", "chi2", "dof", "p_value"))


@REG.query(
    "t12_cramers_v",
    chi_sql(LI_YN, "y", ["l_returnflag", "taxed"], "l_linestatus") + " SELECT factor, round(v, 6) AS cramers_v FROM q",
)
def _(spark, d):
    out = A.chi_square(A.factor_counts(li_yn(spark, d), ["l_returnflag", "taxed"], "l_linestatus"))
    return report(out.select("factor", "cramers_v"))


@REG.query(
    "p08_association_label",
    chi_sql(OC, "oc", OC_FACTORS, "o_orderstatus")
    + " SELECT factor, CASE WHEN v < 0.1 THEN 'Weak' WHEN v < 0.3 THEN 'Moderate' ELSE 'Strong' END AS strength FROM q",
)
def _(spark, d):
    return A.association_scan(oc(spark, d), OC_FACTORS, "o_orderstatus").select("factor", "strength")


@REG.query("t13_association_scan", chi_sql("", "lineitem", ["l_returnflag", "l_shipmonth"], "l_linestatus").replace(
    "FROM lineitem", "FROM (SELECT *, month(l_shipdate) AS l_shipmonth FROM lineitem)") + f" SELECT factor, {CHI_OUT} FROM q")
def _(spark, d):
    src = li(spark, d).withColumn("l_shipmonth", F.month("l_shipdate"))
    return report(A.association_scan(src, ["l_returnflag", "l_shipmonth"], "l_linestatus"))


def risk_sql(ctes: str, source: str, factors, positive: str) -> str:
    long = union_sql(f"SELECT '{{c}}' AS factor, {{c}}::VARCHAR AS level, ({positive})::INT AS y FROM {source}", factors)
    return (
        f"WITH {ctes + ', ' if ctes else ''}l AS ({long}), g AS (SELECT factor, level, count(*)::DOUBLE AS ex, "
        "sum(y)::DOUBLE AS a FROM l GROUP BY ALL), t AS (SELECT factor, sum(ex) AS n, sum(a) AS p FROM g GROUP BY 1), "
        "k AS (SELECT factor, level, ex, n, p, a, ex - a AS b, p - a AS c, (n - ex) - (p - a) AS d FROM g JOIN t USING (factor) "
        "WHERE level IS NOT NULL AND n > ex), "
        "o AS (SELECT *, a / ex AS r1, c / (n - ex) AS r0, CASE WHEN b > 0 AND c > 0 AND d > 0 THEN a * d / (b * c) END AS o_r, "
        "least(ex, n - ex) * least(p, n - p) / n AS emin, greatest(abs(a - ex * p / n) - 0.5, 0) AS gap FROM k), "
        "z AS (SELECT *, gap * gap * n * n * n / (ex * (n - ex) * p * (n - p)) AS chi2, CASE WHEN o_r > 0 THEN "
        "1.96 * sqrt(1 / a + 1 / b + 1 / c + 1 / d) END AS m FROM o)"
    )


RISK_OUT = (
    "factor, level, ex::BIGINT AS exposed_count, round(r1, 6) AS risk_exposed, round(r0, 6) AS risk_unexposed, "
    "round(r1 / nullif(r0, 0), 6) AS risk_ratio, round(o_r, 6) AS odds_ratio, round(CASE WHEN o_r > 0 THEN exp(ln(o_r) - m) END, 6) "
    "AS ci_lower, round(CASE WHEN o_r > 0 THEN exp(ln(o_r) + m) END, 6) AS ci_upper, "
    f"round({chi2_p('chi2', '1.0')}, 6) AS p_value, {chi2_p('chi2', '1.0')} < 0.05 AS significant, "
    "CASE WHEN emin < 5 THEN 'Fisher''s exact test' ELSE 'Chi-square test' END AS test"
)


@REG.query(
    "t14_risk_ratio",
    risk_sql(LI_YN, "y", ["l_returnflag", "taxed"], "l_linestatus = 'F'")
    + " SELECT factor, level, ex::BIGINT AS exposed_count, round(r1, 6) AS risk_exposed, round(r0, 6) AS risk_unexposed, "
    "round(r1 / nullif(r0, 0), 6) AS risk_ratio FROM z",
)
def _(spark, d):
    out = A.risk_table(li_yn(spark, d), ["l_returnflag", "taxed"], "l_linestatus", "F")
    return report(out.select("factor", "level", "exposed_count", "risk_exposed", "risk_unexposed", "risk_ratio"))


LABELS = "lb AS (SELECT * FROM labels JOIN documents USING (doc_id))"


def lb(spark, d):
    return table(spark, d, "labels").join(table(spark, d, "documents").drop("text"), "doc_id")


@REG.query(
    "t15_odds_ratio",
    risk_sql(LABELS, "lb", ["lang", "quality"], "toxic = 1")
    + " SELECT factor, level, round(o_r, 6) AS odds_ratio, round(CASE WHEN o_r > 0 THEN exp(ln(o_r) - m) END, 6) AS ci_lower, "
    "round(CASE WHEN o_r > 0 THEN exp(ln(o_r) + m) END, 6) AS ci_upper FROM z",
)
def _(spark, d):
    out = A.risk_table(lb(spark, d), ["lang", "quality"], "toxic", 1)
    return report(out.select("factor", "level", "odds_ratio", "ci_lower", "ci_upper"))


LOGC = "(lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1))"
HYPER = (
    f"exp({LOGC.format('ex', 'k')} + {LOGC.format('(n - ex)', '(p - k)')} - {LOGC.format('n', 'p')})"
)
FISHER = (
    "f AS (SELECT *, list_transform(range(greatest(0, p - (n - ex))::BIGINT, least(ex, p)::BIGINT + 1), lambda k: "
    f"{HYPER}) AS pr, exp({LOGC.format('ex', 'a')} + {LOGC.format('(n - ex)', '(p - a)')} - {LOGC.format('n', 'p')}) AS seen FROM z)"
)


@REG.query(
    "t16_fisher_p",
    risk_sql(LABELS, "lb", ["lang", "quality", "source"], "toxic = 1")
    + f", {FISHER} SELECT factor, level, CASE WHEN emin < 5 THEN 'Fisher''s exact test' ELSE 'Chi-square test' END AS test, "
    "round(CASE WHEN emin < 5 THEN least(1.0, list_sum(list_filter(pr, lambda v: v <= seen * (1 + 1e-7)))) "
    f"ELSE {chi2_p('chi2', '1.0')} END, 6) AS p_value FROM f",
)
def _(spark, d):
    out = A.risk_table(lb(spark, d), ["lang", "quality", "source"], "toxic", 1)
    return report(out.select("factor", "level", "test", "p_value"))


@REG.query(
    "t17_sorted_risk_table",
    risk_sql(OC, "oc", OC_FACTORS, "o_orderstatus = 'F'") + f" SELECT {RISK_OUT} FROM z",
)
def _(spark, d):
    return report(A.sorted_risk_table(oc(spark, d), OC_FACTORS, "o_orderstatus", "F"))


@REG.query(
    "t18_risk_summary",
    chi_sql(LI_YN, "y", ["l_returnflag", "taxed"], "l_linestatus")
    + ", rt AS (SELECT 'l_returnflag' AS factor, l_returnflag AS level, avg((l_linestatus = 'F')::INT) AS rate FROM y GROUP BY 2 "
    "UNION ALL SELECT 'taxed', taxed, avg((l_linestatus = 'F')::INT) FROM y GROUP BY 2), "
    "yn AS (SELECT max(rate) FILTER (level = 'Yes') / max(rate) FILTER (level = 'No') AS rr FROM rt WHERE factor = 'taxed'), "
    "tp AS (SELECT level, rate FROM rt WHERE factor = 'l_returnflag' ORDER BY rate DESC, level LIMIT 1) "
    "SELECT factor, round(p, 6) AS p_value, p < 0.05 AS significant, CASE WHEN factor = 'taxed' THEN round(rr, 6) END AS risk_ratio, "
    "CASE WHEN factor = 'taxed' THEN rr > 1 END AS increases_risk, CASE WHEN factor <> 'taxed' THEN level END AS highest_level, "
    "CASE WHEN factor <> 'taxed' THEN round(100 * rate, 6) END AS highest_pct FROM q, yn, tp",
)
def _(spark, d):
    return report(A.risk_summary(li_yn(spark, d), ["l_returnflag", "taxed"], "l_linestatus", "F"))


# --- correlations -----------------------------------------------------------

PAIRS = [(a, b) for i, a in enumerate(LI_NUM) for b in LI_NUM[i + 1 :]]


def corr_sql(source: str, pairs, fmt="SELECT '{a}' AS feature_1, '{b}' AS feature_2, corr({a}, {b}) AS r, count(*) AS n FROM {s}"):
    return " UNION ALL ".join(fmt.format(a=a, b=b, s=source) for a, b in pairs)


ALL_PAIRS = [(a, b) for a in LI_NUM for b in LI_NUM]


@REG.query(
    "t19_pearson",
    f"SELECT feature_1, feature_2, round(r, 6) AS r, n FROM ({corr_sql('lineitem', ALL_PAIRS)})",
)
def _(spark, d):
    return report(A.pearson_pairs(li(spark, d), LI_NUM, cover=True))


@REG.query(
    "j04_feature_pairs",
    f"SELECT feature_1, feature_2, round(r, 6) AS r, n FROM ({corr_sql('lineitem', PAIRS)})",
)
def _(spark, d):
    return report(A.pearson_pairs(li(spark, d), LI_NUM))


RANKS = "rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in LI_NUM
) + " FROM lineitem)"


@REG.query(
    "t20_spearman",
    f"WITH {RANKS} SELECT feature_1, feature_2, round(r, 6) AS r, n FROM ({corr_sql('rk', PAIRS)})",
)
def _(spark, d):
    return report(A.spearman_pairs(li(spark, d), LI_NUM))


TESTED = (
    "WITH c AS ({src}), t AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM c), "
    "p AS (SELECT *, " + t_p2("t", "(n - 2)::DOUBLE") + " AS p FROM t)"
)
TEST_OUT = (
    "round(r, 6) AS r, n, round(p, 6) AS p_value, p < 0.05 AS significant, CASE WHEN abs(r) < 0.3 THEN 'Weak' "
    "WHEN abs(r) < 0.7 THEN 'Moderate' ELSE 'Strong' END AS strength, CASE WHEN r > 0 THEN 'Positive' ELSE 'Negative' END AS direction"
)


@REG.query(
    "t21_pearson_p",
    TESTED.format(src=corr_sql("lineitem", PAIRS)) + " SELECT feature_1, feature_2, round(r, 6) AS r, n, round(p, 6) AS p_value FROM p",
)
def _(spark, d):
    out = A.with_correlation_test(A.pearson_pairs(li(spark, d), LI_NUM))
    return report(out.select("feature_1", "feature_2", "r", "n", "p_value"))


PT_PAIRS = [("p_partkey", "p_size"), ("p_partkey", "p_retailprice"), ("p_size", "p_retailprice")]
PT_COLS = ["p_partkey", "p_size", "p_retailprice"]


@REG.query(
    "p09_correlation_label",
    TESTED.format(src=corr_sql("part", PT_PAIRS)) + f" SELECT feature_1, feature_2, {TEST_OUT} FROM p",
)
def _(spark, d):
    return report(A.with_correlation_test(A.pearson_pairs(table(spark, d, "part"), PT_COLS)))


@REG.query(
    "t22_significant_pairs",
    TESTED.format(src=corr_sql("part", PT_PAIRS)) + f" SELECT feature_1, feature_2, {TEST_OUT} FROM p WHERE p < 0.05",
)
def _(spark, d):
    return report(A.significant_pairs(table(spark, d, "part"), PT_COLS))


PBS = union_sql(
    "SELECT '{c}' AS feature, corr((l_linestatus = 'F')::INT, {c}) AS r, count({c}) AS n FROM lineitem", LI_NUM
)


@REG.query("t23_point_biserial", TESTED.format(src=PBS) + f" SELECT feature, {TEST_OUT} FROM p")
def _(spark, d):
    return report(A.outcome_correlations(li(spark, d), LI_NUM, "l_linestatus", "F"))


# --- ANOVA ------------------------------------------------------------------

OC_NUM = ["o_totalprice", "c_acctbal"]


def anova_sql(ctes: str, source: str, factors, nums) -> str:
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS factor, '{c}' AS feature, {f} AS level, {c}::DOUBLE AS y FROM {source}" for f in factors for c in nums
    )
    return (
        f"WITH {ctes + ', ' if ctes else ''}l AS ({long}), g AS (SELECT factor, feature, level, count(*) AS n, avg(y) AS m, "
        "var_pop(y) AS v FROM l GROUP BY ALL), w AS (SELECT factor, feature, avg(y) AS gm, count(*) AS nn FROM l GROUP BY ALL), "
        "s AS (SELECT factor, feature, sum(n * (m - gm) ** 2) AS ssb, sum(n * v) AS ssw, count(*) - 1.0::DOUBLE AS d1, "
        "max(nn)::DOUBLE - count(*) AS d2 FROM g JOIN w USING (factor, feature) GROUP BY ALL), "
        "f AS (SELECT *, (ssb / d1) / (ssw / d2) AS f FROM s)"
    )


@REG.query(
    "t24_one_way_anova",
    anova_sql(OC, "oc", OC_FACTORS, OC_NUM)
    + f" SELECT factor, feature, round(f, 6) AS f, d1 AS df_between, d2 AS df_within, round({f_p('f', 'd1', 'd2')}, 6) AS p_value, "
    f"{f_p('f', 'd1', 'd2')} < 0.05 AS significant FROM f",
)
def _(spark, d):
    out = V.one_way(oc(spark, d), OC_FACTORS, OC_NUM)
    return report(out.drop("ss_between", "ss_within"))


def two_way_sql(factors, nums) -> str:
    """Type II sums of squares by nested models: the additive fit through the centred slope."""
    long = " UNION ALL ".join(
        f"SELECT '{f}' AS factor, '{c}' AS feature, {f} AS lv, (o_orderstatus = 'F')::INT AS x, {c} AS y FROM oc"
        for f in factors for c in nums
    )
    f = "(ss_{0} / df_{0}) / (rss / df_resid)"
    parts = ("factor", "outcome", "inter")
    outs = ", ".join(
        f"round({f.format(p)}, 6) AS f_{p}, round({f_p(f.format(p), f'df_{p}', 'df_resid')}, 6) AS p_{p}" for p in parts
    )
    return (
        f"WITH {OC}, l AS ({long}), a AS (SELECT *, avg(y) OVER (PARTITION BY factor, feature, lv) AS ya, "
        "avg(x) OVER (PARTITION BY factor, feature, lv) AS xa, avg(y) OVER (PARTITION BY factor, feature, x) AS yb, "
        "avg(y) OVER (PARTITION BY factor, feature, lv, x) AS yab FROM l), "
        "b AS (SELECT factor, feature, sum((x - xa) * (y - ya)) / sum((x - xa) ** 2) AS beta FROM a GROUP BY ALL), "
        "r AS (SELECT factor, feature, sum((y - ya) ** 2) AS rss_a, sum((y - yb) ** 2) AS rss_b, "
        "sum((y - ya - beta * (x - xa)) ** 2) AS rss_add, sum((y - yab) ** 2) AS rss, count(DISTINCT lv) AS k, "
        "count(DISTINCT (lv, x)) AS cells, count(*) AS n FROM a JOIN b USING (factor, feature) GROUP BY ALL), "
        "s AS (SELECT factor, feature, rss_b - rss_add AS ss_factor, rss_a - rss_add AS ss_outcome, rss_add - rss AS ss_inter, rss, "
        "(k - 1)::DOUBLE AS df_factor, 1.0::DOUBLE AS df_outcome, (cells - k - 1)::DOUBLE AS df_inter, (n - cells)::DOUBLE AS df_resid FROM r) "
        f"SELECT factor, feature, {outs} FROM s"
    )


@REG.query("t25_two_way_anova", two_way_sql(OC_FACTORS, OC_NUM))
def _(spark, d):
    out = V.two_way(oc(spark, d), OC_FACTORS, OC_NUM, "o_orderstatus", "F")
    parts = ("factor", "outcome", "inter")
    return report(out.select("factor", "feature", *[f"{k}_{p}" for p in parts for k in ("f", "p")]))
