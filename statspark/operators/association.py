"""Contingency tests, risk tables and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspark.functions import dist
from statspark.functions import scalars as S
from statspark.operators.profile import factor_long, per_column, present, stack_rows
from statspark.operators.rank import with_midranks

# --- factors against an outcome ---------------------------------------------


def factor_counts(
    df: DataFrame, factors: Sequence[str], outcome: str, weight: str | None = None
) -> DataFrame:
    """``factor, level, outcome, n`` for all factors in one pass; combined before the shuffle."""
    w = F.col(weight) if weight else F.lit(1)
    src = df.where(F.col(outcome).isNotNull()).select(
        F.col(outcome).cast("string").alias("outcome"), w.cast("long").alias("n"), *factors
    )
    long = factor_long(src, factors, ["outcome", "n"]).where(F.col("level").isNotNull())
    return long.groupBy("factor", "level", "outcome").agg(F.sum("n").alias("n")).where(F.col("n") > 0)


def chi_square(counts: DataFrame) -> DataFrame:
    """Chi-square of independence per factor; Yates correction only with one degree of freedom.

    Input as from ``factor_counts``. Cells never seen are accounted for through
    the margins: their expected counts are what the seen cells leave of n.
    """
    rows = counts.groupBy("factor", "level").agg(F.sum("n").alias("r"))
    cols = counts.groupBy("factor", "outcome").agg(F.sum("n").alias("c"))
    total = counts.groupBy("factor").agg(F.sum("n").alias("total"))
    row_side = rows.groupBy("factor").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(1 / F.col("r")).alias("inv_r"))
    col_side = cols.groupBy("factor").agg(F.count(F.lit(1)).alias("n_cols"), F.sum(1 / F.col("c")).alias("inv_c"))
    margins = total.join(row_side, "factor").join(col_side, "factor")
    cells = (
        counts.join(rows, ["factor", "level"])
        .join(cols, ["factor", "outcome"])
        .join(F.broadcast(margins), "factor")  # one row per named factor
        .withColumn("e", F.col("r") * F.col("c") / F.col("total"))
        .withColumn("gap", F.col("n") - F.col("e"))
    )
    g = cells.groupBy("factor").agg(
        F.sum(F.col("gap") * F.col("gap") / F.col("e")).alias("seen"),
        F.sum("e").alias("e_seen"),
        F.max(F.abs("gap")).alias("gap"),
        F.count(F.lit(1)).alias("n_cells"),
        *[F.max(c).alias(c) for c in ("total", "n_rows", "n_cols", "inv_r", "inv_c")],
    )
    unseen = F.when(F.col("n_cells") < F.col("n_rows") * F.col("n_cols"), F.col("total") - F.col("e_seen")).otherwise(0.0)
    dof = (F.col("n_rows") - 1) * (F.col("n_cols") - 1)
    # in a 2x2 table all gaps are equal in size, and the sum of 1/E factorises
    shrunk = F.col("gap") - F.least(F.lit(0.5), F.col("gap"))
    yates = shrunk * shrunk * F.col("total") * F.col("inv_r") * F.col("inv_c")
    chi2 = F.when(dof == 1, yates).when(dof == 0, 0.0).otherwise(F.col("seen") + unseen)
    width = F.least("n_rows", "n_cols") - 1
    return (
        g.select(
            "factor",
            chi2.alias("chi2"),
            dof.alias("dof"),
            F.col("total").alias("n"),
            F.sqrt(chi2 / F.nullif(F.col("total") * width, F.lit(0))).alias("cramers_v"),
        )
        .withColumn("p_value", dist.chi2_sf(F.col("chi2"), F.col("dof").cast("double")))
        .withColumn("significant", S.significant(F.col("p_value")))
        .withColumn("strength", S.association_label(F.col("cramers_v")))
    )


def association_scan(
    df: DataFrame, factors: Sequence[str], outcome: str, weight: str | None = None
) -> DataFrame:
    """Chi-square and Cramér's V of every factor, strongest first."""
    return chi_square(factor_counts(df, factors, outcome, weight)).orderBy(
        F.col("cramers_v").desc_nulls_last(), "factor"
    )


def risk_table(
    df: DataFrame, factors: Sequence[str], outcome: str, positive, weight: str | None = None
) -> DataFrame:
    """Each factor level against all other rows: risks, ratios, odds ratio with 95 % CI, p.

    "Unexposed" is every other row, those with a missing level included. Fisher's
    exact p replaces the chi-square p where an expected count is below five.
    """
    w = F.col(weight) if weight else F.lit(1)
    src = df.select(S.outcome01(outcome, positive).alias("y"), w.cast("long").alias("n"), *factors)
    counts = (
        factor_long(src, factors, ["y", "n"])
        .groupBy("factor", "level")
        .agg(F.sum("n").alias("exposed"), F.sum(F.col("n") * F.col("y")).alias("a"))
    )
    totals = counts.groupBy("factor").agg(F.sum("exposed").alias("total"), F.sum("a").alias("pos"))
    t = (
        counts.where(F.col("level").isNotNull())
        .join(F.broadcast(totals), "factor")  # one row per named factor
        .withColumns(
            {
                "b": F.col("exposed") - F.col("a"),
                "c": F.col("pos") - F.col("a"),
                "unexposed": F.col("total") - F.col("exposed"),
            }
        )
        .withColumn("d", F.col("unexposed") - F.col("c"))
        .where((F.col("exposed") > 0) & (F.col("unexposed") > 0))
    )
    a, b, c, d = (F.col(x).cast("double") for x in "abcd")
    n = F.col("total").cast("double")
    risk_1, risk_0 = a / F.col("exposed"), c / F.col("unexposed")
    odds = F.when((b > 0) & (d > 0) & (c > 0), F.try_divide(a * d, b * c))
    margin = 1.96 * F.sqrt(F.try_divide(F.lit(1.0), a) + F.try_divide(F.lit(1.0), b) + F.try_divide(F.lit(1.0), c) + F.try_divide(F.lit(1.0), d))
    log_or = F.when(F.col("odds_ratio") > 0, F.log("odds_ratio"))
    pos, neg = F.col("pos").cast("double"), n - F.col("pos")
    e_min = F.least(F.col("exposed"), F.col("unexposed")) * F.least(pos, neg) / n
    gap = F.abs(a - F.col("exposed") * pos / n)
    shrunk = gap - F.least(F.lit(0.5), gap)
    denom = F.col("exposed").cast("double") * F.col("unexposed") * pos * neg
    chi2 = F.try_divide(shrunk * shrunk * n * n * n, F.nullif(denom, F.lit(0.0)))
    exact = (e_min < 5) & (denom > 0)
    base = t.withColumns(
        {
            "risk_exposed": risk_1,
            "risk_unexposed": risk_0,
            "risk_ratio": F.try_divide(risk_1, F.nullif(risk_0, F.lit(0.0))),
            "odds_ratio": odds,
            "chi2": chi2,
            "test": F.when(exact, "Fisher's exact test").when(denom > 0, "Chi-square test"),
        }
    ).withColumns({"ci_lower": F.exp(log_or - margin), "ci_upper": F.exp(log_or + margin)})
    is_exact = F.col("test") == "Fisher's exact test"
    by_chi2 = base.where(~F.coalesce(is_exact, F.lit(False))).withColumn(
        "p_value", dist.chi2_sf("chi2", F.lit(1.0))
    )
    by_fisher = base.where(is_exact).withColumn("p_value", dist.fisher_p("a", "b", "c", "d"))
    return by_chi2.unionByName(by_fisher).select(
        "factor", "level", F.col("exposed").alias("exposed_count"), "risk_exposed", "risk_unexposed",
        "risk_ratio", "odds_ratio", "ci_lower", "ci_upper", "p_value",
        S.significant(F.col("p_value")).alias("significant"), "test",
    )


def sorted_risk_table(
    df: DataFrame, factors: Sequence[str], outcome: str, positive, weight: str | None = None
) -> DataFrame:
    """Risk table, significant rows first, then by odds ratio; missing ratios last."""
    return risk_table(df, factors, outcome, positive, weight).orderBy(
        F.col("significant").desc_nulls_last(), F.col("odds_ratio").desc_nulls_last(), "factor", "level"
    )


def risk_summary(
    df: DataFrame, factors: Sequence[str], outcome: str, positive, weight: str | None = None
) -> DataFrame:
    """One row per factor: risk ratio and direction for Yes/No factors, else the riskiest level."""
    counts = factor_counts(df, factors, outcome, weight)
    hit = F.when(F.col("outcome") == F.lit(str(positive)), F.col("n")).otherwise(0)
    rates = counts.groupBy("factor", "level").agg((F.sum(hit) / F.sum("n")).alias("rate"))
    per = rates.groupBy("factor").agg(
        F.count(F.lit(1)).alias("k"),
        F.count_if(F.col("level").isin("Yes", "No")).alias("yn"),
        F.max(F.when(F.col("level") == "Yes", F.col("rate"))).alias("yes"),
        F.max(F.when(F.col("level") == "No", F.col("rate"))).alias("no"),
        F.min(F.struct((-F.col("rate")).alias("key"), "level", "rate")).alias("top"),
    )
    yes_no = (F.col("k") == 2) & (F.col("yn") == 2)
    ratio = F.when(yes_no, F.try_divide(F.col("yes"), F.nullif(F.col("no"), F.lit(0.0))))
    return (
        chi_square(counts)
        .select("factor", "p_value", "significant")
        .join(
            per.select(
                "factor",
                ratio.alias("risk_ratio"),
                (ratio > 1).alias("increases_risk"),
                F.when(~yes_no, F.col("top.level")).alias("highest_level"),
                F.when(~yes_no, 100 * F.col("top.rate")).alias("highest_pct"),
            ),
            "factor",
        )
        .orderBy(F.col("p_value").asc_nulls_last(), "factor")
    )


# --- correlations -----------------------------------------------------------


def pearson_pairs(df: DataFrame, cols: Sequence[str], cover: bool = False) -> DataFrame:
    """Pairwise-complete Pearson r for i < j from one aggregation: ``feature_1, feature_2, r, n``.

    ``cover`` adds the mirrored pairs and the unit diagonal (the full matrix, long).
    """
    pairs = list(combinations(cols, 2))
    aggs = []
    for i, (a, b) in enumerate(pairs):
        x, y = S.null_if_nan(F.col(a).cast("double")), S.null_if_nan(F.col(b).cast("double"))
        aggs.append(S.correlation(x, y).alias(f"r{i}"))
        aggs.append(F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).alias(f"n{i}"))
    if cover:
        aggs += [F.count(present(df, c)).alias(f"d{i}") for i, c in enumerate(cols)]

    def cell(a, b, r_, n_):
        return F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), r_.alias("r"), n_.alias("n"))

    cells = [cell(a, b, F.col(f"r{i}"), F.col(f"n{i}")) for i, (a, b) in enumerate(pairs)]
    if cover:
        cells += [cell(b, a, F.col(f"r{i}"), F.col(f"n{i}")) for i, (a, b) in enumerate(pairs)]
        cells += [cell(c, c, F.lit(1.0), F.col(f"d{i}")) for i, c in enumerate(cols)]
    return df.agg(*aggs).select(F.inline(F.array(*cells)))


def spearman_pairs(df: DataFrame, cols: Sequence[str], cover: bool = False) -> DataFrame:
    """Spearman r: Pearson on mid-ranks. Columns with gaps are ranked again for each pair."""
    gaps = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in cols]).first()
    full = [c for c in cols if gaps[c] == 0]
    parts = []

    def on_ranks(src, names, mirror):
        ranked = with_midranks(src.select(*names), {c: f"_rank_{i}" for i, c in enumerate(names)})
        return pearson_pairs(
            ranked.select(*[F.col(f"_rank_{i}").alias(c) for i, c in enumerate(names)]), names, mirror
        )

    if len(full) > 1 or (cover and full):
        parts.append(on_ranks(df, full, cover))
    for a, b in combinations(cols, 2):
        if gaps[a] or gaps[b]:
            both = df.where(
                F.col(a).isNotNull() & F.col(b).isNotNull()
                & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double"))
            )
            one = on_ranks(both, [a, b], False)
            parts.append(one)
            if cover:
                mirrored = one.select(
                    F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"), "r", "n"
                )
                parts.append(mirrored)
    if cover:
        for c in cols:
            if gaps[c]:
                parts.append(
                    df.agg(F.count(present(df, c)).alias("n")).select(
                        F.lit(c).alias("feature_1"), F.lit(c).alias("feature_2"), F.lit(1.0).alias("r"), "n"
                    )
                )
    return stack_rows(parts)


def with_correlation_test(pairs: DataFrame) -> DataFrame:
    """Add the two-sided t-test p-value, flag and labels to ``r`` and ``n``."""
    rest = F.lit(1.0) - F.col("r") * F.col("r")
    t = F.col("r") * F.sqrt((F.col("n") - 2) / F.nullif(rest, F.lit(0.0)))
    t = F.when(F.abs("r") >= 1, F.lit(float("inf"))).otherwise(t)
    return (
        pairs.withColumn("p_value", dist.t_sf2(t, (F.col("n") - 2).cast("double")))
        .withColumn("significant", S.significant(F.col("p_value")))
        .withColumn("strength", S.correlation_label(F.col("r")))
        .withColumn("direction", S.direction_label(F.col("r")))
    )


def significant_pairs(df: DataFrame, cols: Sequence[str], alpha: float = 0.05) -> DataFrame:
    """Pairs with p below alpha, by absolute r."""
    tested = with_correlation_test(pearson_pairs(df, cols))
    return tested.where(F.col("p_value") < alpha).orderBy(F.abs("r").desc(), "feature_1", "feature_2")


def outcome_correlations(df: DataFrame, cols: Sequence[str], outcome: str, positive) -> DataFrame:
    """Point-biserial r of each numeric column with the 0/1 outcome, by absolute r."""
    y = S.outcome01(outcome, positive).cast("double")
    rows = per_column(df, cols, {"r": lambda c: S.correlation(y, c.cast("double")), "n": F.count})
    return with_correlation_test(rows).orderBy(F.abs("r").desc_nulls_last(), "feature")
