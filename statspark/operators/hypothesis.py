"""Normality and two-group tests.

The data side is one or two aggregations (plus ranks where order matters);
p-values are computed on the few resulting rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statspark.functions import dist
from statspark.functions import scalars as S
from statspark.operators.profile import melt, per_column, unbiased_kurtosis, unbiased_skewness
from statspark.operators.rank import _clean, exact_quantiles, ranked_values
from statspark.operators.sampling import key_hash

SAMPLE = 5000


# --- normality --------------------------------------------------------------


def column_samples(
    df: DataFrame,
    cols: Sequence[str],
    keys: Sequence[str],
    n: int = SAMPLE,
    seed: int = 42,
    group: str | None = None,
    group_levels: Sequence = (),
) -> DataFrame:
    """At most ``n`` non-missing values per column (and group): ``feature[, group], value``.

    The values in the rows with the least key hashes, for all columns and groups together in two scans. The first counts
    the values by the number of binary digits of the hash (53 rows at most); so each column and group knows the fewest
    digits that give it ``n`` values, about twice as many at most. The second keeps these and orders them. The keys
    should identify the rows, as rows with equal keys are kept or left together.
    """
    cells = [(c, level) for c in cols for level in (group_levels if group else [None])]
    extra = [group] if group else []
    hashed = df.select(
        *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)],
        key_hash(keys, seed).alias("_hash"),
        *[(F.when(F.col(group) == F.lit(level), _clean(c)) if group else _clean(c)).alias(f"_v{i}") for i, (c, level) in enumerate(cells)],
    ).withColumn("_digits", F.length(F.bin(F.conv(F.substring("_hash", 1, 13), 16, 10).cast("long"))))
    sizes = hashed.groupBy("_digits").agg(*[F.count(f"_v{i}").alias(f"_n{i}") for i in range(len(cells))]).orderBy("_digits").collect()
    wanted = []
    for i, (c, level) in enumerate(cells):
        seen, digits = 0, 52
        for r in sizes:
            seen += r[f"_n{i}"]
            if seen >= n:
                digits = r["_digits"]
                break
        value = F.when(F.col("_digits") <= digits, F.col(f"_v{i}")).alias("value")
        wanted.append(F.struct(F.lit(c).alias("feature"), *[F.lit(level).alias(g) for g in extra], value))
    names = [f"_key{i}" for i in range(len(keys))]
    few = hashed.select("_hash", *names, F.inline(F.array(*wanted))).where(F.col("value").isNotNull())
    place = F.row_number().over(Window.partitionBy("feature", *extra).orderBy("_hash", *names))
    return few.withColumn("_place", place).where(F.col("_place") <= n).select("feature", *extra, "value")


def shapiro(samples: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """Shapiro-Wilk W and p per sample of at most 5000 values."""
    kinds = dict(samples.dtypes)
    schema = ", ".join(f"`{b}` {kinds[b]}" for b in by) + ", shapiro_w double, shapiro_p double"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = dist.shapiro_wilk(pdf["value"].to_numpy())
        head = pdf[list(by)].iloc[[0]].reset_index(drop=True)
        return head.assign(shapiro_w=w, shapiro_p=p)

    return samples.groupBy(*by).applyInPandas(one, schema)


def k2_statistic(n: Column, skew: Column, kurt: Column) -> Column:
    """D'Agostino-Pearson K2 from population skewness and excess kurtosis."""
    n = n.cast("double")
    y = skew * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    u = y / F.sqrt(2 / (w2 - 1))
    z_skew = F.log(u + F.sqrt(u * u + 1)) / F.sqrt(F.log(w2) / 2)

    expected = 3 * (n - 1) / (n + 1)
    var_b2 = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (kurt + 3 - expected) / F.sqrt(var_b2)
    root_b1 = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(
        6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))
    )
    a = 6 + 8 / root_b1 * (2 / root_b1 + F.sqrt(1 + 4 / (root_b1 * root_b1)))
    denom = 1 + x * F.sqrt(2 / (a - 4))
    term = F.signum(denom) * F.cbrt((1 - 2 / a) / F.abs(F.nullif(denom, F.lit(0.0))))
    z_kurt = (1 - 2 / (9 * a) - term) / F.sqrt(2 / (9 * a))
    return F.when(n >= 8, z_skew * z_skew + z_kurt * z_kurt)


def dagostino(samples: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    g = samples.groupBy(*by).agg(
        F.count("value").alias("n"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2")
    )
    return g.withColumn("k2", k2_statistic(F.col("n"), F.col("g1"), F.col("g2"))).select(
        *by, "n", "k2", F.exp(-F.col("k2") / 2).alias("k2_p")
    )


def ks_normal(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One-sample Kolmogorov-Smirnov distance to N(mean, population sd) of the same column.

    The parameters come from the data, so p is optimistic.
    """
    par = per_column(df, cols, {"mu": F.avg, "sd": F.stddev_pop})
    ranked = ranked_values(df, cols).join(F.broadcast(par), "feature")
    cdf = dist.norm_cdf((F.col("value") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0)))
    gaps = ranked.withColumn("cdf", cdf)
    low = F.col("below_n") / F.col("total_n")
    high = (F.col("below_n") + F.col("n")) / F.col("total_n")
    found = gaps.groupBy("feature").agg(
        F.max(F.greatest(F.abs(F.col("cdf") - low), F.abs(high - F.col("cdf")))).alias("ks_d"),
        F.max("total_n").alias("n"),
    )
    return found.withColumn("ks_p", dist.ks_sf("ks_d", "n")).select("feature", "n", "ks_d", "ks_p")


def normality_table(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], n: int = SAMPLE, seed: int = 42
) -> DataFrame:
    """Normality per column, with flags: K2, KS and moments over all ``n_total`` rows.

    Shapiro-Wilk, which is defined up to 5000 values, reads a seeded sample of ``n_sample``.
    """
    samples = column_samples(df, cols, keys, n, seed)
    rows = melt(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), [], cols, "feature", "value")
    rows = rows.where(F.col("value").isNotNull())
    moments = rows.groupBy("feature").agg(
        unbiased_skewness(F.col("value")).alias("skewness"), unbiased_kurtosis(F.col("value")).alias("kurtosis")
    )
    out = (
        shapiro(samples)
        .join(samples.groupBy("feature").agg(F.count("value").alias("n_sample")), "feature")
        .join(dagostino(rows).withColumnRenamed("n", "n_total"), "feature")
        .join(ks_normal(df, cols).drop("n"), "feature")
        .join(moments, "feature")
    )
    flags = {f"normal_by_{t}": S.normal_flag(F.col(f"{t}_p")) for t in ("shapiro", "k2", "ks")}
    return out.withColumns(flags)


def group_normality(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], group: str, neg, pos, n: int = SAMPLE, seed: int = 42
) -> DataFrame:
    """Do both groups pass Shapiro-Wilk at 0.05?"""
    samples = column_samples(df, cols, keys, n, seed, group, [neg, pos])
    found = shapiro(samples, ["feature", group])
    return found.groupBy("feature").agg(
        F.min("shapiro_p").alias("min_p"), (F.min("shapiro_p") > 0.05).alias("is_normal")
    )


# --- two groups -------------------------------------------------------------


def two_group_moments(df: DataFrame, cols: Sequence[str], group: str, neg, pos) -> DataFrame:
    """``feature, n1, m1, v1, n2, m2, v2`` for the negative (1) and positive (2) group, one scan."""

    def within(level, agg):
        return lambda c: agg(F.when(F.col(group) == F.lit(level), c))

    stats = {}
    for i, level in ((1, neg), (2, pos)):
        stats[f"n{i}"] = within(level, F.count)
        stats[f"m{i}"] = within(level, F.avg)
        stats[f"v{i}"] = within(level, F.var_samp)
    rows = per_column(df, cols, stats)
    return rows.where((F.col("n1") > 1) & (F.col("n2") > 1))


def student_t(moments: DataFrame) -> DataFrame:
    """Pooled-variance t from ``two_group_moments``."""
    n1, n2, dof = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2") - 2
    pooled = ((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / dof
    t = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(pooled * (1 / n1 + 1 / n2)), F.lit(0.0))
    return moments.select("feature", t.alias("statistic"), dof.cast("double").alias("dof")).withColumn(
        "p_value", dist.t_sf2("statistic", "dof")
    )


def welch_t(moments: DataFrame) -> DataFrame:
    """Unequal-variance t with Welch-Satterthwaite degrees of freedom."""
    a, b = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    t = (F.col("m1") - F.col("m2")) / F.nullif(F.sqrt(a + b), F.lit(0.0))
    dof = (a + b) * (a + b) / F.nullif(a * a / (F.col("n1") - 1) + b * b / (F.col("n2") - 1), F.lit(0.0))
    return moments.select("feature", t.alias("statistic"), dof.alias("dof")).withColumn(
        "p_value", dist.t_sf2("statistic", "dof")
    )


def cohens_d(moments: DataFrame) -> DataFrame:
    """Absolute mean difference over the root of the plain average variance."""
    sd = F.sqrt((F.col("v1") + F.col("v2")) / 2)
    d = F.abs(F.col("m1") - F.col("m2")) / F.nullif(sd, F.lit(0.0))
    return moments.select("feature", d.alias("effect_size")).withColumn(
        "magnitude", S.effect_label(F.col("effect_size"))
    )


def levene(df: DataFrame, cols: Sequence[str], group: str, neg, pos) -> DataFrame:
    """Median-centred Levene test: group medians first, then F on absolute deviations."""
    two = df.where(F.col(group).isin([neg, pos]))
    medians = {
        (r["feature"], r[group]): r["quantile"]
        for r in exact_quantiles(two, cols, [0.5], by=[group]).collect()
    }
    deviations = two.select(
        group,
        *[
            F.abs(
                F.col(c)
                - F.when(F.col(group) == F.lit(neg), F.lit(medians.get((c, neg)))).otherwise(
                    F.lit(medians.get((c, pos)))
                )
            ).alias(c)
            for c in cols
        ],
    )
    m = two_group_moments(deviations, cols, group, neg, pos)
    n1, n2 = F.col("n1"), F.col("n2")
    between = n1 * n2 / (n1 + n2) * (F.col("m1") - F.col("m2")) * (F.col("m1") - F.col("m2"))
    within = (n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")
    w = (n1 + n2 - 2) * between / F.nullif(within, F.lit(0.0))
    return m.select(
        "feature", w.alias("statistic"), (n1 + n2 - 2).cast("double").alias("dof")
    ).withColumn("p_value", dist.f_sf("statistic", F.lit(1.0), "dof"))


def mann_whitney(df: DataFrame, cols: Sequence[str], group: str, neg, pos) -> DataFrame:
    """Two-sided U test with tie and continuity correction; U belongs to the negative group."""
    two = df.where(F.col(group).isin([neg, pos]))
    is_neg = F.when(F.col(group) == F.lit(neg), 1).otherwise(0)
    ranked = ranked_values(two, cols, tallies={"a": is_neg})
    n = F.col("n").cast("double")
    sums = ranked.groupBy("feature").agg(
        F.sum(F.col("a") * F.col("midrank")).alias("rank_sum"),
        F.sum(n * n * n - n).alias("ties"),
        F.max("total_a").cast("double").alias("n1"),
        F.max("total_n").cast("double").alias("n_all"),
    )
    n1, n2, big = F.col("n1"), F.col("n_all") - F.col("n1"), F.col("n_all")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (big + 1 - F.col("ties") / F.nullif(big * (big - 1), F.lit(0.0))))
    z = (F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / F.nullif(sd, F.lit(0.0))
    return (
        sums.where((n1 > 0) & (n2 > 0))
        .select("feature", u.alias("statistic"), z.alias("z"))
        # a z below zero (U at its mean) means p = 1
        .withColumn("p_value", dist.norm_sf2(F.greatest(F.col("z"), F.lit(0.0))))
    )


def choose_tests(
    df: DataFrame, cols: Sequence[str], keys: Sequence[str], group: str, neg, pos, n: int = SAMPLE, seed: int = 42
) -> DataFrame:
    """Per column: Student t if normal with equal variances, Welch t if normal, else Mann-Whitney."""
    m = two_group_moments(df, cols, group, neg, pos)
    gates = group_normality(df, cols, keys, group, neg, pos, n, seed).join(
        levene(df, cols, group, neg, pos).select("feature", F.col("p_value").alias("levene_p")), "feature"
    )
    pick = (
        F.when(F.col("is_normal") & (F.col("levene_p") > 0.05), "Student's t-test")
        .when(F.col("is_normal"), "Welch's t-test")
        .otherwise("Mann-Whitney U test")
    )
    tests = None
    for name, found in (
        ("Student's t-test", student_t(m)),
        ("Welch's t-test", welch_t(m)),
        ("Mann-Whitney U test", mann_whitney(df, cols, group, neg, pos)),
    ):
        part = found.select("feature", F.lit(name).alias("test"), "statistic", "p_value")
        tests = part if tests is None else tests.unionByName(part)
    return (
        gates.withColumn("test", pick)
        .join(tests, ["feature", "test"])
        .join(cohens_d(m), "feature")
        .select(
            "feature", "test", "statistic", "p_value",
            S.significant(F.col("p_value")).alias("significant"), "effect_size", "magnitude",
        )
    )


def mean_differences(df: DataFrame, cols: Sequence[str], group: str, neg, pos) -> DataFrame:
    """Group means, their difference and Welch p per column, smallest p first."""
    m = two_group_moments(df, cols, group, neg, pos)
    summary = m.select(
        "feature", F.col("m1").alias("mean_neg"), F.col("m2").alias("mean_pos"), (F.col("m2") - F.col("m1")).alias("difference")
    )
    return summary.join(welch_t(m).select("feature", "p_value"), "feature", "left").orderBy(
        F.col("p_value").asc_nulls_last(), "feature"
    )


