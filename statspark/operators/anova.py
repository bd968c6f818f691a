"""Analysis of variance from per-group moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statspark.functions import dist
from statspark.functions import scalars as S
from statspark.operators.profile import factor_long, per_column


def group_moments(df: DataFrame, factors: Sequence[str], nums: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``factor, level, keep…, feature, n, mean, v``: population variance per group, one pass."""
    long = factor_long(df.select(*factors, *nums, *keep), factors, [*keep, *nums]).where(
        F.col("level").isNotNull()
    )
    return per_column(
        long, nums, {"n": F.count, "mean": F.avg, "v": F.var_pop}, by=["factor", "level", *keep]
    ).where(F.col("n") > 0)


def one_way(df: DataFrame, factors: Sequence[str], nums: Sequence[str], max_levels: int = 10) -> DataFrame:
    """One-way F for every (factor, numeric) pair; factors with more levels are left out."""
    cells = group_moments(df, factors, nums)
    n, keys = F.col("n"), ["factor", "feature"]
    whole = cells.groupBy(*keys).agg(
        F.sum("n").alias("total"),
        (F.sum(n * F.col("mean")) / F.sum("n")).alias("grand"),
        F.count(F.lit(1)).alias("k"),
    )
    gap = F.col("mean") - F.col("grand")
    g = (
        cells.join(F.broadcast(whole.where(F.col("k") <= max_levels)), keys)
        .groupBy(*keys)
        .agg(
            F.sum(n * gap * gap).alias("ss_between"),
            F.sum(n * F.col("v")).alias("ss_within"),
            F.max("total").alias("total"),
            F.max("k").alias("k"),
        )
    )
    d1, d2 = (F.col("k") - 1).cast("double"), (F.col("total") - F.col("k")).cast("double")
    f = F.try_divide(F.col("ss_between") / F.nullif(d1, F.lit(0.0)), F.nullif(F.col("ss_within") / F.nullif(d2, F.lit(0.0)), F.lit(0.0)))
    return (
        g.select(*keys, "ss_between", "ss_within", d1.alias("df_between"), d2.alias("df_within"), f.alias("f"))
        .withColumn("p_value", dist.f_sf("f", "df_between", "df_within"))
        .withColumn("significant", S.significant(F.col("p_value")))
        .orderBy(*keys)
    )


def two_way(df: DataFrame, factors: Sequence[str], nums: Sequence[str], outcome: str, positive) -> DataFrame:
    """Type II two-way table (factor, binary outcome, interaction) for every pair.

    With two outcome groups the additive model needs one slope after centring
    within levels, so every sum of squares is a sum over (level, outcome) cells.
    """
    src = df.where(F.col(outcome).isNotNull()).withColumn("_y", S.outcome01(outcome, positive))
    cells = group_moments(src, factors, nums, ["_y"])
    keys = ["factor", "feature"]
    n, mean = F.col("n"), F.col("mean")

    def side(y, col):
        return F.coalesce(F.max(F.when(F.col("_y") == y, col)), F.lit(0.0))

    levels = cells.groupBy(*keys, "level").agg(
        side(1, n.cast("double")).alias("n1"),
        side(0, n.cast("double")).alias("n0"),
        side(1, mean).alias("m1"),
        side(0, mean).alias("m0"),
    )
    w = F.col("n1") * F.col("n0") / (F.col("n1") + F.col("n0"))
    gap = F.col("m1") - F.col("m0")
    by_level = levels.groupBy(*keys).agg(
        F.sum(w).alias("w"),
        F.sum(w * gap).alias("wd"),
        F.sum(w * gap * gap).alias("wdd"),
        F.count(F.lit(1)).alias("k"),
        F.count_if(F.col("n1") > 0).alias("k1"),
        F.count_if(F.col("n0") > 0).alias("k0"),
    )
    sides = cells.groupBy(*keys, "_y").agg((F.sum(n * mean) / F.sum("n")).alias("side_mean"))
    off = mean - F.col("side_mean")
    by_side = (
        cells.join(F.broadcast(sides), [*keys, "_y"])
        .groupBy(*keys)
        .agg(
            F.sum(n * F.col("v")).alias("rss_full"),
            F.sum(n * off * off).alias("spread"),
            F.sum("n").alias("total"),
        )
    )
    t = by_level.join(by_side, keys)
    ss_outcome = F.try_divide(F.col("wd") * F.col("wd"), F.nullif(F.col("w"), F.lit(0.0)))
    ss_inter = F.col("wdd") - ss_outcome
    rss_add = F.col("rss_full") + ss_inter
    ss_factor = F.col("rss_full") + F.col("spread") - rss_add
    n_cells = F.col("k1") + F.col("k0")
    t = t.select(
        *keys,
        ss_factor.alias("ss_factor"),
        ss_outcome.alias("ss_outcome"),
        ss_inter.alias("ss_inter"),
        (F.col("k") - 1).cast("double").alias("df_factor"),
        F.lit(1.0).alias("df_outcome"),
        (n_cells - F.col("k") - 1).cast("double").alias("df_inter"),
        (F.col("total") - n_cells).cast("double").alias("df_resid"),
        "rss_full",
    )
    scale = F.nullif(F.col("rss_full") / F.nullif(F.col("df_resid"), F.lit(0.0)), F.lit(0.0))
    out = t
    for part in ("factor", "outcome", "inter"):
        f = F.try_divide(F.col(f"ss_{part}") / F.nullif(F.col(f"df_{part}"), F.lit(0.0)), scale)
        f = F.when(F.col(f"df_{part}") > 0, f)
        out = out.withColumn(f"f_{part}", f).withColumn(
            f"p_{part}", dist.f_sf(f"f_{part}", f"df_{part}", "df_resid")
        )
    flags = {f"{p}_significant": F.coalesce(S.significant(F.col(f"p_{p}")), F.lit(False)) for p in ("factor", "outcome", "inter")}
    return out.withColumns(flags).orderBy(*keys)
