"""The numbers behind common charts, as small tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statspark.functions import dist
from statspark.functions import scalars as S
from statspark.operators.association import pearson_pairs, risk_table, spearman_pairs
from statspark.operators.profile import crosstab_percent, melt, two_factor_means
from statspark.operators.rank import _clean, join_groups, ranked_values, wide_quantiles
from statspark.operators.sampling import fixed_sample


def _extent(df: DataFrame, x: Column, by: Sequence[str] = ()) -> DataFrame:
    aggs = [
        F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("total"),
        F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
    ]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def _binned(df: DataFrame, col: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Count per equal-width bin next to the extent of the column (of the group)."""
    x = _clean(col)
    extent = _extent(df, x, by)
    values = df.select(*by, x.alias("_x")).where(F.col("_x").isNotNull())
    placed = join_groups(values, extent, by) if by else values.crossJoin(F.broadcast(extent))
    width = (F.col("hi") - F.col("lo")) / bins
    index = F.least(F.floor(F.try_divide(F.col("_x") - F.col("lo"), F.nullif(width, F.lit(0.0)))), F.lit(bins - 1))
    keys = [*by, "lo", "hi", "total", "mean", "sd"]
    return placed.groupBy(*keys, F.coalesce(index, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Density histogram; a value on the upper end belongs to the last bin."""
    width = (F.col("hi") - F.col("lo")) / bins
    return _binned(df, col, bins).select(
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("left_edge"),
        "n",
        F.try_divide(F.col("n"), F.col("total") * F.nullif(width, F.lit(0.0))).alias("density"),
    )


def normal_curve(df: DataFrame, col: str, points: int = 100) -> DataFrame:
    """The fitted normal density on an even grid over the column's range."""
    e = _extent(df, _clean(col)).withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    return e.select("point", x.alias("x"), S.normal_pdf(x, F.col("mean"), F.col("sd")).alias("density"))


def _curves(bins: int, points: int):
    """Density at ``points`` places from the filled bins of a group: one matrix product a group, no row per pair."""

    @F.pandas_udf("array<double>")
    def curve(bin_: pd.Series, n: pd.Series, lo: pd.Series, hi: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for b, c, low, high, band in zip(bin_, n, lo, hi, h):
            if not band > 0:
                out.append([None] * points)
                continue
            at = np.arange(points) / (points - 1) * (high - low)
            centre = (np.asarray(b) + 0.5) / bins * (high - low)
            z = (at[:, None] - centre) / band
            share = np.asarray(c, dtype="float64") / (np.sum(c) * band * np.sqrt(2 * np.pi))
            out.append(np.exp(-z * z / 2) @ share)
        return pd.Series(out)

    return curve


def kde(df: DataFrame, col: str, by: Sequence[str] = (), bins: int = 1000, points: int = 200) -> DataFrame:
    """Gaussian kernel density (Scott bandwidth) on an even grid, over counts in fine bins.

    A group shuffles at most ``bins`` counts and returns ``points`` rows; the density of a constant group is null.
    """
    band = F.pow(F.col("total").cast("double"), F.lit(-0.2)) * F.col("sd")
    cells = F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("cells")
    groups = _binned(df, col, bins, by).groupBy(*by, "lo", "hi", "total", "sd").agg(cells)
    curves = groups.withColumn("curve", _curves(bins, points)("cells.bin", "cells.n", "lo", "hi", band))
    x = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    return curves.select(*by, "lo", "hi", F.posexplode("curve").alias("point", "density")).select(*by, "point", x.alias("x"), "density")


def qq_points(df: DataFrame, col: str, points: int = 1000) -> DataFrame:
    """Order statistics against normal quantiles at their Filliben medians, at most ``points`` of them."""
    ranked = ranked_values(df, [col]).select("value", "n", "below_n", F.col("total_n").alias("total"))
    total = F.col("total")
    few = total <= points
    # positions 1 + k (total-1)/(points-1); a distinct value covers below+1 .. below+n
    step = F.when(few, 1.0).otherwise((total - 1) / (points - 1))
    first = F.ceil(F.col("below_n") / step)
    last = F.ceil((F.col("below_n") + F.col("n")) / step) - 1
    k = ranked.withColumns({"first": first, "last": last}).where(F.col("first") <= F.col("last"))
    k = k.withColumn("k", F.explode(F.sequence("first", "last")))
    pos = F.floor(F.col("k") * step) + 1
    return k.select(pos.alias("position"), _filliben(pos, total).alias("p"), F.col("value").alias("sample")).withColumn(
        "theoretical", dist.norm_ppf("p")
    )


def _filliben(pos: Column, total: Column) -> Column:
    tail = F.pow(F.lit(0.5), F.try_divide(F.lit(1.0), total))
    return F.when(pos >= total, tail).when(pos <= 1, 1 - tail).otherwise((pos - 0.3175) / (total + 0.365))


def qq_line(df: DataFrame, col: str, chunk: int = 1000) -> DataFrame:
    """Least-squares line through all order statistics; the positions of a tie are dealt in chunks."""
    ranked = ranked_values(df, [col]).select("value", "n", "below_n", F.col("total_n").alias("total"))
    start = F.explode(F.sequence(F.col("below_n") + 1, F.col("below_n") + F.col("n"), F.lit(chunk).cast("long")))
    chunks = ranked.withColumn("start", start).repartition("start")
    stop = F.least(F.col("start") + (chunk - 1), F.col("below_n") + F.col("n"))
    every = chunks.select("value", "total", F.explode(F.sequence("start", stop)).alias("pos"))
    p = every.select(F.col("value").alias("sample"), _filliben(F.col("pos"), F.col("total")).alias("p"))
    return p.withColumn("theoretical", dist.norm_ppf("p")).agg(
        F.regr_slope("sample", "theoretical").alias("slope"),
        F.regr_intercept("sample", "theoretical").alias("intercept"),
        S.correlation(F.col("sample"), F.col("theoretical")).alias("r"),
    )


def box_stats(df: DataFrame, col: str, group: str) -> DataFrame:
    """Quartiles, whisker ends inside 1.5 IQR, outlier count and mean per group."""
    q = wide_quantiles(df, [col], {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group]).drop("feature")
    iqr = F.col("q3") - F.col("q1")
    fences = q.withColumns({"lower": F.col("q1") - 1.5 * iqr, "upper": F.col("q3") + 1.5 * iqr})
    x = _clean(col)
    inside = x.between(F.col("lower"), F.col("upper"))
    return (
        join_groups(df.select(group, col), fences, [group])
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
            F.avg(x).alias("mean"),
        )
    )


def violin(df: DataFrame, col: str, group: str, bins: int = 1000, points: int = 200) -> DataFrame:
    """Density curve per group next to the group's quartiles."""
    q = wide_quantiles(df, [col], {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group]).drop("feature")
    return kde(df, col, [group], bins, points).join(q, group)


def percent_bars(df: DataFrame, factor: str, outcome: str, outcome_levels: Sequence) -> DataFrame:
    """Row percents in long form, for stacked or grouped bars."""
    names = [str(v) for v in outcome_levels]
    return melt(crosstab_percent(df, factor, outcome, outcome_levels), [factor], names, "outcome", "pct")


def correlation_heatmap(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    return (spearman_pairs if method == "spearman" else pearson_pairs)(df, cols, True)


def scatter_sample(df: DataFrame, x: str, y: str, keys: Sequence[str], n: int = 5000, seed: int = 42) -> DataFrame:
    return fixed_sample(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), keys, n, seed).select(*keys, x, y)


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """OLS trend over all rows."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def mosaic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Share of all rows in each cell."""
    both = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    total = both.agg(F.count(F.lit(1)).alias("_n"))
    cells = both.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    return cells.crossJoin(F.broadcast(total)).select(a, b, (F.col("n") / F.col("_n")).alias("share"))


def forest_rows(table: DataFrame) -> DataFrame:
    """Odds ratio with the lengths of its two error bars, from any table with a CI; unestimable rows left out."""
    return table.where(F.col("ci_lower").isNotNull()).withColumns(
        {
            "error_low": F.col("odds_ratio") - F.col("ci_lower"),
            "error_high": F.col("ci_upper") - F.col("odds_ratio"),
        }
    )


def forest_of_risks(df: DataFrame, factors: Sequence[str], outcome: str, positive) -> DataFrame:
    rows = forest_rows(risk_table(df, factors, outcome, positive))
    return rows.select("factor", "level", "odds_ratio", "error_low", "error_high")


def interaction_means(
    df: DataFrame, anova: DataFrame, outcome: str, outcome_levels: Sequence[str], alpha: float = 0.05
) -> DataFrame:
    """Mean per (level, outcome) for each interaction below ``alpha`` in a two-way table."""
    wanted = [(r["factor"], r["feature"]) for r in anova.where(F.col("p_inter") < alpha).collect()]
    out = None
    for factor, feature in wanted:
        means = two_factor_means(df, factor, outcome, feature, outcome_levels).select(
            F.lit(factor).alias("factor"), F.lit(feature).alias("feature"), F.col(factor).cast("string").alias("level"),
            *[F.col(f"`{v}`") for v in outcome_levels],
        )
        out = means if out is None else out.unionByName(means)
    if out is None:
        cols = ", ".join(f"`{v}` double" for v in outcome_levels)
        out = df.sparkSession.createDataFrame([], f"factor string, feature string, level string, {cols}")
    return out


def actual_vs_predicted(
    df: DataFrame, y: str, pred: str, keys: Sequence[str], n: int = 5000, log_target: bool = False, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Sampled pairs on the original scale, and the two ends of the identity line."""
    a, b = (F.expm1(y), F.expm1(pred)) if log_target else (F.col(y), F.col(pred))
    pairs = df.select(*keys, a.cast("double").alias("actual"), b.cast("double").alias("predicted"))
    ends = pairs.agg(F.min("actual").alias("low"), F.max("actual").alias("high"))
    return fixed_sample(pairs, keys, n, seed), ends


def scored_bars(table: DataFrame, label: str, value: str) -> DataFrame:
    """Label and value sorted for a bar chart: outcome counts, importances, R2 or F1 per target."""
    return table.select(F.col(label).alias("label"), F.col(value).cast("double").alias("value")).orderBy(
        F.col("value").desc_nulls_last(), "label"
    )
