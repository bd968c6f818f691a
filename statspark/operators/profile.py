"""Projection, profiling, frequency tables, reshape and top-k operators."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statspark.functions import scalars as S
from statspark.operators.rank import quantile_map, wide_quantiles

# --- columns and rows -------------------------------------------------------


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop identifier or leakage columns; names that are absent are ignored."""
    return df.drop(*cols)


def keep_existing(df: DataFrame, cols: Sequence[str]) -> list[str]:
    return [c for c in cols if c in df.columns]


def group_values(df: DataFrame, group: str, level, col: str) -> DataFrame:
    """Non-missing values of ``col`` in one outcome group."""
    return df.where((F.col(group) == F.lit(level)) & F.col(col).isNotNull()).select(col)


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.na.drop(subset=[target])


def binarise_at_median(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """1 above the median, else 0 (missing counts as not above)."""
    median = quantile_map(df, [col], 0.5)[col]
    above = F.coalesce(F.col(col) > F.lit(median), F.lit(False)).cast("int")
    return df.withColumn(name or f"{col}_binary", above)


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)).cast("long"))


def head(df: DataFrame, keys: Sequence[str], n: int = 5) -> DataFrame:
    return df.orderBy(*keys).limit(n)


# --- one row per column -----------------------------------------------------


def present(df: DataFrame, c: str) -> Column:
    """Column ``c`` with NaN as null, where its type has NaN."""
    return S.null_if_nan(F.col(c)) if dict(df.dtypes).get(c) in ("double", "float") else F.col(c)


def per_column(df: DataFrame, cols: Sequence[str], stats: Mapping[str, object], by: Sequence[str] = ()) -> DataFrame:
    """Apply ``name -> (column -> aggregate)`` to all columns in one scan, long form.

    One wide aggregate, then its few result rows are turned: no row blow-up. NaN counts as missing.
    """
    aggs = [make(present(df, c)).alias(f"{n}__{i}") for i, c in enumerate(cols) for n, make in stats.items()]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"{n}__{i}").alias(n) for n in stats])
            for i, c in enumerate(cols)
        ]
    )
    return wide.select(*by, F.inline(rows))


def unbiased_skewness(x: Column) -> Column:
    """Sample skewness with the small-sample correction; missing below three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def unbiased_kurtosis(x: Column) -> Column:
    """Sample excess kurtosis with the small-sample correction; missing below four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def numeric_summary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, sample standard deviation, min, max and count per column."""
    d = "double"
    return per_column(
        df,
        cols,
        {
            "n": F.count,
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": lambda c: F.min(c).cast(d),
            "max": lambda c: F.max(c).cast(d),
        },
    )


def median_iqr(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    q = wide_quantiles(df, cols, {"q1": 0.25, "median": 0.5, "q3": 0.75}, by)
    return q.select(*by, "feature", "median", (F.col("q3") - F.col("q1")).alias("iqr"))


def shape_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    return per_column(
        df, cols, {"n": F.count, "skewness": unbiased_skewness, "kurtosis": unbiased_kurtosis}
    )


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """The full per-column table: mean, median, std, min, max, IQR, skewness, kurtosis."""
    moments = per_column(
        df,
        cols,
        {
            "mean": F.avg,
            "std": F.stddev_samp,
            "min": lambda c: F.min(c).cast("double"),
            "max": lambda c: F.max(c).cast("double"),
            "skewness": unbiased_skewness,
            "kurtosis": unbiased_kurtosis,
        },
    )
    return moments.join(median_iqr(df, cols), "feature", "left")


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, exact quartiles and max, one row per column."""
    quartiles = wide_quantiles(df, cols, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return numeric_summary(df, cols).join(quartiles, "feature", "left")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Type, missing count (null or NaN) and missing percent per column."""
    cols = list(cols or df.columns)
    types = dict(df.dtypes)
    wide = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(present(df, c).isNull()).alias(f"m{i}") for i, c in enumerate(cols)],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(types[c]).alias("dtype"),
                F.col(f"m{i}").alias("n_missing"),
                (100.0 * F.col(f"m{i}") / F.nullif(F.col("_n"), F.lit(0))).alias("pct_missing"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return wide.select(F.inline(rows))


def tail_range(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """5th and 95th percentile with min and max."""
    ends = per_column(
        df, cols, {"min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double")}
    )
    return wide_quantiles(df, cols, {"p05": 0.05, "p95": 0.95}).join(ends, "feature")


def tukey_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Rows outside the Tukey fences: fences, count and share of all rows."""
    fences = {
        r["feature"]: (r["q1"] - k * (r["q3"] - r["q1"]), r["q3"] + k * (r["q3"] - r["q1"]))
        for r in wide_quantiles(df, cols, {"q1": 0.25, "q3": 0.75}).collect()
    }
    cols = [c for c in cols if c in fences]
    counts = df.agg(
        F.count(F.lit(1)).alias("_n"),
        *[
            F.count_if((F.col(c) < fences[c][0]) | (F.col(c) > fences[c][1])).alias(f"o{i}")
            for i, c in enumerate(cols)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.lit(fences[c][0]).alias("lower"),
                F.lit(fences[c][1]).alias("upper"),
                F.col(f"o{i}").alias("n_outliers"),
                (100.0 * F.col(f"o{i}") / F.nullif(F.col("_n"), F.lit(0))).alias("pct_outliers"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return counts.select(F.inline(rows))


# --- groups and factors -----------------------------------------------------


def group_summary(df: DataFrame, group: str, cols: Sequence[str]) -> DataFrame:
    """Count, mean, median and standard deviation of each column in each group."""
    stats = per_column(df, cols, {"n": F.count, "mean": F.avg, "std": F.stddev_samp}, by=[group])
    return stats.join(wide_quantiles(df, cols, {"median": 0.5}, [group]), [group, "feature"], "left")


def factor_long(df: DataFrame, factors: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Melt factors to ``(keep…, factor, level)``, levels as text."""
    cast = df.select(*keep, *[F.col(f).cast("string").alias(f) for f in factors])
    return cast.unpivot(list(keep), list(factors), "factor", "level")


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable", val: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), var, val)


def frequencies(df: DataFrame, factors: Sequence[str]) -> DataFrame:
    """Count and percent of every level of every factor (missing left out), one pass."""
    counts = (
        factor_long(df, factors)
        .where(F.col("level").isNotNull())
        .groupBy("factor", "level")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("factor").agg(F.sum("n").alias("_n"))
    return (
        counts.join(F.broadcast(totals), "factor")  # one row per named factor
        .withColumn("pct", 100.0 * F.col("n") / F.col("_n"))
        .drop("_n")
        .orderBy("factor", F.col("n").desc(), "level")
    )


def levels(df: DataFrame, col: str, limit: int = 1000) -> list:
    """Sorted distinct values, for pivots; refuses a column with more than ``limit``."""
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{col} has more than {limit} levels; use the long form")
    return sorted(found)


def _tally(df: DataFrame, weight: str | None) -> tuple[DataFrame, str]:
    name = weight or "_w"
    return (df, name) if weight else (df.withColumn("_w", F.lit(1).cast("long")), name)


def crosstab(
    df: DataFrame, row: str, col: str, col_levels: Sequence | None = None, weight: str | None = None
) -> DataFrame:
    """Contingency table, one column per level of ``col``; rows missing either are left out."""
    col_levels = list(col_levels) if col_levels is not None else levels(df, col)
    src, w = _tally(df, weight)
    return (
        src.where(F.col(row).isNotNull() & F.col(col).isin(col_levels))
        .groupBy(row)
        .agg(
            *[
                F.sum(F.when(F.col(col) == F.lit(v), F.col(w)).otherwise(0)).alias(str(v))
                for v in col_levels
            ]
        )
    )


def crosstab_percent(
    df: DataFrame, row: str, col: str, col_levels: Sequence | None = None, weight: str | None = None
) -> DataFrame:
    """Row-percent contingency table."""
    col_levels = list(col_levels) if col_levels is not None else levels(df, col)
    table = crosstab(df, row, col, col_levels, weight)
    total = sum((F.col(f"`{v}`") for v in col_levels), F.lit(0))
    return table.select(
        row, *[(100.0 * F.col(f"`{v}`") / F.nullif(total, F.lit(0))).alias(str(v)) for v in col_levels]
    )


def distinct_counts(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column.

    The exact form melts first, so that all columns share one two-step
    aggregate instead of one Expand per distinct count.
    """
    if approximate:
        return per_column(df, cols, {"n_distinct": F.approx_count_distinct})
    pairs = factor_long(df, cols).where(F.col("level").isNotNull()).groupBy("factor", "level").agg(F.count(F.lit(1)))
    found = pairs.groupBy("factor").agg(F.count(F.lit(1)).alias("n_distinct"))
    return found.withColumnRenamed("factor", "feature")


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    return df.select(col).distinct()


def mode_levels(df: DataFrame, factors: Sequence[str], weight: str | None = None) -> DataFrame:
    """Most frequent level per factor; ties go to the smallest level."""
    src, w = _tally(df, weight)
    counts = (
        factor_long(src, factors, [w])
        .where(F.col("level").isNotNull())
        .groupBy("factor", "level")
        .agg(F.sum(w).alias("n"))
    )
    best = F.min(F.struct((-F.col("n")).alias("k"), "level", "n"))
    return counts.groupBy("factor").agg(best.alias("b")).select("factor", "b.level", "b.n")


def positive_rates(
    df: DataFrame, factor: str, outcome: str, positive, weight: str | None = None
) -> DataFrame:
    """Positive share by level next to the overall share."""
    src, w = _tally(df.where(F.col(outcome).isNotNull()), weight)
    hit = F.when(F.col(outcome) == F.lit(positive), F.col(w)).otherwise(0)
    overall = src.agg((F.sum(hit) / F.nullif(F.sum(w), F.lit(0))).alias("overall_rate"))
    by_level = (
        src.where(F.col(factor).isNotNull())
        .groupBy(F.col(factor).alias("level"))
        .agg(F.sum(w).alias("n"), (F.sum(hit) / F.nullif(F.sum(w), F.lit(0))).alias("rate"))
    )
    return by_level.crossJoin(F.broadcast(overall))


def top_rate_level(df: DataFrame, factor: str, outcome: str, positive, weight: str | None = None) -> DataFrame:
    """Level with the highest positive rate; ties go to the smallest level."""
    rates = positive_rates(df, factor, outcome, positive, weight)
    best = F.min(F.struct((-F.col("rate")).alias("k"), "level", "rate"))
    return rates.agg(best.alias("b")).select("b.level", "b.rate")


def two_factor_means(df: DataFrame, row: str, col: str, value: str, col_levels: Sequence) -> DataFrame:
    return df.groupBy(row).pivot(col, list(col_levels)).agg(F.avg(value))


# --- joins ------------------------------------------------------------------


def top_levels(df: DataFrame, col: str, k: int) -> DataFrame:
    """The k most frequent levels; ties by name."""
    return (
        df.where(F.col(col).isNotNull())
        .groupBy(col)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), col)
        .limit(k)
    )


def keep_top_levels(df: DataFrame, col: str, k: int) -> DataFrame:
    """Rows whose level is among the k most frequent; the join side has k rows."""
    return df.join(F.broadcast(top_levels(df, col, k).select(col)), col, "left_semi")


def attach(summary: DataFrame, results: DataFrame, on: str = "feature") -> DataFrame:
    """Attach test results to a feature summary, keeping features without a result."""
    return summary.join(results, on, "left")


def lookup(df: DataFrame, codes: Mapping[str, float], level: str, name: str, default=None) -> DataFrame:
    """Replace a level by its code; unknown levels get ``default``."""
    table = df.sparkSession.createDataFrame(list(codes.items()), f"`{level}` string, `{name}` double")
    # the table is a driver-side dict, so its size is known
    return df.join(F.broadcast(table), level, "left").withColumn(name, F.coalesce(F.col(name), F.lit(default)))


# --- reshape and top-k ------------------------------------------------------


def transpose(df: DataFrame, id_col: str, id_levels: Sequence[str]) -> DataFrame:
    """Turn a summary: old columns become rows named in ``statistic``."""
    others = [c for c in df.columns if c != id_col]
    long = df.select(id_col, *[F.col(c).cast("double") for c in others]).unpivot(
        [id_col], others, "statistic", "value"
    )
    return long.groupBy("statistic").pivot(id_col, list(id_levels)).agg(F.first("value"))


def dummies(df: DataFrame, col: str, col_levels: Sequence) -> DataFrame:
    """Append one 0/1 column per level."""
    return df.select(
        "*",
        *[F.coalesce((F.col(col) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{col}_{v}") for v in col_levels],
    )


def stack_rows(parts: Sequence[DataFrame]) -> DataFrame:
    """Stack result tables by column name; absent columns are filled with null."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def by_magnitude(df: DataFrame, col: str, tie: Sequence[str], k: int | None = None) -> DataFrame:
    """Sort by absolute value, largest first; the first k when given."""
    out = df.orderBy(F.abs(F.col(col)).desc_nulls_last(), *tie)
    return out.limit(k) if k else out


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def best_by(df: DataFrame, metric: str, ordinal: str) -> DataFrame:
    """The row with the largest metric; the first in ``ordinal`` order wins a tie."""
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(ordinal)).limit(1)
