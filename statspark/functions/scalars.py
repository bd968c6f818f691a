"""Column expressions used by the operators; every one stays JVM-side."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def outcome01(outcome: str | Column, positive) -> Column:
    """1 for the positive outcome, else 0 (a missing outcome is not positive)."""
    col = F.col(outcome) if isinstance(outcome, str) else outcome
    return F.when(col == F.lit(positive), 1).otherwise(0)


def effect_label(d: Column) -> Column:
    """Size of an absolute standardised mean difference."""
    return F.when(d < 0.5, "Small").when(d < 0.8, "Medium").when(d.isNotNull(), "Large")


def association_label(v: Column) -> Column:
    return F.when(v < 0.1, "Weak").when(v < 0.3, "Moderate").when(v.isNotNull(), "Strong")


def correlation_label(r: Column) -> Column:
    size = F.abs(r)
    return F.when(size < 0.3, "Weak").when(size < 0.7, "Moderate").when(r.isNotNull(), "Strong")


def direction_label(r: Column) -> Column:
    return F.when(r > 0, "Positive").when(r.isNotNull(), "Negative")


def significant(p: Column, alpha: float = 0.05) -> Column:
    return p < alpha


def normal_flag(p: Column, alpha: float = 0.05) -> Column:
    return p > alpha


def decide(score: Column, high="positive", low="negative", threshold: float = 0.5) -> Column:
    """Decision at a strict score threshold."""
    return F.when(score > threshold, high).when(score.isNotNull(), low)


def null_if_nan(col: Column) -> Column:
    return F.when(F.isnan(col), None).otherwise(col)


def null_if_not_finite(col: Column) -> Column:
    """NaN and plus/minus infinity become null."""
    bad = F.isnan(col) | (F.abs(col) == float("inf"))
    return F.when(bad, None).otherwise(col)


def safe_ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def band(col: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins, lowest edge included, numbered from 1; null outside.

    ``Bucketizer`` closes its bins on the left, so a CASE chain is used.
    """
    out = F.when((col < edges[0]) | (col > edges[-1]), None)
    for i, edge in enumerate(edges[1:], start=1):
        out = out.when(col <= edge, i)
    return out


def normal_pdf(x: Column, mean: Column, sd: Column) -> Column:
    z = (x - mean) / F.nullif(sd, F.lit(0.0))
    return F.exp(-z * z / 2) / (F.nullif(sd, F.lit(0.0)) * math.sqrt(2 * math.pi))


def correlation(x: Column, y: Column) -> Column:
    """Aggregate: Pearson r over rows where both are present, NaN counting as missing; null for a constant column.

    The built-in ``corr`` divides by zero there when ANSI mode is on.
    """
    x, y = null_if_nan(x), null_if_nan(y)
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), F.nullif(spread, F.lit(0.0)))


def slug(name: Column) -> Column:
    """Lower-case with blanks as underscores, as used in output names."""
    return F.lower(F.translate(name, " ", "_"))


def fixed(col: Column, digits: int) -> Column:
    """Fixed-point text with ``digits`` decimals and no thousands separators."""
    return F.format_string(f"%.{digits}f", col)


def rounded(df, digits: int, *cols: str):
    """Round report columns; all floating columns when none is named."""
    wanted = cols or [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.round(c, digits) for c in wanted})
