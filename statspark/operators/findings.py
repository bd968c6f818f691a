"""The data part of a findings report: the strongest significant results and one line for each kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_correlates(outcome_corr: DataFrame, k: int = 3) -> DataFrame:
    """Columns most correlated with the outcome, significant or not."""
    return outcome_corr.orderBy(F.abs("r").desc_nulls_last(), "feature").limit(k)


def top_differences(group_tests: DataFrame, k: int = 5) -> DataFrame:
    return (
        group_tests.where("significant").orderBy(F.col("effect_size").desc_nulls_last(), "feature").limit(k)
    )


def top_associations(associations: DataFrame, k: int = 5) -> DataFrame:
    return associations.where("significant").orderBy(F.col("cramers_v").desc_nulls_last(), "factor").limit(k)


def top_risks(risks: DataFrame, k: int = 5) -> DataFrame:
    return (
        risks.where("significant").orderBy(F.col("odds_ratio").desc_nulls_last(), "factor", "level").limit(k)
    )


def top_pairs(pairs: DataFrame, k: int = 5) -> DataFrame:
    return pairs.where("significant").orderBy(F.abs("r").desc(), "feature_1", "feature_2").limit(k)


def significant_predictors(logistic: DataFrame) -> DataFrame:
    return logistic.where(F.col("significant") & (F.col("term") != "const")).orderBy(
        F.col("odds_ratio").desc(), "term"
    )


def _line(table: DataFrame, rank: int, kind: str, order: Sequence[Column], text: Column) -> DataFrame:
    return table.orderBy(*order).limit(1).select(
        F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), text.alias("text")
    )


def key_findings(
    group_tests: DataFrame | None = None,
    risks: DataFrame | None = None,
    outcome_corr: DataFrame | None = None,
    logistic: DataFrame | None = None,
) -> DataFrame:
    """One sentence per kind of result that has a significant row: ``rank, kind, text``.

    The correlation line looks at the strongest correlate only; without any
    finding a single placeholder row is returned.
    """
    parts = []
    if group_tests is not None:
        parts.append(
            _line(
                group_tests.where("significant"), 1, "difference", [F.col("effect_size").desc(), F.col("feature")],
                F.format_string("%s differs most between the groups: %s effect (%.2f)", "feature", "magnitude", "effect_size"),
            )
        )
    if risks is not None:
        parts.append(
            _line(
                risks.where("significant"), 2, "risk", [F.col("odds_ratio").desc_nulls_last(), F.col("factor"), F.col("level")],
                F.format_string(
                    "%s = %s: %.2f times the odds of a positive outcome (95%% CI %.2f-%.2f)",
                    "factor", "level", "odds_ratio", "ci_lower", "ci_upper",
                ),
            )
        )
    if outcome_corr is not None:
        parts.append(
            _line(
                top_correlates(outcome_corr, 1).where("significant"), 3, "correlation", [F.col("feature")],
                F.format_string("%s correlates most with the outcome: %s, r = %.2f", "feature", F.lower("direction"), "r"),
            )
        )
    if logistic is not None:
        parts.append(
            _line(
                significant_predictors(logistic), 4, "predictor", [F.col("odds_ratio").desc(), F.col("term")],
                F.format_string("%s stays a predictor in the joint model: odds ratio %.2f (p = %.4f)", "term", "odds_ratio", "p_value"),
            )
        )
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    session = found.sparkSession
    count = found.agg(F.count(F.lit(1)).alias("n"))
    empty = session.range(1).crossJoin(count).where(F.col("n") == 0).select(
        F.lit(1).alias("rank"), F.lit("none").alias("kind"), F.lit("No statistically significant finding").alias("text")
    )
    return found.unionByName(empty).orderBy("rank")
