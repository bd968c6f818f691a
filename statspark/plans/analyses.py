"""Whole analyses: each chains operators and returns a dictionary of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from statspark.operators import anova, association, findings, hypothesis, models, profile, regression
from statspark.sources.tables import write_result


def statistical_analysis(
    df: DataFrame,
    outcome: str,
    negative,
    positive,
    keys: Sequence[str],
    numeric: Sequence[str] | None = None,
    factors: Sequence[str] | None = None,
    risk_factors: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Profile, normality, group tests, associations, risks, correlations, ANOVA and findings."""
    skip = {outcome, *keys}
    numeric = list(numeric or [c for c in profile.numeric_columns(df) if c not in skip])
    factors = list(factors or [c for c in profile.categorical_columns(df) if c not in skip])
    risk_factors = list(risk_factors or factors)
    out = {
        "missing": profile.missing_report(df),
        "profile": profile.numeric_profile(df, numeric),
        "describe": profile.describe(df, numeric),
        "frequencies": profile.frequencies(df, factors),
        "normality": hypothesis.normality_table(df, numeric, keys),
        "group_summary": profile.group_summary(df, outcome, numeric),
        "group_tests": hypothesis.choose_tests(df, numeric, keys, outcome, negative, positive),
        "associations": association.association_scan(df, factors, outcome),
        "pearson": association.pearson_pairs(df, numeric, cover=True),
        "spearman": association.spearman_pairs(df, numeric, cover=True),
        "significant_pairs": association.significant_pairs(df, numeric),
        "outcome_correlations": association.outcome_correlations(df, numeric, outcome, positive),
        "risks": association.sorted_risk_table(df, risk_factors, outcome, positive),
        "one_way": anova.one_way(df, factors, numeric),
        "two_way": anova.two_way(df, factors, numeric, outcome, positive),
        "logistic": regression.logistic_inference(df, numeric, factors, outcome, positive),
    }
    out["findings"] = findings.key_findings(
        out["group_tests"], out["risks"], out["outcome_correlations"], out["logistic"]
    )
    return out


def save_results(results: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write every result table under ``folder``; returns the paths."""
    return {name: write_result(df, f"{folder.rstrip('/')}/{name}", fmt) for name, df in results.items()}


def classification_analysis(
    df: DataFrame, outcome: str, positive, keys: Sequence[str], numeric: Sequence[str], categorical: Sequence[str],
    candidates=None, grid=None, seed: int = 42,
):
    """Split, compare classifiers, tune the best one, and report it on the test rows."""
    train, test = models.stratified_split(models.labelled(df, outcome, positive), keys, outcome, seed=seed)
    results = models.compare_classifiers(train, test, numeric, categorical, candidates, seed)
    best = models.best_model(results)
    estimators = candidates or models.default_classifiers(train.count(), seed)
    tuned, scores = models.tune(train, numeric, categorical, keys, best.name, estimators[best.name], grid, seed=seed)
    on_test = models.scored(tuned, test)
    return tuned, {
        "comparison": models.comparison_table(df.sparkSession, results),
        "tuning": scores,
        "report": models.classification_report(on_test, "label", "prediction"),
        "confusion": models.confusion_matrix(on_test, "label", "prediction", [0.0, 1.0]),
        "auc": models.roc_auc(on_test.select("score", "label"), "score", "label"),
        "roc": models.roc_points(on_test.select("score", "label"), "score", "label"),
        "importance": models.feature_importance(tuned, train),
        "reports": models.model_reports(results, test),
        "rocs": models.model_roc(results, test),
    }


def regression_analysis(
    df: DataFrame, targets: Sequence[str], numeric: Sequence[str], categorical: Sequence[str], keys: Sequence[str], **options
) -> models.TargetRuns:
    """All regressors on all feature routes for several targets: fitted models, selected features, variance, sweeps, summary."""
    return models.multi_target(df, targets, numeric, categorical, keys, **options)
