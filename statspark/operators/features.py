"""Feature engineering: imputation, scaling, encoding, outliers, power transform, selection.

Each step is fitted by one or a few aggregations whose result is a handful of
numbers per column; applying it is a projection with those numbers as literals.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    PCA,
    SQLTransformer,
    StandardScaler,
    StringIndexer,
    UnivariateFeatureSelector,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statspark.functions import dist
from statspark.functions import scalars as S
from statspark.operators.hypothesis import column_samples, shapiro
from statspark.operators.profile import (
    frequencies, mode_levels, per_column, top_levels, unbiased_kurtosis, unbiased_skewness,
)
from statspark.operators.rank import lookup_skewed, quantile_map, wide_quantiles
from statspark.session import bucket_count

INFREQUENT = "__infrequent__"


def _lit(v: float) -> str:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def _text(v: str) -> str:
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


# --- imputation and scaling -------------------------------------------------


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians; a column without values gets none."""
    return {c: m for c, m in quantile_map(df, cols, 0.5).items() if m is not None}


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    return {r["factor"]: r["level"] for r in mode_levels(df, cols).collect()}


def fill(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace missing values (NaN included) by a fitted value per column."""
    kinds = dict(df.dtypes)

    def one(c, v):
        col = S.null_if_nan(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
        return F.coalesce(col, F.lit(v))

    return df.withColumns({c: one(c, v) for c, v in values.items()})


def fit_moments(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population standard deviation per column."""
    rows = per_column(df, cols, {"m": F.avg, "s": F.stddev_pop}).collect()
    return {r["feature"]: (r["m"], r["s"]) for r in rows}


def standardise(df: DataFrame, moments: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Centre and divide by the population deviation; a constant column becomes zero."""
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s or 1.0) for c, (m, s) in moments.items()})


def remove_outliers(
    df: DataFrame, moments: Mapping[str, tuple[float, float]], threshold: float = 3.0
) -> DataFrame:
    """Values more than ``threshold`` population deviations from the mean become missing."""
    return df.withColumns(
        {
            c: F.when(F.abs(F.col(c) - F.lit(m)) > F.lit(threshold * (s or 0.0)), None).otherwise(F.col(c))
            for c, (m, s) in moments.items()
            if m is not None
        }
    )


# --- categories -------------------------------------------------------------


def one_hot_stages(cols: Sequence[str]) -> list:
    """Index and encode; an unknown or missing level becomes the zero vector, none is dropped."""
    return [
        StringIndexer(
            inputCols=list(cols), outputCols=[f"{c}__ix" for c in cols],
            handleInvalid="keep", stringOrderType="alphabetAsc",
        ),
        # the slot kept for unknown levels is the one that is dropped
        OneHotEncoder(
            inputCols=[f"{c}__ix" for c in cols], outputCols=[f"{c}__oh" for c in cols],
            dropLast=True,
        ),
    ]


def fit_frequent(df: DataFrame, col: str, max_categories: int = 10) -> list[str] | None:
    """Levels kept when a factor has more than ``max_categories``; None when all are kept."""
    top = [r[0] for r in top_levels(df, col, max_categories + 1).collect()]
    return top[: max_categories - 1] if len(top) > max_categories else None


def merge_infrequent(df: DataFrame, col: str, kept: Sequence[str] | None) -> DataFrame:
    if kept is None:
        return df
    c = F.col(col)
    return df.withColumn(col, F.when(c.isin(list(kept)) | c.isNull(), c).otherwise(INFREQUENT))


def drop_first_dummies(df: DataFrame, factors: Sequence[str], below: int = 10) -> tuple[DataFrame, list[str]]:
    """0/1 columns for all levels but the first, factors with ``below`` or more levels left out.

    A column for missing values is made only where there are any.
    """
    if not factors:
        return df, []
    # two scans for all factors: a rough count keeps wide factors out of the second
    seen = df.agg(
        *[F.count_if(F.col(f).isNull()).alias(f"gaps{i}") for i, f in enumerate(factors)],
        *[F.approx_count_distinct(f).alias(f"about{i}") for i, f in enumerate(factors)],
    ).first()
    narrow = {f: seen[f"gaps{i}"] for i, f in enumerate(factors) if seen[f"about{i}"] < 2 * below}
    found = df.agg(*[F.collect_set(f).alias(f) for f in narrow]).first().asDict() if narrow else {}
    made: dict[str, Column] = {}
    for f, gaps in narrow.items():
        if len(found[f]) >= below:
            continue
        for level in sorted(found[f])[1:]:
            made[f"{f}_{level}"] = F.coalesce((F.col(f) == F.lit(level)).cast("double"), F.lit(0.0))
        if gaps:
            made[f"{f}_nan"] = F.col(f).isNull().cast("double")
    return df.withColumns(made) if made else df, list(made)


def frequency_codes(df: DataFrame, col: str) -> DataFrame:
    """``level, code``: each level's share of the non-missing rows."""
    return frequencies(df, [col]).select("level", (F.col("pct") / 100).alias("code"))


def frequency_encode(df: DataFrame, col: str, name: str, codes: DataFrame | None = None) -> DataFrame:
    """Replace a level by its share; a level not in ``codes`` gets null."""
    codes = frequency_codes(df, col) if codes is None else codes
    table = codes.select(F.col("level").alias("_key"), F.col("code").alias(name))
    limit = bucket_count(df.sparkSession)
    return lookup_skewed(df, F.col(col).cast("string"), table, name, F.col(name) * limit > 1)


# --- derived features -------------------------------------------------------


def domain_stage(
    ratios: Sequence[tuple[str, str, str]] = (), bands: Sequence[tuple[str, str, Sequence[float]]] = ()
) -> SQLTransformer:
    """Ratios ``(name, numerator, denominator)`` and right-closed bands ``(name, column, edges)``.

    A zero denominator or a non-finite result gives null.
    """
    parts = []
    for name, a, b in ratios:
        q = f"try_divide(CAST(`{a}` AS DOUBLE), nullif(CAST(`{b}` AS DOUBLE), 0D))"
        parts.append(f"CASE WHEN isnan({q}) OR abs({q}) = CAST('Infinity' AS DOUBLE) THEN NULL ELSE {q} END AS `{name}`")
    for name, c, edges in bands:
        steps = " ".join(f"WHEN `{c}` <= {e} THEN {i}D" for i, e in enumerate(edges[1:], start=1))
        parts.append(f"CASE WHEN `{c}` < {edges[0]} OR `{c}` > {edges[-1]} THEN NULL {steps} END AS `{name}`")
    return SQLTransformer(statement="SELECT *" + "".join(f", {p}" for p in parts) + " FROM __THIS__")


def yeo_johnson_sql(x: str, lam: float) -> str:
    pos = f"log1p({x})" if abs(lam) < 1e-12 else f"(pow({x} + 1, {_lit(lam)}) - 1) / {_lit(lam)}"
    neg = (
        f"-log1p(-({x}))" if abs(lam - 2) < 1e-12 else f"-(pow(1 - ({x}), {_lit(2 - lam)}) - 1) / {_lit(2 - lam)}"
    )
    return f"CASE WHEN {x} >= 0 THEN {pos} WHEN {x} < 0 THEN {neg} END"


def yeo_johnson(df: DataFrame, lambdas: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.expr(yeo_johnson_sql(f"CAST(`{c}` AS DOUBLE)", lam)) for c, lam in lambdas.items()})


def _power_sums(grids: Sequence[Sequence[float]], means: Sequence[float]):
    """A task's sums of the transformed columns and of their squares, each less the transformed mean, per grid point."""

    def one(x: np.ndarray, lam: float) -> np.ndarray:
        up, down = np.maximum(x, 0.0), np.maximum(-x, 0.0)
        pos = np.log1p(up) if abs(lam) < 1e-12 else (np.power(up + 1, lam) - 1) / lam
        neg = -np.log1p(down) if abs(lam - 2) < 1e-12 else -(np.power(down + 1, 2 - lam) - 1) / (2 - lam)
        return np.where(x < 0, neg, pos)

    def run(batches):
        at = [(i, k, lam) for i, grid in enumerate(grids) for k, lam in enumerate(grid)]
        with np.errstate(all="ignore"):
            middle = [one(np.array([means[i]]), lam)[0] for i, _, lam in at]
            sums = np.zeros((len(at), 2))
            for batch in batches:
                xs = [c.drop_null().to_numpy(zero_copy_only=False) for c in batch.columns]
                for j, (i, _, lam) in enumerate(at):
                    d = one(xs[i], lam) - middle[j]
                    sums[j] += d.sum(), d @ d
        yield pa.RecordBatch.from_pydict({"i": [a[0] for a in at], "k": [a[1] for a in at], "d": sums[:, 0], "dd": sums[:, 1]})

    return run


def fit_yeo_johnson(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Maximum-likelihood lambda per column, by a grid narrowed over three scans.

    A task of a scan reduces its rows to two sums per column and grid point, so no row is multiplied; a parabola
    through the last grid's best points gives the final value.
    """
    xs = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    base = xs.agg(
        *[F.sum(F.signum(f"x{i}") * F.log1p(F.abs(f"x{i}"))).alias(f"s{i}") for i in range(len(cols))],
        *[F.count(f"x{i}").alias(f"n{i}") for i in range(len(cols))],
        *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(cols))],
    ).first()
    means = [base[f"m{i}"] or 0.0 for i in range(len(cols))]
    best = {c: 0.0 for c in cols}
    for step in (1.0, 0.25, 0.05):
        grids = {c: [best[c] + step * k for k in range(-4, 5)] for c in cols}
        parts = xs.mapInArrow(_power_sums([grids[c] for c in cols], means), "i long, k long, d double, dd double")
        found = {(r["i"], r["k"]): r for r in parts.groupBy("i", "k").agg(F.sum("d").alias("d"), F.sum("dd").alias("dd")).collect()}
        for i, c in enumerate(cols):
            scores = []
            for k, lam in enumerate(grids[c]):
                n, r = base[f"n{i}"], found.get((i, k))
                v = r["dd"] / n - (r["d"] / n) ** 2 if n and r else None
                usable = v is not None and math.isfinite(v) and v > 0
                scores.append(-base[f"n{i}"] / 2 * math.log(v) + (lam - 1) * base[f"s{i}"] if usable else -math.inf)
            best[c] = _peak(grids[c], scores, refine=step == 0.05)
    return best


def _peak(grid: Sequence[float], scores: Sequence[float], refine: bool) -> float:
    """Grid point with the best score, moved to the vertex of the parabola through its neighbours."""
    k = max(range(len(grid)), key=lambda j: scores[j])
    if scores[k] == -math.inf:
        return 1.0
    if not refine or k in (0, len(grid) - 1):
        return grid[k]
    left, mid, right = scores[k - 1], scores[k], scores[k + 1]
    bend = left - 2 * mid + right
    shift = 0.5 * (left - right) / bend if math.isfinite(bend) and bend < 0 else 0.0
    return grid[k] + shift * (grid[1] - grid[0])


def target_profile(df: DataFrame, target: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Shapiro p on a seeded sample, skewness, kurtosis, Tukey outliers, tails, and whether to use log1p."""
    moments = per_column(df, [target], {"skewness": unbiased_skewness, "kurtosis": unbiased_kurtosis})
    normal = shapiro(column_samples(df, [target], keys, seed=seed)).select("feature", "shapiro_p")
    skewed = (F.col("shapiro_p") < 0.05) | (F.abs("skewness") > 1)
    q = wide_quantiles(df, [target], {"p05": 0.05, "q1": 0.25, "q3": 0.75, "p95": 0.95}).first()
    reach = 1.5 * (q["q3"] - q["q1"])
    lower, upper = q["q1"] - reach, q["q3"] + reach
    x = F.col(target)
    ends = df.agg(
        F.min(x).cast("double").alias("min"),
        F.max(x).cast("double").alias("max"),
        F.count_if((x < lower) | (x > upper)).alias("n_outliers"),
        F.count(F.lit(1)).alias("_n"),
    ).select(
        F.lit(target).alias("feature"), "min", "max", F.lit(q["p05"]).alias("p05"), F.lit(q["p95"]).alias("p95"),
        "n_outliers", (100.0 * F.col("n_outliers") / F.col("_n")).alias("pct_outliers"),
    )
    return (
        moments.join(normal, "feature", "left")
        .join(ends, "feature")
        .withColumn("use_log1p", F.coalesce(skewed, F.lit(False)) & (F.col("min") > 0))
    )


# --- selection --------------------------------------------------------------


def f_regression(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Univariate F score of each column against a numeric target, highest first."""
    y = F.col(target).cast("double")
    rows = per_column(
        df,
        cols,
        {
            "r": lambda c: S.correlation(c.cast("double"), y),
            "n": lambda c: F.count(F.when(c.isNotNull() & y.isNotNull(), 1)),
        },
    )
    rest = F.nullif(1 - F.col("r") * F.col("r"), F.lit(0.0))
    f = F.col("r") * F.col("r") * (F.col("n") - 2) / rest
    return (
        rows.select("feature", f.alias("f_score"), (F.col("n") - 2).cast("double").alias("dof"))
        .withColumn("p_value", dist.f_sf("f_score", F.lit(1.0), "dof"))
        .orderBy(F.col("f_score").desc_nulls_last(), "feature")
    )


def top_features(df: DataFrame, cols: Sequence[str], target: str, k: int = 20) -> list[str]:
    return [r["feature"] for r in f_regression(df, cols, target).limit(k).collect()]


def selector_stage(k: int = 20, features: str = "features", label: str = "label", output: str = "selected"):
    """Top-k univariate F selection on an assembled vector."""
    return (
        UnivariateFeatureSelector(featuresCol=features, labelCol=label, outputCol=output, selectionMode="numTopFeatures")
        .setFeatureType("continuous")
        .setLabelType("continuous")
        .setSelectionThreshold(k)
    )


def vector_names(df: DataFrame, col: str = "features") -> list[str]:
    """Slot names of an assembled vector from its column metadata."""
    meta = df.schema[col].metadata["ml_attr"]
    slots = [a for group in meta.get("attrs", {}).values() for a in group]
    names = {a["idx"]: a.get("name", f"slot_{a['idx']}") for a in slots}
    return [names.get(i, f"slot_{i}") for i in range(meta["num_attrs"])]


def plain_slot(name: str) -> str:
    """The column (and level) behind a slot of ``fit_preprocessor``; only the mark that it set last is taken off."""
    head, mark, level = name.rpartition("__cat__oh")
    return f"{head}{level}" if mark else name.removesuffix("__num")


def fit_pca(
    df: DataFrame, features: str = "features", share: float = 0.95, output: str = "components"
) -> tuple[PipelineModel, DataFrame]:
    """Centred PCA keeping the fewest components that reach ``share``, and the variance table."""
    width = df.schema[features].metadata["ml_attr"]["num_attrs"]
    centre = StandardScaler(inputCol=features, outputCol="_centred", withMean=True, withStd=False).fit(df)
    full = PCA(k=width, inputCol="_centred", outputCol="_pcs").fit(centre.transform(df))
    ratios = [float(v) for v in full.explainedVariance.toArray()]
    total, kept = 0.0, 0
    rows = []
    for i, v in enumerate(ratios, start=1):
        total += v
        if kept == 0 and total >= share - 1e-12:
            kept = i
        rows.append((i, v, total))
    kept = kept or width
    cut = VectorSlicer(inputCol="_pcs", outputCol=output, indices=list(range(kept)))
    table = df.sparkSession.createDataFrame(rows, "component int, variance_ratio double, cumulative double")
    return PipelineModel([centre, full, cut]), table.withColumn("kept", F.col("component") <= kept)


# --- whole preprocessing ----------------------------------------------------


def fit_preprocessor(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    power: bool = False,
    outlier_z: float | None = None,
    max_categories: int | None = None,
    output: str = "features",
    fitted: Mapping[str, str] | None = None,
) -> PipelineModel:
    """Column-wise preprocessing fitted on the training rows only, as a saveable pipeline.

    Numeric: optional z-score outlier removal, median fill, optional Yeo-Johnson,
    standardise. Categorical: mode fill, optional merging of rare levels, one-hot.
    Columns in ``fitted`` (of ``fit_columns`` on the same rows with the same options) are not fitted again.
    """
    expr = dict(fitted or {})
    expr |= fit_columns(train, [c for c in numeric if c not in expr], [c for c in categorical if c not in expr], power, outlier_z, max_categories)
    parts = [f"{expr[c]} AS `{c}__num`" for c in numeric] + [f"{expr[c]} AS `{c}__cat`" for c in categorical]
    prepare = SQLTransformer(statement="SELECT *, " + ", ".join(parts) + " FROM __THIS__")
    stages, inputs = [prepare], [f"{c}__num" for c in numeric]
    if categorical:
        work = train.select(*[F.col(c).cast("double").alias(c) for c in numeric], *categorical)
        index, encode = one_hot_stages([f"{c}__cat" for c in categorical])
        indexed = index.fit(prepare.transform(work))
        encoded = encode.fit(indexed.transform(prepare.transform(work)))
        stages += [indexed, encoded]
        inputs += [f"{c}__cat__oh" for c in categorical]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=output, handleInvalid="error"))
    return PipelineModel(stages)


def fit_columns(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    power: bool = False,
    outlier_z: float | None = None,
    max_categories: int | None = None,
) -> dict[str, str]:
    """Per column the SQL expression that prepares it, with what was fitted as literals."""
    numeric, categorical = list(numeric), list(categorical)
    work = train.select(*[F.col(c).cast("double").alias(c) for c in numeric], *categorical)
    expr = {c: f"CASE WHEN NOT isnan(CAST(`{c}` AS DOUBLE)) THEN CAST(`{c}` AS DOUBLE) END" for c in numeric}

    def current() -> DataFrame:
        return work.selectExpr(*[f"{e} AS `{c}`" for c, e in expr.items()])

    if numeric and outlier_z is not None:
        for c, (m, s) in fit_moments(current(), numeric).items():
            if m is not None:
                expr[c] = f"CASE WHEN abs({expr[c]} - {_lit(m)}) <= {_lit(outlier_z * (s or 0.0))} THEN {expr[c]} END"
    if numeric:
        medians = fit_medians(current(), numeric)
        expr = {c: f"coalesce({e}, {_lit(medians.get(c, 0.0))})" for c, e in expr.items()}
    if numeric and power:
        lambdas = fit_yeo_johnson(current(), numeric)
        expr = {c: yeo_johnson_sql(f"({e})", lambdas[c]) for c, e in expr.items()}
    if numeric:
        moments = fit_moments(current(), numeric)
        expr = {c: f"(({e}) - {_lit(moments[c][0])}) / {_lit(moments[c][1] or 1.0)}" for c, e in expr.items()}
    cat_expr = {}
    modes = fit_modes(work, categorical) if categorical else {}
    for c in categorical:
        e = f"coalesce(`{c}`, {_text(modes.get(c, ''))})"
        kept = fit_frequent(fill(work, {c: modes[c]}), c, max_categories) if max_categories and c in modes else None
        if kept is not None:
            e = f"CASE WHEN {e} IN ({', '.join(_text(k) for k in kept)}) THEN {e} ELSE '{INFREQUENT}' END"
        cat_expr[c] = e
    return expr | cat_expr
