"""Global order at scale: mid-ranks, exact quantiles, percentile ranks.

A window ordered over a whole column sends every row to one task. Here a column
is cut into value ranges of about equal row counts; ties collapse to one row per
distinct value before the shuffle; order is then resolved inside a range, and
ranges are chained by a prefix sum over their totals (at most ``bucket_count``
rows per column). Split points only steer the layout: results do not depend on
them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statspark.session import bucket_count, scratch_dir

_INF = float("inf")


def _clean(c: str) -> Column:
    x = F.col(c).cast("double")
    # -0.0 and 0.0 are one value; NaN counts as missing
    return F.when(F.isnan(x), None).otherwise(x + F.lit(0.0))


def _own(df: DataFrame, c: str) -> Column:
    """The column in its own type where a double can't hold all its values, else as a clean double."""
    kind = dict(df.dtypes)[c]
    return F.col(c) if kind == "bigint" or kind.startswith("decimal") else _clean(c)


#: First level of a sketch: tasks are merged in so many groups, and only the groups' sketches meet.
SALTS = 256
#: Largest sketch; its ranks are off by about 1 in 20,000 of the rows.
MAX_SKETCH = 65_535


def sketched_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], size: int, by: Sequence[str] = ()) -> DataFrame:
    """Approximate quantiles per column (and group): ``by…``, then ``_s{i}``, ``_n{i}``, ``_lo{i}``, ``_hi{i}`` for column i.

    KLL sketches of ``size`` are merged in two levels, so no task gets a sketch of every other task. A column without
    values has a null ``_s{i}``. Sketches are drawn at random: use their quantiles to lay out work, not as results.
    """
    salt = F.pmod(F.spark_partition_id(), F.lit(SALTS))
    base = df.select(*by, salt.alias("_salt"), *[_clean(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    first, second, out = [], [], list(by)
    for i in range(len(cols)):
        first += [F.kll_sketch_agg_double(f"_v{i}", F.lit(min(size, MAX_SKETCH))).alias(f"_k{i}"), F.count(f"_v{i}").alias(f"_n{i}")]
        first += [F.min(f"_v{i}").alias(f"_lo{i}"), F.max(f"_v{i}").alias(f"_hi{i}")]
        second += [F.kll_merge_agg_double(f"_k{i}").alias(f"_k{i}"), F.sum(f"_n{i}").alias(f"_n{i}")]
        second += [F.min(f"_lo{i}").alias(f"_lo{i}"), F.max(f"_hi{i}").alias(f"_hi{i}")]
        marks = F.kll_sketch_get_quantile_double(f"_k{i}", F.array(*[F.lit(float(p)) for p in probs]))
        out += [F.when(F.col(f"_n{i}") > 0, marks).alias(f"_s{i}"), f"_n{i}", f"_lo{i}", f"_hi{i}"]
    parts = base.groupBy(*by, "_salt").agg(*first)
    return (parts.groupBy(*by).agg(*second) if by else parts.agg(*second)).select(*out)


def split_points(df: DataFrame, cols: Sequence[str], buckets: int) -> dict[str, list[float]]:
    """Approximate equal-count split points per column, from one scan."""
    probs = [i / buckets for i in range(1, buckets)]
    row = sketched_quantiles(df, cols, probs, max(200, 10 * buckets)).first() if cols else None
    # a column without values still needs one split point
    return {c: sorted({s for s in (row[f"_s{i}"] or []) if abs(s) < _INF}) or [0.0] for i, c in enumerate(cols)}


def _bucketed(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    tallies: Mapping[str, Column] | None = None,
    buckets: int | None = None,
    splits: Mapping[str, Sequence[float]] | None = None,
    own: bool = False,
) -> DataFrame:
    """Long form ``(by…, feature, bucket, value, n, tallies…)`` without missing values."""
    tallies = {"n": F.lit(1), **(tallies or {})}
    splits = splits or split_points(df, cols, buckets or bucket_count(df.sparkSession))
    base = df.select(
        *by,
        *[t.cast("long").alias(name) for name, t in tallies.items()],
        *[_clean(c).alias(f"_v{i}") for i, c in enumerate(cols)],
        *[_own(df, c).alias(f"_x{i}") for i, c in enumerate(cols) if own],
    )
    layout = Bucketizer(
        splitsArray=[[-_INF, *splits[c], _INF] for c in cols],
        inputCols=[f"_v{i}" for i in range(len(cols))],
        outputCols=[f"_b{i}" for i in range(len(cols))],
        handleInvalid="keep",
    )
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.col(f"_b{i}").cast("int").alias("bucket"),
                F.col(f"_x{i}" if own else f"_v{i}").alias("value"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return (
        layout.transform(base)
        .select(*by, *tallies, F.inline(cells))
        # stated for both, so that every reader of this stage has the same plan and Spark reuses it
        .where(F.col("value").isNotNull() & F.col("bucket").isNotNull())
    )


def _offsets(totals: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Sum over all lower ranges, plus the grand total, per (by, feature)."""
    whole = Window.partitionBy(*by, "feature")
    below = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by,
        "feature",
        "bucket",
        *[F.col(t).alias(f"_in_{t}") for t in names],
        *[F.coalesce(F.sum(t).over(below), F.lit(0)).alias(f"_off_{t}") for t in names],
        *[F.sum(t).over(whole).alias(f"total_{t}") for t in names],
    )


def _inside(counts: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    w = (
        Window.partitionBy(*by, "feature", "bucket")
        .orderBy("value")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return counts.withColumns(
        {f"below_{t}": F.coalesce(F.sum(t).over(w), F.lit(0)) for t in names}
    )


def ranked_values(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    tallies: Mapping[str, Column] | None = None,
    buckets: int | None = None,
    splits: Mapping[str, Sequence[float]] | None = None,
    own: bool = False,
) -> DataFrame:
    """One row per distinct value: counts, counts below it, totals and mid-rank.

    Values are doubles, in which whole numbers above 2**53 may tie; ``own`` keeps whole numbers and decimals as they
    are (all columns then need one such type).

    ``tallies`` adds named 0/1 (or weight) columns counted alongside ``n``, e.g.
    the members of one group. Output: ``by…, feature, bucket, value, n,
    below_n, total_n, midrank`` and the same three columns per tally.
    """
    names = ["n", *(tallies or {})]
    long = _bucketed(df, cols, by, tallies, buckets, splits, own)
    keys = [*by, "feature", "bucket"]
    counts = long.groupBy(*keys, "value").agg(*[F.sum(t).alias(t) for t in names])
    totals = counts.groupBy(*keys).agg(*[F.sum(t).alias(t) for t in names])
    joined = _inside(counts, by, names).join(_offsets(totals, by, names), keys)
    return joined.select(
        *keys,
        "value",
        *names,
        *[(F.col(f"below_{t}") + F.col(f"_off_{t}")).alias(f"below_{t}") for t in names],
        *[f"total_{t}" for t in names],
        (F.col("below_n") + F.col("_off_n") + (F.col("n") + 1) / 2).alias("midrank"),
    )


#: Size of the sketches behind brackets, and the slack around a quantile: over twice what their ranks are off, 1 in 1,400.
ACCURACY, SLACK = 8192, 0.0015
#: Equal-width pieces of a bracket; the order inside a piece is one window.
PIECES = 256


def _brackets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str], accuracy: int, slack: float) -> DataFrame:
    """One row per group: ``by…`` and, for column i, its count ``_n{i}`` and ``_m{i}``, the lower then the upper ends of the brackets."""
    ends = sorted({e for p in probs for e in (p - slack, p + slack) if 0 < e < 1}) or [0.5]
    sketches = sketched_quantiles(df, cols, ends, accuracy, by)
    out = list(by)
    for i in range(len(cols)):
        lowest, highest, marks = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_s{i}")
        # the sketch need not hold the extremes
        low = [highest if p >= 1 else marks[ends.index(p - slack)] if p - slack > 0 else lowest for p in probs]
        high = [lowest if p <= 0 else marks[ends.index(p + slack)] if p + slack < 1 else highest for p in probs]
        out += [f"_n{i}", F.when(F.col(f"_n{i}") > 0, F.array(*low, *high)).alias(f"_m{i}")]
    return sketches.select(*out)


def _settled(rows: DataFrame, bound: int | None = None) -> tuple[DataFrame, list | None]:
    """``rows`` computed once: in the driver up to FEW_GROUPS of them (also returned), in a stored table beyond.

    ``bound`` is the largest number of rows, where it is known.
    """
    spark = rows.sparkSession
    if bound is not None and bound <= FEW_GROUPS:
        found = rows.collect()
        return spark.createDataFrame(found, rows.schema), found
    kept = rows.persist()
    found = kept.limit(FEW_GROUPS + 1).collect()
    if len(found) <= FEW_GROUPS:
        out = spark.createDataFrame(found, rows.schema), found
    else:
        path = scratch_dir(spark, "quantiles")
        kept.write.parquet(path)
        out = spark.read.schema(rows.schema).parquet(path), None
    kept.unpersist()
    return out


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    pieces: int = PIECES,
    accuracy: int = ACCURACY,
    slack: float = SLACK,
) -> DataFrame:
    """Exact quantiles with linear interpolation: ``by…, feature, prob, quantile``.

    The built-in ``percentile`` gives the same numbers but keeps every distinct value of a group in one task. Here a
    sketch gives each group, column and quantile a bracket of values; the brackets are a table that meets the rows by
    group, so any number of groups takes the same way. A value's zone is the number of brackets below it and whether one
    holds it. Values between brackets collapse to one count per task, those above the last are dropped, and about 0.3 %
    of the rows a quantile stay; of these only the pieces of brackets that hold a wanted position are ordered. A
    position outside its bracket (a sketch is off by chance) is sought again with wider brackets, in its group alone.
    Rows with a null group are left out; a column without values has no row.
    """
    wanted = sorted({float(p) for p in probs})
    k = len(wanted)
    src = df
    for b in by:
        src = src.where(F.col(b).isNotNull())
    brackets, few = _settled(_brackets(src, cols, wanted, by, accuracy, slack), None if by else 1)

    values = src.select(*by, *[_clean(c).alias(f"_v{i}") for i, c in enumerate(cols)])
    side = brackets if few is None else F.broadcast(brackets)  # FEW_GROUPS rows
    met = values.join(side, list(by)) if by else values.crossJoin(side)  # without groups it is one row
    cells = [F.struct(F.lit(i).alias("_i"), F.col(f"_v{i}").alias("_x"), F.col(f"_m{i}").alias("_m")) for i in range(len(cols))]
    long = met.select(*by, F.inline(F.array(*cells))).where(F.col("_x").isNotNull() & F.col("_m").isNotNull())
    x, marks = F.col("_x"), F.col("_m")
    reached, passed = F.lit(0), F.lit(0)
    for j in range(k):
        reached = reached + (x >= marks[j]).cast("int")
        passed = passed + (x > marks[k + j]).cast("int")
    # both ends rise with the quantile: a value lies in a bracket if more of them begin than end below it
    long = long.withColumns({"_passed": passed, "_in": reached > passed}).where(F.col("_passed") < k)
    before = F.when(F.col("_passed") > 0, F.get(marks, k + F.col("_passed") - 1))
    low = F.greatest(F.get(marks, F.col("_passed")), before)
    width = F.get(marks, k + F.col("_passed")) - low
    piece = F.least(F.floor((x - low) / width * pieces), F.lit(pieces - 1))
    cell = [*by, "_i", "_zone", "_piece"]
    counts = (
        long.select(
            *by,
            "_i",
            (2 * F.col("_passed") + F.col("_in").cast("int")).alias("_zone"),
            F.when(F.col("_in") & (width > 0) & (width < _INF), piece).otherwise(0).cast("int").alias("_piece"),
            F.when(F.col("_in"), x).alias("_value"),
        )
        .groupBy(*cell, "_value")
        .agg(F.count(F.lit(1)).alias("_n"))
    )

    sizes = brackets.select(*by, F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_n{i}").alias("_total")) for i in range(len(cols))])))
    sizes = sizes.where(F.col("_total") > 0)
    places = []
    for j, p in enumerate(wanted):
        at = F.lit(p) * (F.col("_total") - 1)
        places.append(F.struct(F.lit(j).alias("_j"), at.alias("_at"), F.floor(at).alias("_lo"), F.ceil(at).alias("_hi")))
    sizes = sizes.withColumn("_places", F.array(*places))
    # at most ``pieces`` rows per bracket, and one per zone between brackets
    ahead = Window.partitionBy(*by, "_i").orderBy("_zone", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy(*cell).agg(F.sum("_n").alias("_size"))
    totals = totals.withColumn("_off", F.coalesce(F.sum("_size").over(ahead), F.lit(0))).where(F.col("_zone") % 2 == 1)
    start, stop = F.col("_off"), F.col("_off") + F.col("_size")
    here = F.filter("_places", lambda t: ((t["_lo"] >= start) & (t["_lo"] < stop)) | ((t["_hi"] >= start) & (t["_hi"] < stop)))
    hits = totals.join(sizes if few is None else F.broadcast(sizes), [*by, "_i"]).select(*cell, "_off", here.alias("_places")).where(F.size("_places") > 0)
    bound = None if few is None else len(few) * len(cols) * k
    if bound is not None and bound <= FEW_GROUPS:
        hits = F.broadcast(hits)  # at most two pieces per group, column and quantile
    upto = F.sum("_n").over(Window.partitionBy(*cell).orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    inside = counts.where(F.col("_value").isNotNull()).join(hits, cell).withColumn("_upto", upto + F.col("_off"))
    inside = inside.select(*by, "_i", "_value", "_n", "_upto", F.inline("_places"))

    def pick(place: str) -> Column:
        return F.max(F.when((F.col(place) < F.col("_upto")) & (F.col(place) >= F.col("_upto") - F.col("_n")), F.col("_value")))

    picked = inside.groupBy(*by, "_i", "_j").agg(pick("_lo").alias("_a"), pick("_hi").alias("_b"))
    every = sizes.select(*by, "_i", F.inline("_places")).join(picked, [*by, "_i", "_j"], "left")
    a, b = F.col("_a"), F.col("_b")
    value = F.when(a == b, a).otherwise(a + (b - a) * (F.col("_at") - F.col("_lo")))
    feature = F.array(*[F.lit(c) for c in cols])[F.col("_i")]
    prob = F.array(*[F.lit(p) for p in wanted])[F.col("_j")]
    every = every.select(*by, feature.alias("feature"), prob.alias("prob"), value.alias("quantile"), (a.isNull() | b.isNull()).alias("_lost"))
    found, rows = _settled(every, bound)
    out = found.drop("_lost")
    if rows is not None and not any(r["_lost"] for r in rows):
        return out
    lost = found.where("_lost").select(*by).distinct()
    if not lost.limit(1).collect():
        return out
    again = exact_quantiles(src.join(lost, list(by), "left_semi") if by else src, cols, wanted, by, pieces, accuracy, 10 * slack)
    return out.join(lost, list(by), "left_anti").unionByName(again) if by else again


def quantile_map(df: DataFrame, cols: Sequence[str], prob: float) -> dict[str, float]:
    """One exact quantile per column as driver values (one number per column)."""
    found = {r["feature"]: r["quantile"] for r in exact_quantiles(df, cols, [prob]).collect()}
    return {c: found.get(c) for c in cols}


def wide_quantiles(
    df: DataFrame, cols: Sequence[str], probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """``by…, feature`` with one column per named quantile."""
    long = exact_quantiles(df, cols, list(probs.values()), by)
    return long.groupBy(*by, "feature").agg(
        *[F.max(F.when(F.col("prob") == F.lit(float(p)), F.col("quantile"))).alias(n) for n, p in probs.items()]
    )


def lookups_skewed(df: DataFrame, lookups: Mapping[str, tuple[Column, DataFrame, Column]]) -> DataFrame:
    """Left lookups ``name -> (key, table(_key, name, …), frequent)`` that no hot key can unbalance.

    ``frequent`` marks table rows whose key holds more than a fixed share of the
    data; a share above 1/k can hold for at most k keys, so that side is
    broadcast. Rows that need nothing else are never shuffled. Every other row
    has a rare key, so its copies are few as well, and it meets the rare keys in
    shuffle joins; where it has no rare key itself, its hash spreads it.
    """
    names, seen, waits = list(lookups), df, {}
    for i, (name, (key, table, frequent)) in enumerate(lookups.items()):
        hot = table.where(frequent).select(F.col("_key").alias(f"_h{i}"), F.col(name).alias(f"_hot{i}"))
        seen = seen.withColumn(f"_k{i}", key).join(F.broadcast(hot), F.col(f"_k{i}") == F.col(f"_h{i}"), "left")
        waits[name] = F.col(f"_k{i}").isNotNull() & F.col(f"_h{i}").isNull()
    any_waits = F.lit(False)
    for w in waits.values():
        any_waits = any_waits | w
    done = seen.where(~any_waits).withColumns({name: F.col(f"_hot{i}") for i, name in enumerate(names)})
    rest = seen.where(any_waits)
    for i, (name, (_, table, frequent)) in enumerate(lookups.items()):
        cold = table.where(~frequent).select(F.col("_key").alias("_cold"), name, F.lit(0).cast("long").alias("_salt"))
        rest = (
            rest.withColumns(
                {
                    "_cold": F.when(waits[name], F.col(f"_k{i}")),
                    "_salt": F.when(waits[name], F.lit(0).cast("long")).otherwise(F.xxhash64(*df.columns)),
                }
            )
            .join(cold, ["_cold", "_salt"], "left")
            .withColumn(name, F.coalesce(f"_hot{i}", name))
            .drop("_cold", "_salt")
        )
    out = [*df.columns, *names]
    return done.select(*out).unionByName(rest.select(*out))


def lookup_skewed(df: DataFrame, key: Column, table: DataFrame, name: str, frequent: Column) -> DataFrame:
    """One lookup by ``lookups_skewed``."""
    return lookups_skewed(df, {name: (key, table, frequent)})


#: Groups whose summary rows are broadcast; beyond, both sides are shuffled and AQE splits a hot group.
FEW_GROUPS = 10_000


def join_groups(df: DataFrame, summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring one summary row per group to its rows, without moving the rows while groups are few."""
    rows = summary.limit(FEW_GROUPS + 1).collect()
    if len(rows) <= FEW_GROUPS:
        summary = F.broadcast(df.sparkSession.createDataFrame(rows, summary.schema))
    return df.join(summary, list(by))


def with_midranks(df: DataFrame, cols: Mapping[str, str], buckets: int | None = None) -> DataFrame:
    """Add the mid-rank of each column ``source -> new name``; missing stays missing."""
    limit = buckets or bucket_count(df.sparkSession)
    splits = split_points(df, list(cols), limit)
    frequent = F.col("n") * limit > F.col("total_n")
    lookups = {}
    for source, name in cols.items():
        mine = ranked_values(df, [source], splits=splits, own=True).select(
            F.col("value").alias("_key"), F.col("midrank").alias(name), "n", "total_n"
        )
        lookups[name] = (_own(df, source), mine, frequent)
    return lookups_skewed(df, lookups)


def with_percent_ranks(df: DataFrame, col: str, name: str = "pct_rank") -> DataFrame:
    """Mid-rank divided by the number of non-missing rows (not SQL's percent_rank)."""
    n = df.agg(F.count(_clean(col)).alias("_n"))
    ranked = with_midranks(df, {col: name}).crossJoin(F.broadcast(n))
    return ranked.withColumn(name, F.col(name) / F.nullif(F.col("_n"), F.lit(0))).drop("_n")


def cumulative(df: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """Running sum over a summary table (one row per component or level)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(value).over(w))
