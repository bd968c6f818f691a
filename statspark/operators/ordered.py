"""Order-dependent columns per group that stay parallel inside a hot group.

Rows are placed in consecutive segments of their group; a window works inside
one segment and a small per-segment summary is chained across segments. A group
holding a third of all rows is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statspark.operators.rank import _INF, split_points
from statspark.session import bucket_count

SEGMENT = "_segment"


#: Bytes of a text key that one number holds exactly.
TEXT_BYTES = 6
#: Whole numbers up to here are exact as doubles.
EXACT = 2.0**53


def _as_number(df: DataFrame, c: str) -> Column:
    """Number of a numeric or time column that never falls as the key rises; several keys may share one."""
    kind = dict(df.dtypes)[c]
    if kind == "timestamp":
        return F.unix_micros(c).cast("double")
    if kind == "timestamp_ntz":  # no zone: use its own calendar fields
        day = F.unix_date(F.col(c).cast("date")).cast("double")
        return day * 86400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.date_part(F.lit("SECOND"), F.col(c)).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    return F.col(c).cast("double")


def _remainder(df: DataFrame, c: str) -> tuple[Column, float] | None:
    """What a double leaves out of a wide whole or decimal key, and the double from which on it does; None for other types."""
    kind = dict(df.dtypes)[c]
    if kind not in ("bigint", "timestamp") and not kind.startswith("decimal"):
        return None
    scale = int(kind[:-1].split(",")[1]) if kind.startswith("decimal") else 0
    own = (F.unix_micros(c) if kind == "timestamp" else F.col(c)).cast(f"decimal(38,{scale})")
    return F.try_subtract(own, own.cast("double").try_cast(f"decimal(38,{scale})")).cast("double"), EXACT / 10**scale


def _is_text(df: DataFrame, c: str) -> bool:
    kind = dict(df.dtypes)[c]
    return kind in ("string", "binary") or kind.startswith(("char", "varchar"))


def _text_numbers(df: DataFrame, c: str) -> list[Column]:
    """Numbers of the bytes of a text key that follow what all keys begin with; they rise with the key."""
    ends = df.agg(F.min(c).cast("binary").alias("low"), F.max(c).cast("binary").alias("high")).first()
    low, high = bytes(ends["low"] or b""), bytes(ends["high"] or b"")
    same = next((i for i, (x, y) in enumerate(zip(low, high)) if x != y), min(len(low), len(high)))
    pieces = [F.substring(F.col(c).cast("binary"), same + 1 + i * TEXT_BYTES, TEXT_BYTES) for i in range(2)]
    return [F.conv(F.rpad(F.hex(x), 2 * TEXT_BYTES, "0"), 16, 10).cast("double") for x in pieces]


def with_segments(
    df: DataFrame, order: Sequence[str], buckets: int | None = None
) -> DataFrame:
    """Tag rows with consecutive ranges of ``order[0]``, refined by ``order[1]`` on hot ties.

    A first key so frequent that it is a split point gets a range of its own, which the second key then divides. Ranges
    are cut between doubles; keys that share a hot double (whole numbers above 2**53, long decimals) are divided by
    what it leaves out before the second key divides them. A text key is cut by the twelve bytes that follow the
    common beginning of all keys; rows equal in these stay in one range, whatever their number. Rows inside a range
    are ordered by the keys themselves, so ranges only steer the layout.
    """
    buckets = buckets or bucket_count(df.sparkSession)
    first = order[0]
    if _is_text(df, first):
        levels = _text_numbers(df, first)
    else:
        levels = [_as_number(df, first)]
        if len(order) > 1:
            levels += [_text_numbers(df, order[1])[0] if _is_text(df, order[1]) else _as_number(df, order[1])]
    base = df.withColumns({f"_o{i}": level for i, level in enumerate(levels)})
    names = [f"_o{i}" for i in range(len(levels))]
    splits = split_points(base, names, buckets)
    rest = None if _is_text(df, first) else _remainder(df, first)
    if rest and len(names) > 1 and any(abs(s) >= rest[1] for s in splits["_o0"]):
        base = base.withColumn("_rest", rest[0])
        splits |= split_points(base, ["_rest"], buckets)
        names.insert(1, "_rest")
    stage = Bucketizer(
        splitsArray=[[-_INF, *splits[k], _INF] for k in names],
        inputCols=names,
        outputCols=[k + "b" for k in names],
        handleInvalid="keep",
    )
    # a level counts only for rows that equal a split point on all levels before it
    parts, exact = [], F.lit(True)
    for k in names:
        place = F.when(exact, F.col(k + "b").cast("int")).otherwise(0)
        start = F.element_at(F.array(*[F.lit(s) for s in splits[k]]), F.greatest(place, F.lit(1)))
        exact = exact & (place >= 1) & (F.col(k) == start)
        parts += [place, F.when(exact, 0).otherwise(1)]
    segment = F.struct(*[part.alias(f"p{i}") for i, part in enumerate(parts)])
    return stage.transform(base).withColumn(SEGMENT, segment).drop(*names, *[k + "b" for k in names])


def chunked(df: DataFrame, position: str, size: int = 100_000) -> DataFrame:
    """Segments of ``size`` consecutive positions, for a dense 1-based position column."""
    return df.withColumn(SEGMENT, F.floor((F.col(position) - 1) / size))


def _chain(df: DataFrame, by: Sequence[str], summaries: dict[str, Column], carried: dict[str, Column]):
    """Per (by, segment) summary, then a value carried in from all earlier segments."""
    totals = df.groupBy(*by, SEGMENT).agg(*[c.alias(n) for n, c in summaries.items()])
    w = Window.partitionBy(*by).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*by, SEGMENT, *[c.over(w).alias(n) for n, c in carried.items()])


def _with_carry(rows: DataFrame, carry: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bring the carried value to its segment; a missing group key is a group like any other."""
    keys = [*by, SEGMENT]
    right = carry.withColumnsRenamed({k: f"_r{i}" for i, k in enumerate(keys)})
    match = [rows[k].eqNullSafe(right[f"_r{i}"]) for i, k in enumerate(keys)]
    return rows.join(right, match, "left").drop(*[f"_r{i}" for i in range(len(keys))])


def running_sum(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """Running total of ``value`` per group, current row included."""
    rows = df if SEGMENT in df.columns else with_segments(df, order)
    carry = _chain(rows, by, {"_t": F.sum(value)}, {"_before": F.sum("_t")})
    w = Window.partitionBy(*by, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        _with_carry(rows.withColumn(name, F.sum(value).over(w)), carry, by)
        .withColumn(name, F.coalesce(F.col("_before"), F.lit(0)) + F.col(name))
        .drop("_before", SEGMENT)
    )


def carry_forward(df: DataFrame, by: Sequence[str], order: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """Last non-missing value at or before each row of its group, for several ``column -> new name`` at once."""
    rows = df if SEGMENT in df.columns else with_segments(df, order)
    at = F.struct(*order)
    carry = _chain(
        rows,
        by,
        {f"_t_{c}": F.max_by(c, F.when(F.col(c).isNotNull(), at)) for c in names},
        {f"_before_{c}": F.last(f"_t_{c}", ignorenulls=True) for c in names},
    )
    w = Window.partitionBy(*by, SEGMENT).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumns({n: F.last(c, ignorenulls=True).over(w) for c, n in names.items()})
    return (
        _with_carry(seen, carry, by)
        .withColumns({n: F.coalesce(F.col(n), F.col(f"_before_{c}")) for c, n in names.items()})
        .drop(*[f"_before_{c}" for c in names], SEGMENT)
    )


def previous(
    df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str
) -> DataFrame:
    """``value`` of the row just before, within the group; missing on its first row."""
    rows = df if SEGMENT in df.columns else with_segments(df, order)
    at = F.struct(*order)
    carry = _chain(
        rows, by, {"_t": F.max_by(F.struct(value), at)}, {"_before": F.last("_t")}
    )
    inner = Window.partitionBy(*by, SEGMENT).orderBy(*order)
    lagged = rows.withColumns(
        {name: F.lag(value).over(inner), "_first": F.row_number().over(inner) == 1}
    )
    return (
        _with_carry(lagged, carry, by)
        .withColumn(name, F.when(F.col("_first"), F.col("_before")[value]).otherwise(F.col(name)))
        .drop("_before", "_first", SEGMENT)
    )


def byte_budget(
    df: DataFrame, by: Sequence[str], order: Sequence[str], text: str, limit: int
) -> DataFrame:
    """Keep chunks while the bytes already written are below ``limit``; the last one stays whole."""
    sized = df.withColumn("_bytes", F.octet_length(text).cast("long"))
    total = running_sum(sized, by, order, "_bytes", "_written")
    return total.where(F.col("_written") - F.col("_bytes") < limit).drop("_bytes", "_written")
