"""Seeded sampling and splitting by row key.

The random number of a row is a hash of its key and the seed, so the result
does not depend on partitioning, order or retries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_hash(keys: Sequence[str], seed: int) -> Column:
    return F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))


def key_bucket(keys: Sequence[str], seed: int, modulus: int = 100) -> Column:
    """Uniform integer in [0, modulus) from the leading 32 bits of the key hash."""
    return F.conv(F.substring(key_hash(keys, seed), 1, 8), 16, 10).cast("long") % modulus


def fixed_sample(df: DataFrame, keys: Sequence[str], n: int = 5000, seed: int = 42) -> DataFrame:
    """``n`` rows at random (all rows if fewer): a per-task top-n, not a full sort."""
    return df.orderBy(key_hash(keys, seed), *keys).limit(n)


def train_test_split(
    df: DataFrame, keys: Sequence[str], test_share: float = 0.2, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Disjoint train and test rows; every row lands on the same side on every run."""
    resolution = 10_000
    is_test = key_bucket(keys, seed, resolution) < round(test_share * resolution)
    return df.where(~is_test), df.where(is_test)


def stratified_flags(
    df: DataFrame, keys: Sequence[str], stratum: str, test_share: float = 0.2, seed: int = 42, name: str = "is_test"
) -> DataFrame:
    """Flag an exact share of each stratum as test rows.

    Rows are ordered by hash inside (stratum, leading hash digits), so a hot
    stratum is spread over 65,536 windows; quotas chain across them.
    """
    h = key_hash(keys, seed)
    rows = df.withColumns({"_h": h, "_c": F.substring(h, 1, 4)})
    cells = rows.groupBy(stratum, "_c").agg(F.count(F.lit(1)).alias("_n"))
    chain = Window.partitionBy(stratum).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(
        F.col(stratum).alias("_s"),
        F.col("_c").alias("_cc"),
        F.coalesce(F.sum("_n").over(chain), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(stratum)).alias("_total"),
    )
    inside = Window.partitionBy(stratum, "_c").orderBy("_h", *keys)
    numbered = rows.withColumn("_k", F.row_number().over(inside))
    joined = numbered.join(
        offsets, numbered[stratum].eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_cc"))
    )
    quota = F.round(F.col("_total") * test_share)
    return joined.withColumn(name, F.col("_before") + F.col("_k") <= quota).drop(
        "_h", "_c", "_cc", "_s", "_k", "_before", "_total"
    )


def stratified_bounds(df: DataFrame, keys: Sequence[str], stratum: str, test_share: float = 0.2, seed: int = 42) -> DataFrame:
    """Per stratum the key hash ``_last`` of the last test row of ``stratified_flags``, and how many rows of it are test.

    ``_take`` is null where all rows of that hash are. Only the rows of one cell per stratum are put in order.
    """
    rows = df.select(stratum, key_hash(keys, seed).alias("_h")).withColumn("_c", F.substring("_h", 1, 4))
    cells = rows.groupBy(stratum, "_c").agg(F.count(F.lit(1)).alias("_n"))
    chain = Window.partitionBy(stratum).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        cells.select(
            F.col(stratum).alias("_s"),
            F.col("_c").alias("_cc"),
            "_n",
            F.coalesce(F.sum("_n").over(chain), F.lit(0)).alias("_before"),
            F.round(F.sum("_n").over(Window.partitionBy(stratum)) * test_share).alias("_quota"),
        )
        .where("_before < _quota AND _quota <= _before + _n")
        .select("_s", "_cc", (F.col("_quota") - F.col("_before")).alias("_wanted"))
    )
    inside = rows.join(edges, rows[stratum].eqNullSafe(F.col("_s")) & (F.col("_c") == F.col("_cc")))
    same = inside.groupBy("_s", "_h").agg(F.count(F.lit(1)).alias("_n"), F.first("_wanted").alias("_wanted"))
    upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_h"))
    last = same.withColumn("_upto", upto).where("_upto - _n < _wanted AND _wanted <= _upto")
    take = F.when(F.col("_wanted") < F.col("_upto"), F.col("_wanted") - F.col("_upto") + F.col("_n"))
    return last.select("_s", F.col("_h").alias("_last"), take.cast("long").alias("_take"))


#: Strata whose bounds are sent to every task.
FEW_STRATA = 10_000


def flags_by_bounds(df: DataFrame, keys: Sequence[str], stratum: str, bounds: DataFrame, seed: int = 42, name: str = "is_test") -> DataFrame:
    """The flags of ``stratified_flags``, found by comparing key hashes, so that rows stay where they are."""
    found = bounds.limit(FEW_STRATA + 1).collect()
    if len(found) <= FEW_STRATA:
        bounds = F.broadcast(df.sparkSession.createDataFrame(found, bounds.schema))
    rows = df.withColumn("_h", key_hash(keys, seed)).join(bounds, df[stratum].eqNullSafe(F.col("_s")), "left")
    hidden = ("_h", "_s", "_last", "_take")
    if not any(r["_take"] is not None for r in found) and len(found) <= FEW_STRATA:
        return rows.withColumn(name, F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False))).drop(*hidden)
    # a key that occurs more than once lies on the border: its rows are numbered
    border = F.coalesce((F.col("_h") == F.col("_last")) & F.col("_take").isNotNull(), F.lit(False))
    plain = rows.where(~border).withColumn(name, F.coalesce(F.col("_h") <= F.col("_last"), F.lit(False)))
    number = F.row_number().over(Window.partitionBy(stratum).orderBy(F.xxhash64(*df.columns), *keys))
    few = rows.where(border).withColumn(name, number <= F.col("_take"))
    return plain.drop(*hidden).unionByName(few.drop(*hidden))
