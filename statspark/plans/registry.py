"""Named queries over the test tables, each with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statspark.sources.tables import read_table


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def add(fn):
            self.queries[name] = fn
            if sql:
                self.sql[name] = sql
            return fn

        return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, f"{folder}/{name}.parquet")


def r(col: str | Column, digits: int = 6) -> Column:
    """Rounded double under its own name (for a column name) or unnamed (for an expression)."""
    if isinstance(col, str):
        return F.round(F.col(col).cast("double"), digits).alias(col)
    return F.round(col.cast("double"), digits)


def report(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round every double column (``special`` sets other digits) and widen counts to bigint."""
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(r(name, special.get(name, digits)))
        elif kind in ("int", "smallint", "tinyint"):
            out.append(F.col(name).cast("long").alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)
