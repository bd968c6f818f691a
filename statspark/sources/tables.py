"""Tabular sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers are NULL everywhere behind the source."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """Scan a table, NaN as NULL in every format; CSV has a header line and should be given an explicit schema."""
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is None:
            reader = reader.option("inferSchema", True)
    if schema is not None:
        reader = reader.schema(schema)
    return nan_to_null(reader.options(**options).load(path))


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by=()) -> str:
    """Write a result table, replacing an earlier one; returns the path."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def write_charts(charts: Mapping[str, DataFrame], path: str) -> str:
    """Store chart tables side by side, partitioned by chart key."""
    out = None
    for key, df in charts.items():
        part = df.withColumn("chart", F.lit(key))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return write_result(out, path, partition_by=["chart"])


def read_chart(spark: SparkSession, path: str, key: str) -> DataFrame:
    """One stored chart table; the filter prunes partitions."""
    return spark.read.parquet(path).where(F.col("chart") == key)


def as_records(spark: SparkSession, data, schema=None) -> DataFrame:
    """Scoring input: a DataFrame is passed through, a dict or list of dicts becomes rows."""
    if isinstance(data, DataFrame):
        return data
    if isinstance(data, Mapping):
        data = [dict(data)]
    if isinstance(data, list) and data and all(isinstance(r, Mapping) for r in data):
        return spark.createDataFrame([dict(r) for r in data], schema)
    raise ValueError("expected a DataFrame, a dict or a list of dicts")
