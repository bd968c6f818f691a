"""Text-log source and sink with line numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_log_lines(spark: SparkSession, path: str, one_per_folder: bool = False) -> DataFrame:
    """``file, line_no, line`` of every text file under ``path``; line numbers start at 1.

    Files are read split by split, never whole: lines are numbered inside their
    split and the splits of a file are chained by their line counts. With
    ``one_per_folder`` the part files of a folder are one log, in the order of
    their names, and ``file`` is the folder: this reads back what
    ``write_log_lines`` wrote.
    """
    part = F.col("_metadata.file_path")
    raw = spark.read.text(path).select(
        (F.regexp_replace(part, "/[^/]*$", "") if one_per_folder else part).alias("file"),
        part.alias("_part"),
        F.col("_metadata.file_block_start").alias("_block"),
        # increases along one split, which is read by one task
        F.monotonically_increasing_id().alias("_at"),
        F.col("value").alias("line"),
    )
    keys = ["file", "_part", "_block"]
    blocks = raw.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    # part numbers of more than five digits make longer names
    chain = Window.partitionBy("file").orderBy(F.length("_part"), "_part", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*keys, F.coalesce(F.sum("_n").over(chain), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy("_at")
    return (
        raw.withColumn("_k", F.row_number().over(inside))
        .join(offsets, keys)
        .select("file", (F.col("_before") + F.col("_k")).alias("line_no"), "line")
    )


def write_log_lines(df: DataFrame, path: str, order: Sequence[str], line: str = "line") -> str:
    """Write one log in global order over many part files; ``read_log_lines(…, one_per_folder=True)`` numbers it through."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.col(line).alias("value")).write.mode("overwrite").text(path)
    return path
