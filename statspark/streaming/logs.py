"""Running action counts and balances over a growing folder of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from statspark.operators.actionlog import parse_events


def stream_lines(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Lines of text files as they arrive. No line order is known across a stream."""
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.col("value").alias("line"))


def player_totals(lines: DataFrame) -> DataFrame:
    """Events, actions, faults and balance per player; works on a batch or a stream.

    State is one row per player, and order does not matter to any of the sums.
    """
    ev = parse_events(lines).where(F.col("player").isNotNull())
    fault = F.col("kind").isin("illegal", "misformatted", "timeout", "disconnect")
    return ev.groupBy("player").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count("code").alias("n_actions"),
        F.sum(fault.cast("long")).alias("n_faults"),
        F.sum(F.when(F.col("kind") == "awarded", F.col("amount").cast("long")).otherwise(0)).alias("balance"),
    )


def run_totals(totals: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Process everything available; each batch of updated players is appended with its batch number.

    A batch writes to a folder of its own and replaces it when retried, so a
    restart after a lost executor or driver does not double any row.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return (
        totals.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_totals(spark: SparkSession, out_path: str) -> DataFrame:
    """The newest row per player among the saved updates."""
    rows = spark.read.parquet(out_path)
    cols = [c for c in rows.columns if c not in ("player", "batch")]
    return rows.groupBy("player").agg(F.max_by(F.struct(*cols), "batch").alias("v")).select("player", "v.*")
