"""What the text operators share: batches, shared storage, hashing of keys, word splitting."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statspark.session import scratch_dir

#: ASCII white space, the separators of words: space, tab, newline, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Rows in one Arrow batch; texts can be long, so batches are kept short.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at a time: long texts make default batches too large."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write once to the folder all executors share and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(doc_id: Column | str, folds: int = 5) -> Column:
    """Fold of a row: CRC-32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def share_hash(*cols: Column, seed: int = 0) -> Column:
    """A number in [0, 1) per row that depends on its key and a seed only, not on layout or retries."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def words_native(text: Column) -> Column:
    """Array of the words of a text (runs without ASCII white space); null and empty texts have none."""
    flat = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(flat, " "), "")


def spans_by_size(sizes: Sequence[int], limit: int) -> Iterator[tuple[int, int]]:
    """Cut a list into runs of about ``limit`` in total; an item over the limit is a run of its own."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def quota_sample(df: DataFrame, label: str, key: str, quota: int, seed: int) -> DataFrame:
    """About ``quota`` rows of each label by key hash, with no sort and no window over a label's rows.

    The only bounded sample in this package: it feeds classifiers, never results.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().orderBy(F.desc("count")).limit(1000).collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (share_hash(F.col(key), seed=seed) < min(1.0, quota / n)))
    return df.where(keep)
