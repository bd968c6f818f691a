"""Session-level settings shared by the operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared folder (``spark.checkpoint.dir``).

    Only where the setting is absent and the master is local, as in tests, a local folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="statspark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cores(spark: SparkSession) -> int:
    """Tasks that the cluster runs at a time; 0 where that is unknown."""
    try:
        return spark.sparkContext.defaultParallelism
    except Exception:  # Spark Connect has no SparkContext
        return 0


def bucket_count(spark: SparkSession) -> int:
    """Number of value ranges used for global order: follows the cluster's parallelism."""
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(10_000, max(shuffle, 4 * cores(spark))))
