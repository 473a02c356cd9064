"""Session settings for a cluster run; nothing else in the library sets any."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Partitions that fit in executor memory, runtime re-planning, skewed joins split.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.parquet.filterPushdown": "true",
}


def shuffle_partitions(input_bytes: int, target_bytes: int = 128 << 20, cores: int = 8) -> int:
    """Partitions for shuffles about as large as the input; AQE merges what turns out small."""
    return max(cores, -(-input_bytes // target_bytes))


def session(app: str = "ledgerloom", input_bytes: int | None = None, **more: str) -> SparkSession:
    b = SparkSession.builder.appName(app).config(map={**DEFAULTS, **more})
    if input_bytes:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    return b.getOrCreate()
