"""Session settings the operators are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Skewed lookups are split at run time; exchanges are sized and joins chosen from real sizes.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Plans here have many expressions; recording the call site of each one doubles the time it
    # takes to build them.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(
    cores: int = 8, partitions: int | None = None, memory: str = "8g", **extra: str
) -> SparkSession:
    """A session for tests and benches on one machine; on a cluster use the given session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cohortloom")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cores))
    )
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
