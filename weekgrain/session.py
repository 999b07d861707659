"""Session settings the jobs are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution picks broadcast joins from measured sizes, splits skewed join partitions and
# merges small ones, so none of the operators carries a size hint of its own. Shuffle partitions
# should start high on a cluster (two to four per core); coalescing brings them down.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g", app: str = "weekgrain", **extra) -> SparkSession:
    """A local session with the settings above."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app).config("spark.sql.shuffle.partitions", str(partitions))
    b = b.config("spark.driver.memory", memory).config("spark.ui.enabled", "false")
    for k, v in {**SETTINGS, **extra}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
