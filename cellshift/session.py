"""Session settings the plans in this package rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # Hot row keys: oversized join partitions are split at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # No side is broadcast on an estimate: a small file may hold very many cells. After
    # a shuffle its size is measured, and up to this it is.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10MB",
    # Rewriting snapshot or cycle N leaves every other partition alone.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def engine_session(builder: SparkSession.Builder | None = None) -> SparkSession:
    """A session with SETTINGS; pass a builder to add master, memory and so on."""
    builder = builder or SparkSession.builder
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for state that must outlive an executor.

    The cluster names it in `spark.checkpoint.dir`; a session without one uses its
    warehouse, the other place that driver and executors share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
