"""Tables of cells and of pending changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cellshift.model import CELL_SCHEMA, TRACKING_COLUMNS, TRACKING_SCHEMA


def create_cell_table(
    spark: SparkSession,
    keyspace: str,
    *tables: str,
    drop_keyspace: bool = False,
) -> None:
    """Create empty cell tables in a database, replacing those of the same name.

    Standard and super families share one schema: `super_column` is null in the
    former. `drop_keyspace` first drops the database with all its tables.
    """
    if drop_keyspace:
        spark.sql(f"DROP DATABASE IF EXISTS `{keyspace}` CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{keyspace}`")
    for table in tables:
        empty = spark.createDataFrame([], CELL_SCHEMA)
        empty.write.mode("overwrite").saveAsTable(f"`{keyspace}`.`{table}`")


def create_tracking(spark: SparkSession, path: str) -> None:
    """An empty tracking table, in place of whatever was there."""
    write_tracking(spark.createDataFrame([], TRACKING_SCHEMA), path)


def write_tracking(tracking: DataFrame, path: str) -> None:
    """Write one version of a tracking table, a partition per state.

    Extraction reads the pending states only, so the large `up_old` section is
    pruned. Write each version to a path of its own: maintenance reads the one
    before.
    """
    (
        tracking.select(*TRACKING_COLUMNS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "static")
        .partitionBy("keyspace", "column_family", "state")
        .parquet(path)
    )


def load_tracking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACKING_SCHEMA).parquet(path).select(*TRACKING_COLUMNS)
