"""Numbered full dumps of a cell table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellshift.functions.text import parse_path
from cellshift.model import (
    CELL_COLUMNS,
    CELL_KEYS,
    CELL_SCHEMA,
    PATH_HASH,
    cell_path,
    with_cell,
)


# A bucket is sorted by one task, so a larger snapshot gets more buckets.
CELLS_PER_BUCKET = 500_000


def store_snapshot(cells: DataFrame, base: str, number: int) -> None:
    """Write snapshot `number` under `base`; an earlier one of that number is replaced."""
    cells.select(*CELL_COLUMNS).write.mode("overwrite").parquet(f"{base}/snapshot={number}")


def load_snapshot(spark: SparkSession, base: str, number: int) -> DataFrame | None:
    """The cells of snapshot `number`, or None when it was never stored."""
    try:
        return spark.read.schema(CELL_SCHEMA).parquet(f"{base}/snapshot={number}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _buckets_stored(spark: SparkSession, table: str) -> int | None:
    if not spark.catalog.tableExists(table):
        return None
    found = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Num Buckets'").first()
    return None if found is None else int(found.data_type)


def store_snapshot_table(cells: DataFrame, table: str, number: int, buckets: int) -> None:
    """As `store_snapshot`, into table `<table>_<number>`, bucketed on the join keys.

    The shuffle happens once per snapshot, here. A differential of two such tables
    with the same number of buckets joins bucket by bucket without a shuffle. The
    keys cover the whole path, so the cells of one long row spread over all buckets.
    They are stored beside the path's columns.

    There are `buckets` buckets, doubled until none is expected to hold more than
    CELLS_PER_BUCKET cells, which takes a count of the cells. A snapshot takes the number of the
    one before it as long as that is within four times its own, so that both match; if not,
    comparing them shuffles one of them.
    """
    spark = cells.sparkSession
    n = cells.count()
    while n > buckets * CELLS_PER_BUCKET:
        buckets *= 2
    before = _buckets_stored(spark, f"{table}_{number - 1}") if number > 0 else None
    if before is not None and buckets <= 4 * before and before <= 4 * buckets:
        buckets = before
    keyed = with_cell(cells.select(*CELL_COLUMNS))
    (
        keyed.select(*cell_path(), "value", "ts", PATH_HASH, "cell")
        .repartition(buckets, *CELL_KEYS)
        .write.mode("overwrite")
        .bucketBy(buckets, *CELL_KEYS)
        .sortBy(*CELL_KEYS)
        .saveAsTable(f"{table}_{number}")
    )


def load_snapshot_table(spark: SparkSession, table: str, number: int) -> DataFrame | None:
    name = f"{table}_{number}"
    return spark.table(name) if spark.catalog.tableExists(name) else None


def parse_snapshot(lines: DataFrame) -> DataFrame:
    """Cells of `ks/cf/key/super/col<TAB>ts/value` lines (column `value`).

    The line is split once, at the first tab, so that values keep their blanks; a
    row key may hold `/`. A time that is no number is read as null.
    """
    parts = F.split("value", "\t", 2)
    stamped = F.split(F.get(parts, F.lit(1)), "/", 2)
    return lines.select(
        *parse_path(F.get(parts, F.lit(0))),
        F.get(stamped, F.lit(1)).alias("value"),
        F.get(stamped, F.lit(0)).try_cast("bigint").alias("ts"),
    )


def read_snapshot_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_snapshot(spark.read.text(path))
