"""Snapshots as a chain: one full dump and what changed since.

    <path>/full/number=N     all cells of snapshot N
    <path>/delta/number=N    cells written since the snapshot before, and paths taken away
    <path>/links             (number, is_full, cells, saved_at), a row for each dump and delta

A link is written when its data are, so a link that is there can be read; a number that
is stored again gets new data first and the last link counts. Snapshot N is the last dump up
to N with the deltas after it laid over it, the last writer of a path counting.
`compact` writes a dump from a chain, which later snapshots start from.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellshift.functions.cycles import new_cycle
from cellshift.model import CELL_COLUMNS, CELL_KEYS, CELL_SCHEMA, DEL, PATH, cell_path, with_cell
from cellshift.operators.grouping import RANK, newest

# Paths of deltas are broadcast only if the links count no more than this.
BROADCAST_CELLS = 500_000
_LINKS = "number int, is_full boolean, cells bigint, saved_at bigint"
_DELTA = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in CELL_SCHEMA), "gone boolean", "number int"])


def _store(df: DataFrame, path: str, number: int, is_full: bool) -> None:
    """Write the data, then the link with what was written."""
    spark = df.sparkSession
    folder = f"{path}/{'full' if is_full else 'delta'}/number={number}"
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
    cells = spark.read.schema(df.schema).parquet(folder).count()
    link = spark.createDataFrame([(number, is_full, cells, new_cycle())], _LINKS)
    link.coalesce(1).write.mode("append").parquet(f"{path}/links")


def store_full(cells: DataFrame, path: str, number: int) -> None:
    """Snapshot `number` as a full dump; the chain of later snapshots starts here."""
    _store(cells.select(*CELL_COLUMNS), path, number, True)


def store_delta(upserts: DataFrame, path: str, number: int, deletions: DataFrame | None = None) -> None:
    """Snapshot `number` as what changed since the one before.

    upserts: cells, such as those a scan finds; of a repeated path the last one counts.
    deletions: paths that are gone (a scan sees none); a path in both is there. Only the
    changes are shuffled and written.
    """
    rows = upserts.select(*CELL_COLUMNS, F.lit(False).alias("gone"))
    if deletions is not None:
        nothing = [F.lit(None).cast("string").alias("value"), F.lit(None).cast("bigint").alias("ts")]
        rows = rows.unionByName(deletions.select(*PATH, *nothing, F.lit(True).alias("gone")))
    _store_rows(rows, path, number)


def store_changes(changes: DataFrame, path: str, number: int) -> None:
    """As `store_delta`, from change records such as those of a differential, in one pass over them."""
    gone = F.col("op") == DEL
    columns = [F.when(~gone, F.col(c)).alias(c) if c in ("value", "ts") else c for c in CELL_COLUMNS]
    _store_rows(changes.select(*columns, gone.alias("gone")), path, number)


def _store_rows(rows: DataFrame, path: str, number: int) -> None:
    there = rows.withColumn("there", ~F.col("gone"))
    _store(newest(there, PATH, ["there", "ts", "value"]).drop(RANK, "there"), path, number, False)


def _links(spark: SparkSession, path: str, number: int) -> list[tuple[int, int]] | None:
    """(number, cells) of the dump and of the deltas that make up snapshot `number`."""
    try:
        links = spark.read.schema(_LINKS).parquet(f"{path}/links").where(F.col("number") <= number)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    # One row for each snapshot since the last dump.
    last = links.groupBy("number").agg(F.max_by(F.struct("is_full", "cells"), "saved_at").alias("link"))
    parts: list[tuple[int, int]] = []
    for found, (is_full, cells) in last.orderBy(F.desc("number")).toLocalIterator():
        parts.insert(0, (found, cells))
        if is_full:
            return parts if parts[-1][0] == number else None
    return None


def chain(spark: SparkSession, path: str, number: int) -> list[int] | None:
    """The numbers of the dump and the deltas that make up snapshot `number`; None if it cannot be built."""
    parts = _links(spark, path, number)
    return None if parts is None else [n for n, _ in parts]


def load_chained(spark: SparkSession, path: str, number: int) -> DataFrame | None:
    """The cells of snapshot `number`, or None when it was not stored.

    The deltas are collapsed first, and the dump meets their paths in an anti join: without a
    shuffle of the dump if the deltas are few cells, by the count that the links keep.
    """
    parts = _links(spark, path, number)
    if parts is None:
        return None
    full = spark.read.schema(CELL_SCHEMA).parquet(f"{path}/full/number={parts[0][0]}")
    if len(parts) == 1:
        return full
    folders = [f"{path}/delta/number={n}" for n, _ in parts[1:]]
    deltas = spark.read.schema(_DELTA).option("basePath", f"{path}/delta").parquet(*folders)
    last = with_cell(deltas)
    if len(folders) > 1:  # a delta has a path once
        last = newest(last, CELL_KEYS, ["number"]).drop(RANK)
    last = last.drop("number")
    paths = last.select(*CELL_KEYS)
    if sum(cells for _, cells in parts[1:]) <= BROADCAST_CELLS:
        paths = F.broadcast(paths)
    kept = with_cell(full).join(paths, CELL_KEYS, "left_anti")
    laid = last.where(~F.col("gone")).drop("gone")
    return kept.unionByName(laid).select(*cell_path(), "value", "ts").select(*CELL_COLUMNS)


def compact(spark: SparkSession, path: str, number: int) -> None:
    """Write snapshot `number` as a full dump as well."""
    cells = load_chained(spark, path, number)
    if cells is None:
        raise ValueError(f"snapshot {number} was not stored")
    if len(chain(spark, path, number)) > 1:
        store_full(cells, path, number)
