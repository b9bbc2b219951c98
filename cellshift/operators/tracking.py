"""A table of pending changes, one section per state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellshift.model import (
    CHANGE_COLUMNS,
    DEL,
    INS,
    ROW_KEYS,
    TRACKING_COLUMNS,
    UPD,
    UP_NEW,
    UP_OLD,
)
from cellshift.operators.grouping import RANK, newest
from cellshift.operators.scan import in_window

CELL = [*ROW_KEYS, "column_name"]
PENDING = (UP_NEW, INS, DEL)


def bootstrap_tracking(
    cells: DataFrame, last_cycle: int | None = None, only_old: bool = False
) -> DataFrame:
    """Tracking rows for existing cells: all in `up_old`, the newer ones in `up_new` too.

    With `only_old` the cycle plays no part. Sub-columns are named `super/sub`.
    """
    name = F.concat_ws("/", "super_column", "column_name")
    base = cells.select(*ROW_KEYS, name.alias("column_name"), "value", "ts")
    if only_old:
        return base.withColumn("state", F.lit(UP_OLD)).select(*TRACKING_COLUMNS)
    if last_cycle is None:
        raise ValueError("last_cycle is needed unless only_old is set")
    states = F.when(F.col("ts") > last_cycle, F.array(F.lit(UP_OLD), F.lit(UP_NEW))).otherwise(
        F.array(F.lit(UP_OLD))
    )
    return base.select("*", F.explode(states).alias("state")).select(*TRACKING_COLUMNS)


def _pending(tracking: DataFrame, window: tuple[int, int] | None) -> DataFrame:
    rows = tracking.where(F.col("state").isin(*PENDING))
    return rows if window is None else in_window(rows, *window)


def changes_by_tracking(
    tracking: DataFrame,
    source_table: str | None = None,
    window: tuple[int, int] | None = None,
    unique: bool = True,
) -> DataFrame:
    """Pending rows as changes; with a window those strictly inside it.

    Changes carry the tracking table's own name unless `source_table` names the
    tracked one. A tracking table has one row per (row, state, column); for input
    that may repeat them, `unique=False` keeps the last of each change.
    """
    rows = _pending(tracking, window)
    table = F.col("column_family") if source_table is None else F.lit(source_table)
    changes = rows.select(
        F.when(F.col("state") == UP_NEW, UPD).otherwise(F.col("state")).alias("op"),
        "keyspace",
        table.alias("column_family"),
        "row_key",
        F.lit(None).cast("string").alias("super_column"),
        "column_name",
        "value",
        "ts",
    )
    if not unique:
        changes = newest(changes, ["op", *CELL], ["ts", "value"]).drop(RANK)
    return changes.select(*CHANGE_COLUMNS)


def _consumed(window: tuple[int, int]) -> Column:
    lo, hi = window
    return F.col("state").isin(*PENDING) & (F.col("ts") > lo) & (F.col("ts") < hi)


def tracking_step(
    tracking: DataFrame, window: tuple[int, int], now: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(still pending, new `up_old` rows, `up_old` rows taken away) of `maintain_tracking`.

    Only pending rows are read. A cell whose deletion alone was consumed is taken away.
    """
    still_pending = tracking.where((F.col("state") != UP_OLD) & ~_consumed(window))
    # One row per cell and state, so at most three candidates per cell.
    rank = F.when(F.col("state") == UP_NEW, 2).when(F.col("state") == INS, 1).otherwise(0)
    used = _pending(tracking, window).withColumn("rank", rank)
    last = newest(used, CELL, ["rank", "ts", "value"])
    as_old = [*ROW_KEYS, F.lit(UP_OLD).alias("state"), "column_name", "value"]
    as_old.append(F.lit(now).cast("bigint").alias("ts"))
    promoted = last.where(F.col("rank") > 0).select(*as_old)
    return still_pending.select(*TRACKING_COLUMNS), promoted, last.where(F.col("rank") == 0).select(*as_old)


def maintain_tracking(tracking: DataFrame, window: tuple[int, int], now: int) -> DataFrame:
    """The tracking table after the changes of `window` have been extracted.

    Consumed rows leave their section. Consumed updates and insertions become the
    `up_old` row of their cell, dated `now`, the update before the insertion; a
    consumed deletion alone takes the `up_old` row away.

    Pending rows are filtered, not joined. Only `up_old`, the large section, meets
    the consumed cells in an anti join, whose right side is small in a regular
    cycle and is then broadcast by Spark's own size check.
    """
    still_pending, promoted, _ = tracking_step(tracking, window, now)
    old = tracking.where(F.col("state") == UP_OLD)
    kept_old = old.join(_pending(tracking, window).select(*CELL), CELL, "left_anti")
    parts = [still_pending, kept_old, promoted]
    result, *rest = [p.select(*TRACKING_COLUMNS) for p in parts]
    for part in rest:
        result = result.unionByName(part)
    return result
