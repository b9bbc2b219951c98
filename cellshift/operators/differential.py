"""Changes between two full snapshots."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, functions as F

from cellshift.model import (
    CELL_COLUMNS,
    CELL_KEYS,
    CHANGE_COLUMNS,
    CHANGE_SCHEMA,
    DEL,
    INS,
    PATH,
    UPD,
    as_changes,
    cell_path,
    with_cell,
)
from cellshift.operators.grouping import RANK, newest

OLD, NEW = 0, 1


def tag_union(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both snapshots in one table, with `source` 0 for old cells and 1 for new."""
    return (
        old.select(*CELL_COLUMNS)
        .withColumn("source", F.lit(OLD))
        .unionByName(new.select(*CELL_COLUMNS).withColumn("source", F.lit(NEW)))
    )


def latest_cells(cells: DataFrame) -> DataFrame:
    """One cell per path: the last written, the greater value on equal times."""
    return newest(cells, PATH, ["ts", "value"]).drop(RANK)


def _matched(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame, list[Column]]:
    """Both snapshots by their join keys, always to be merged.

    The size of a snapshot is not known before it is flattened, so neither side may be
    broadcast, whatever its file size and the session's settings. Bucketed snapshots
    bring the keys they are bucketed on: Spark matches buckets.
    """

    def keyed(cells: DataFrame) -> DataFrame:
        stored = set(CELL_KEYS) <= set(cells.columns)
        columns = [*CELL_KEYS, "value", "ts"]
        return (cells.select(*columns) if stored else with_cell(cells.select(*CELL_COLUMNS))).hint("merge")

    o, n = keyed(old).alias("o"), keyed(new).alias("n")
    return o, n, [F.col(f"o.{k}") == F.col(f"n.{k}") for k in CELL_KEYS]


def _differs() -> Column:
    return (F.col("o.ts") != F.col("n.ts")) | (F.col("o.value") != F.col("n.value"))


def inserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of the new snapshot only."""
    o, n, on = _matched(old, new)
    found = n.join(o, on, "left_anti")
    return as_changes(found.select(*cell_path(), "value", "ts"), INS)


def deleted(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of the old snapshot only, with their last value."""
    o, n, on = _matched(old, new)
    found = o.join(n, on, "left_anti")
    return as_changes(found.select(*cell_path(), "value", "ts"), DEL)


def updated(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cells of both whose value or time differs."""
    o, n, on = _matched(old, new)
    found = n.join(o, on, "inner").where(_differs()).select("n.*")
    return as_changes(found.select(*cell_path(), "value", "ts"), UPD)


_BY_OP = {INS: inserted, DEL: deleted, UPD: updated}


def _compared(old: DataFrame, new: DataFrame) -> DataFrame:
    """One full outer join on the path, for snapshots with one cell per path."""
    o, n, on = _matched(old, new)
    op = (
        F.when(F.col("o.row_key").isNull(), INS)
        .when(F.col("n.row_key").isNull(), DEL)
        .when(_differs(), UPD)
    )
    both = o.join(n, on, "full_outer").select(
        op.alias("op"),
        *[F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in [*CELL_KEYS, "value", "ts"]],
    )
    return both.where(F.col("op").isNotNull()).select("op", *cell_path(), "value", "ts")


def _grouped(old: DataFrame, new: DataFrame) -> DataFrame:
    """The tagged union grouped by path; repeated cells collapse to the last one.

    Both sides of a path are picked by aggregates that start before the shuffle,
    so a path with very many copies is no heavier than another.
    """
    cell = F.struct("ts", "value")
    is_new = F.col("source") == NEW
    sides = (
        tag_union(old, new)
        .groupBy(*PATH)
        .agg(
            F.max(F.when(~is_new, cell)).alias("o"),
            F.max(F.when(is_new, cell)).alias("n"),
        )
    )
    op = (
        F.when(F.col("o").isNull(), INS)
        .when(F.col("n").isNull(), DEL)
        .when(F.col("o") != F.col("n"), UPD)
    )
    last = F.coalesce("n", "o")
    return sides.where(op.isNotNull()).select(
        op.alias("op"), *PATH, last["value"].alias("value"), last["ts"].alias("ts")
    )


def changes_by_differential(
    old: DataFrame | None,
    new: DataFrame | None,
    ops: Collection[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """Inserted, deleted and updated cells between two snapshots.

    Where a snapshot repeats a path, its last cell counts. `unique=True` states that
    neither does, as in a dump of a keyed table: then they are joined, with no
    grouping, and a single class in `ops` by the cheapest join. When either snapshot
    is missing (None) nothing is compared and the result is empty.
    """
    if old is None or new is None:
        given = old if old is not None else new
        if given is None:
            raise ValueError("neither snapshot exists")
        return given.sparkSession.createDataFrame([], CHANGE_SCHEMA)
    if ops is not None:
        unknown = set(ops) - set(_BY_OP)
        if unknown or not ops:
            raise ValueError(f"ops must be among {sorted(_BY_OP)}")
    if not unique:
        changes = _grouped(old, new)
        if ops is not None:
            changes = changes.where(F.col("op").isin(*ops))
        return changes.select(*CHANGE_COLUMNS)
    if ops is not None and len(set(ops)) == 1:
        return _BY_OP[next(iter(ops))](old, new)
    changes = _compared(old, new)
    if ops is not None:
        changes = changes.where(F.col("op").isin(*ops))
    return changes.select(*CHANGE_COLUMNS)
