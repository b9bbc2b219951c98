"""Net changes of an append-only mutation log.

A mutation without a column name deletes its whole row (or super column). The plan
never gathers a row's mutations in one place. Each cell is first reduced to its two
newest mutations and the time of its first insertion, all of which begin before the
shuffle; what a deletion needs from the whole row is one small aggregate, joined to
the reduced cells. A hot row or cell therefore sends a few records per map task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellshift.model import (
    CELL_KEYS,
    CHANGE_COLUMNS,
    DEL,
    INS,
    PATH,
    ROW_KEYS,
    TOMBSTONE,
    UPD,
    UPSERT,
    as_changes,
    cell_path,
    cell_row,
    row_struct,
    with_cell,
)
from cellshift.operators.grouping import RANK, newest, recency

SUPER_KEYS = [*ROW_KEYS, "super_column"]
ORDER = ("ts", "seq")


def _is_deletion() -> Column:
    return (F.col("op") == DEL) & F.col("column_name").isNull()


def key_deletions(mutations: DataFrame) -> DataFrame:
    """Newest deletion of each row, of the whole row or of any of its super columns."""
    return _row_deletions(mutations).select("row.*", "deleted_at")


def _row_deletions(mutations: DataFrame) -> DataFrame:
    return _per_row(mutations.where(_is_deletion()), F.max("ts").alias("deleted_at"))


def _per_row(df: DataFrame, *aggregates: Column) -> DataFrame:
    """Aggregates per row key, to be joined on the `row` struct.

    The struct is built after the grouping on purpose. A join on the grouping keys
    would take the grouped side as it is, and Spark splits the partition of a hot row
    only if both sides of the join come right out of a shuffle.
    """
    grouped = df.groupBy(*ROW_KEYS).agg(*aggregates)
    return grouped.select(row_struct(), *[c for c in grouped.columns if c not in ROW_KEYS])


def super_deletions(mutations: DataFrame) -> DataFrame:
    """Newest deletion of each super column."""
    return _super_deletions(mutations).select("super.*", "deleted_at")


def _super_deletions(mutations: DataFrame) -> DataFrame:
    deletions = mutations.where(_is_deletion() & F.col("super_column").isNotNull())
    grouped = deletions.groupBy(*SUPER_KEYS).agg(F.max("ts").alias("deleted_at"))
    return grouped.select(F.struct(*SUPER_KEYS).alias("super"), "deleted_at")


def after_deletion(mutations: DataFrame) -> DataFrame:
    """Mutations newer than the deletion of their row; all where there is none."""
    rows = mutations.select("*", row_struct())
    joined = rows.join(_row_deletions(mutations), "row", "left")
    alive = F.col("deleted_at").isNull() | (F.col("ts") > F.col("deleted_at"))
    return joined.where(alive).select(*mutations.columns)


def _first_insertions(mutations: DataFrame) -> DataFrame:
    """Time of the first insertion of each cell: numbers only, combined map-side."""
    inserted = with_cell(mutations.where(F.col("op") == INS))
    return inserted.groupBy(*CELL_KEYS).agg(F.min("ts").alias("inserted_at"))


def row_tombstones(mutations: DataFrame) -> DataFrame:
    """One `del` per cell inserted before the deletion of its row."""
    cells = _first_insertions(mutations).select("*", cell_row())
    dead = cells.join(_row_deletions(mutations), "row")
    dead = dead.where(F.col("inserted_at") < F.col("deleted_at"))
    return _buried(dead)


def _buried(cells: DataFrame) -> DataFrame:
    value, ts = F.lit(TOMBSTONE).alias("value"), F.col("deleted_at").alias("ts")
    return as_changes(cells.select(*cell_path(), value, ts), DEL)


def super_tombstones(mutations: DataFrame) -> DataFrame:
    """What the newest super column deletion of each row leaves of earlier mutations.

    Cells of that super column inserted before it become one `del` each; earlier
    mutations of the row's other super columns stay as they are.
    """
    found = mutations.where(_is_deletion() & F.col("super_column").isNotNull())
    newest_first_read = F.struct("ts", (-F.col("seq")).alias("first"), "super_column")
    last = _per_row(found, F.max(newest_first_read).alias("last")).select(
        "row",
        F.col("last.ts").alias("deleted_at"),
        F.col("last.super_column").alias("deleted_super"),
    )
    cells = _first_insertions(mutations).select("*", cell_row()).join(last, "row")
    dead = cells.where(
        (F.col("cell.super_column") == F.col("deleted_super"))
        & (F.col("inserted_at") < F.col("deleted_at"))
    )
    others = mutations.select("*", row_struct()).join(last, "row")
    others = others.where(
        ~F.col("super_column").eqNullSafe(F.col("deleted_super"))
        & (F.col("ts") < F.col("deleted_at"))
    )
    return _buried(dead).unionByName(as_changes(others, F.col("op")))


def latest_mutations(mutations: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Newest mutation of each cell; `order` ends with the read order, for ties."""
    last = newest(with_cell(mutations), CELL_KEYS, order)
    return as_changes(last.select("op", *cell_path(), "value", "ts"), F.col("op"))


def _two_newest(mutations: DataFrame, order: Sequence[str]) -> DataFrame:
    """Newest mutation of each cell with op and time of the one before."""
    keyed = with_cell(mutations).select(
        *CELL_KEYS, "op", "value", *dict.fromkeys(["ts", *order])
    )
    two = newest(keyed, CELL_KEYS, order, n=2)
    window = Window.partitionBy(*CELL_KEYS).orderBy(*recency(order))
    return (
        two.withColumns(
            {"prev_op": F.lead("op").over(window), "prev_ts": F.lead("ts").over(window)}
        )
        .where(F.col(RANK) == 1)
        .select(*CELL_KEYS, "op", "value", "ts", "prev_op", "prev_ts")
    )


def reduce_log(mutations: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The few mutations that decide the net changes: `changes_by_log` is the same for them.

    Of each cell its two newest and its first insertion, of each row and super column
    the two newest deletions. A row keeps one mutation only if it had one, so what is
    left says all there is to know, also together with mutations yet to come.
    """
    keyed = with_cell(mutations)
    last = newest(keyed, CELL_KEYS, order, n=2).drop(RANK)
    # Beyond the two newest a cell needs the time of its first insertion alone.
    first = Window.partitionBy(*CELL_KEYS).orderBy(*[F.col(c).asc() for c in order])
    inserted = keyed.where(F.col("op") == INS).withColumn(RANK, F.row_number().over(first))
    inserted = inserted.where(F.col(RANK) == 1).drop(RANK)
    both = last.unionByName(inserted).dropDuplicates([*CELL_KEYS, "op", *order])
    return both.select(*[c for c in cell_path()], *[c for c in mutations.columns if c not in PATH])


def net_changes(mutations: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Newest mutation of each cell; an insertion over an insertion is an update."""
    cells = _two_newest(mutations, order)
    op = F.when((F.col("op") == INS) & (F.col("prev_op") == INS), UPD).otherwise(F.col("op"))
    return as_changes(cells.select(op.alias("op"), *cell_path(), "value", "ts"), F.col("op"))


def _row_facts(mutations: DataFrame, scope: str) -> DataFrame:
    """Deletion time and number of mutations of each row that has a deletion."""
    deletion = _is_deletion()
    if scope == "super":
        deletion = deletion & F.col("super_column").isNull()
    facts = _per_row(
        mutations,
        F.max(F.when(deletion, F.col("ts"))).alias("deleted_at"),
        F.max(_is_deletion()).alias("has_deletion"),
        F.count("*").alias("mutations"),
    )
    return facts.where("has_deletion").drop("has_deletion")


def changes_by_log(
    mutations: DataFrame,
    mode: str = "classified",
    scope: str = "row",
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """Net change of every cell in the log.

    Mutations up to the deletion of their row count no more; a row with a single
    mutation passes through. `classified` tells insertions from updates and gives a
    tombstone to each cell a deletion removed; `upsert` reports insertions and
    updates alike and drops removed cells. With scope `row` the deletion of a super
    column deletes the row; with `super` only the cells of that super column.
    """
    if mode not in ("classified", "upsert") or scope not in ("row", "super"):
        raise ValueError(f"unknown mode or scope: {mode}, {scope}")
    classified = mode == "classified"

    if classified:
        # Both sides are hashed on CELL_KEYS already: no further shuffle.
        cells = _two_newest(mutations, order).join(
            _first_insertions(mutations), CELL_KEYS, "left"
        )
    else:
        cells = newest(with_cell(mutations), CELL_KEYS, order)
    # Few rows have a deletion. Spark broadcasts their facts if the measured size
    # allows; otherwise it splits the partition of a hot row.
    facts = _row_facts(mutations, scope)
    cells = cells.select("*", cell_row()).join(facts, "row", "left")
    gone_at = F.col("deleted_at")
    if scope == "super":
        supers = _super_deletions(mutations).withColumnRenamed("deleted_at", "super_deleted_at")
        owner = F.struct(*cell_path()[: len(SUPER_KEYS)]).alias("super")
        cells = cells.select("*", owner).join(supers, "super", "left")
        gone_at = F.greatest("deleted_at", "super_deleted_at")

    single = F.coalesce(F.col("mutations") == 1, F.lit(False))
    alive = gone_at.isNull() | (F.col("ts") > gone_at)
    if not classified:
        op = F.when(F.col("op") == INS, UPSERT).otherwise(F.col("op"))
        kept = cells.where(single | alive).select(op.alias("op"), *cell_path(), "value", "ts")
        return kept.select(*CHANGE_COLUMNS)

    follows = (F.col("prev_op") == INS) & (gone_at.isNull() | (F.col("prev_ts") > gone_at))
    own_op = F.when((F.col("op") == INS) & follows, UPD).otherwise(F.col("op"))
    own = single | alive
    buried = ~own & (F.col("inserted_at") < gone_at)
    return (
        cells.where(own | buried)
        .select(
            F.when(own, own_op).otherwise(DEL).alias("op"),
            *cell_path(),
            F.when(own, F.col("value")).otherwise(TOMBSTONE).alias("value"),
            F.when(own, F.col("ts")).otherwise(gone_at).alias("ts"),
        )
        .select(*CHANGE_COLUMNS)
    )
