"""Changes by comparing each cell with its audit cell."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from cellshift.functions.cells import split_audit_name
from cellshift.functions.cycles import after, check_cycle, micros
from cellshift.model import (
    AUDIT_PREFIX,
    CELL_COLUMNS,
    CELL_KEYS,
    INS,
    UPD,
    as_changes,
    cell_path,
    with_cell,
)

# Fixed value: how far before the cycle a bootstrap dates the newer cells.
BOOTSTRAP_OFFSET = 900


def bootstrap_audit(
    cells: DataFrame, last_cycle: int, offset: int = BOOTSTRAP_OFFSET
) -> DataFrame:
    """The cells and one audit cell for each: its value is the cell's time as text.

    Cells newer than the cycle get an audit time before it, so that the next
    extraction reports them as updates. Same for standard and super families.
    """
    dated = F.when(F.col("ts") <= last_cycle, F.col("ts")).otherwise(F.lit(last_cycle - offset))
    own = F.struct("column_name", "value", "ts")
    audit = F.struct(
        F.concat(F.lit(AUDIT_PREFIX), "column_name").alias("column_name"),
        F.col("ts").cast("string").alias("value"),
        dated.cast("bigint").alias("ts"),
    )
    rest = [c for c in CELL_COLUMNS if c not in ("column_name", "value", "ts")]
    return cells.select(*rest, F.inline(F.array(own, audit))).select(*CELL_COLUMNS)


def classify(
    effective: Column, audit: Column, last_cycle: int, boundary: str | None = None
) -> Column:
    """Class of a cell by its own and its audit time; null when nothing happened.

    A cell changed after the cycle whose audit time equals the cycle is in neither
    class; `boundary` names the class to give it instead.
    """
    cycle = F.lit(last_cycle)
    op = (
        F.when((effective > audit) & (effective > cycle) & (audit < cycle), UPD)
        .when((effective == audit) & (effective > cycle), INS)
        .when((effective > audit) & (effective > cycle) & (audit > cycle), INS)
    )
    if boundary is not None:
        op = op.when((effective > cycle) & (audit == cycle), boundary)
    return op


def changes_by_audit(
    cells: DataFrame,
    last_cycle: int,
    boundary: str | None = None,
    allow_small: bool = False,
) -> DataFrame:
    """Inserted and updated cells, from cells and audit cells in one long table.

    Only cells newer than the cycle can be in a class, so the older ones are left
    out by the scan. Audit cells take part with their time alone. Both are reduced to
    one record per path and task before they are shuffled, once.
    """
    check_cycle(last_cycle, allow_small)
    rows = with_cell(split_audit_name(cells))
    own = ~F.col("is_audit") & (F.col("ts") > last_cycle)
    # The newest own and audit cell of a path by aggregates of one scan: they start before
    # the shuffle, and one shuffle brings both together.
    met = (
        rows.where(F.col("is_audit") | own)
        .groupBy(*CELL_KEYS)
        .agg(
            F.max(F.when(~F.col("is_audit"), F.struct("ts", "value"))).alias("own"),
            F.max(F.when(F.col("is_audit"), F.col("ts"))).alias("audit_ts"),
        )
        .where(F.col("own").isNotNull())
    )
    ts = F.col("own.ts")
    op = classify(ts, F.coalesce("audit_ts", F.lit(0)), last_cycle, boundary)
    classified = met.select(op.alias("op"), *cell_path(), F.col("own.value").alias("value"), ts.alias("ts"))
    return as_changes(classified.where(F.col("op").isNotNull()), F.col("op"))


def changes_by_audit_wide(
    df: DataFrame,
    key: str,
    columns: Mapping[str, tuple[Column, str, Column]],
    last_cycle: int,
    *,
    keyspace: str,
    column_family: str,
    boundary: str | None = None,
    allow_small: bool = False,
) -> DataFrame:
    """As `changes_by_audit` for rows that hold cell and audit time side by side.

    `columns` maps a cell name to (value, name of its time column, audit micros).
    Both times are in one row, so nothing is shuffled.
    """
    check_cycle(last_cycle, allow_small)
    times = {time for _, time, _ in columns.values()}
    recent = F.lit(False)
    for time in sorted(times):
        recent = recent | after(df, time, last_cycle)
    entries = []
    for name, (value, time, audit) in columns.items():
        ts = micros(df, time)
        op = classify(ts, F.coalesce(audit, F.lit(0)), last_cycle, boundary)
        op = F.when(value.isNotNull(), op)
        fields = {"column_name": F.lit(name), "value": value.cast("string"), "ts": ts, "op": op}
        entries.append(F.struct(*[c.alias(n) for n, c in fields.items()]))
    cells = df.where(recent).select(
        F.lit(keyspace).alias("keyspace"),
        F.lit(column_family).alias("column_family"),
        F.col(key).cast("string").alias("row_key"),
        F.lit(None).cast("string").alias("super_column"),
        F.inline(F.array(*entries)),
    )
    return as_changes(cells.where(F.col("op").isNotNull()), F.col("op"))
