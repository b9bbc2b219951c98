"""Changes by write time alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellshift.functions.cycles import check_cycle
from cellshift.model import UPSERT, as_changes


def changes_by_scan(
    cells: DataFrame, last_cycle: int, allow_small: bool = False, until: int | None = None
) -> DataFrame:
    """Cells written after `last_cycle`, all as `upsert`; deletions leave no cell.

    Give both ends of a `cycle_window`: what is written up to `until` belongs to this
    cycle, and what comes while it is read to the next one.
    """
    check_cycle(last_cycle, allow_small)
    written = F.col("ts") > last_cycle
    if until is not None:
        written = written & (F.col("ts") <= check_cycle(until, allow_small))
    return as_changes(cells.where(written), UPSERT)


def in_window(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows strictly between the two cycles."""
    return df.where((F.col("ts") > lo) & (F.col("ts") < hi))
