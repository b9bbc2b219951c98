"""The instant of the previous extraction, and the one that is under way.

A cycle is planned, run and saved. The plan is written first: a cycle that fails anywhere
before it is saved is run again over the window it was planned with, so what it appended is
replaced (`append_changes` replaces a cycle's partition) and nothing is yielded twice or lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from cellshift.functions.cycles import check_cycle, new_cycle
from cellshift.sources.sinks import append_changes

# A row is a saved cycle or, if it follows one, the plan of the next: `follows` is the
# `saved_at` of the saved one, 0 where none was saved yet.
SCHEMA = "cycle bigint, saved_at bigint, follows bigint"


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _saved(spark: SparkSession, path: str) -> tuple[int, int] | None:
    """(cycle, saved_at) of the cycle saved last."""
    rows = _rows(spark, path)
    if rows is None:
        return None
    last = rows.where("follows is null").agg(F.max(F.struct("saved_at", "cycle")).alias("last"))
    found = last.select("last.cycle", "last.saved_at").first()
    return None if found[0] is None else tuple(found)


def _append(spark: SparkSession, path: str, cycle: int, follows: int | None) -> None:
    """One row in one file: a reader sees it or does not."""
    row = [(check_cycle(cycle, allow_small=True), new_cycle(), follows)]
    spark.createDataFrame(row, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def read_cycle(spark: SparkSession, path: str | None, default: int = 0) -> int:
    """The cycle saved last, or `default` when none was saved or no path is used."""
    last = None if path is None else _saved(spark, path)
    return default if last is None else last[0]


def save_cycle(spark: SparkSession, path: str, cycle: int) -> None:
    """Append the cycle; a reader sees the old one or the new one, never neither."""
    _append(spark, path, cycle, None)


def planned_cycle(spark: SparkSession, path: str) -> int | None:
    """The end of the window that is under way: planned, not saved."""
    rows = _rows(spark, path)
    if rows is None:
        return None
    follows = (_saved(spark, path) or (0, 0))[1]
    # Of several plans after one cycle the first holds, for everyone who asks.
    plan = rows.where(F.col("follows") == follows).agg(F.min(F.struct("saved_at", "cycle")).alias("plan"))
    return plan.select("plan.cycle").first()[0]


@contextmanager
def cycle_window(
    spark: SparkSession, path: str, now: int | None = None
) -> Iterator[tuple[int, int]]:
    """Yield (last, until) and save `until` only if the block succeeds.

    `until` is planned before the block runs: `now`, or, if an earlier block failed or was
    lost after planning, what it had planned. What that block appended for the cycle
    `until` is replaced by the same rows; later ones belong to the next window. One
    cycle of a path runs at a time.
    """
    last = read_cycle(spark, path)
    until = planned_cycle(spark, path)
    if until is None:
        follows = (_saved(spark, path) or (0, 0))[1]
        _append(spark, path, new_cycle() if now is None else now, follows)
        until = planned_cycle(spark, path)
    yield last, until
    save_cycle(spark, path, until)


def extract_cycle(
    spark: SparkSession,
    state: str,
    out: str,
    extract: Callable[[int, int], DataFrame],
    now: int | None = None,
    style: str | None = None,
) -> int:
    """Append the changes `extract(last, until)` as cycle `until`, and return `until`.

    However often it fails and is called again, each window is there once.
    """
    with cycle_window(spark, state, now) as (last, until):
        append_changes(extract(last, until), out, until, style)
    return until
