"""Where changes are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellshift.functions.text import render_changes, render_lines


def sort_by_key(rendered: DataFrame, *keys: str) -> DataFrame:
    """Totally ordered by key over range partitions, many files in key order."""
    return rendered.orderBy(*(keys or ("key",)))


def write_changes(
    changes: DataFrame, path: str, mode: str = "overwrite", style: str | None = None
) -> None:
    """Parquet, or with a style `key<TAB>value` text lines."""
    if style is None:
        changes.write.mode(mode).parquet(path)
    else:
        render_lines(render_changes(changes, style)).write.mode(mode).text(path)


def append_changes(
    changes: DataFrame, path: str, cycle: int, style: str | None = None
) -> None:
    """Add the results of one cycle to those of earlier cycles.

    Each cycle is a partition of its own, so a cycle that is run again replaces its
    first attempt. With a style the lines are `key:value` text.
    """
    if style is not None:
        changes = render_lines(render_changes(changes, style), ":")
    writer = (
        changes.withColumn("cycle", F.lit(cycle))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("cycle")
    )
    writer.parquet(path) if style is None else writer.text(path)
