"""Flat text export of cells together with their deletion markers, and the way back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellshift.model import CELL_COLUMNS, ROW_KEYS
from cellshift.operators.grouping import RANK, newest
from cellshift.sources.mutation_log import LIVE_MARKED_FOR_DELETE

NULL_TEXT = "null"


def _line(value: Column, *key: Column) -> Column:
    return F.concat_ws(":", F.concat_ws("/", *key), value).alias("line")


def export_cells(cells: DataFrame) -> DataFrame:
    """One `line` per cell, `key:value`.

    Expects cells with `is_deleted`, `deleted_at` and `super_deleted_at`. A deleted
    super column is one line and hides its sub-columns; other cells are lines of
    their own, with value `null` when deleted.
    """
    row, name = F.col("row_key"), F.col("column_name")
    value = F.when(F.col("is_deleted"), NULL_TEXT).otherwise(F.col("value"))
    flag = F.col("is_deleted").cast("string")
    standard = _line(
        value, F.lit("st"), row, name,
        F.when(F.col("is_deleted"), F.col("deleted_at")).otherwise(F.col("ts")).cast("string"),
        flag,
    )
    sub = _line(
        value, F.lit("su"), row, F.col("super_column"), F.lit(LIVE_MARKED_FOR_DELETE), name,
        F.col("ts").cast("string"), flag,
    )
    shown = cells.where(F.col("super_deleted_at").isNull()).select(
        F.when(F.col("super_column").isNull(), standard).otherwise(sub).alias("line")
    )
    dead = (
        cells.where(F.col("super_deleted_at").isNotNull())
        .groupBy(*ROW_KEYS, "super_column")
        .agg(F.max("super_deleted_at").cast("string").alias("at"))
        .select(_line(F.lit(NULL_TEXT), F.lit("su"), row, F.col("super_column"), F.col("at")))
    )
    return shown.unionByName(dead)


# The shapes of a line. A row key may hold `/` and `:`, a value anything; of several ways to
# cut a line the one with the shortest row key counts, so values never reach into the key.
_NAME, _TIME = "([^/]*)", r"(-?\d+)"
_STANDARD = rf"(?s)^st/(.*?)/{_NAME}/{_TIME}/(true|false):(.*)$"
_SUB = rf"(?s)^su/(.*?)/{_NAME}/{_TIME}/{_NAME}/{_TIME}/(true|false):(.*)$"
_SUPER = rf"(?s)^su/(.*?)/{_NAME}/{_TIME}:{NULL_TEXT}$"


def _entry(row_key: Column, super_column: Column, column_name: Column, value: Column, ts: Column, deleted: Column, super_at: Column) -> Column:
    return F.struct(
        row_key.alias("row_key"),
        super_column.alias("super_column"),
        column_name.alias("column_name"),
        F.when(~deleted, value).alias("value"),
        ts.cast("bigint").alias("ts"),
        deleted.alias("is_deleted"),
        super_at.alias("super_deleted_at"),
    )


def parse_export(lines: DataFrame) -> DataFrame:
    """What `export_cells` wrote (column `line`), a row for each line that has one of its shapes.

    (row_key, super_column, column_name, value, ts, is_deleted, super_deleted_at): ts is the
    time of the cell or of its deletion; a deleted super column has no column name and no ts.
    A live value `null` is a text. Other lines are left out, see `rejected_export_lines`.
    """
    return lines.select(F.inline(_parsed(F.col("line"))))


def rejected_export_lines(lines: DataFrame) -> DataFrame:
    """The lines of no known shape."""
    return lines.where(F.size(_parsed(F.col("line"))) == 0).select("line")


def _parsed(line: Column) -> Column:
    """The line as an array of one entry or none."""

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(line, pattern, i)

    none = F.lit(None).cast("string")
    no_time = F.lit(None).cast("bigint")
    marked = part(_SUB, 3).try_cast("bigint")
    standard = _entry(part(_STANDARD, 1), none, part(_STANDARD, 2), part(_STANDARD, 5), part(_STANDARD, 3).try_cast("bigint"),
                      part(_STANDARD, 4) == "true", no_time)
    sub = _entry(part(_SUB, 1), part(_SUB, 2), part(_SUB, 4), part(_SUB, 7), part(_SUB, 5).try_cast("bigint"),
                 part(_SUB, 6) == "true", F.when(marked != int(LIVE_MARKED_FOR_DELETE), marked))
    whole = _entry(part(_SUPER, 1), part(_SUPER, 2), none, none, no_time, F.lit(True), part(_SUPER, 3).try_cast("bigint"))
    entry = (
        F.when(F.regexp_like(line, F.lit(_STANDARD)), standard)
        .when(F.regexp_like(line, F.lit(_SUB)), sub)
        .when(F.regexp_like(line, F.lit(_SUPER)), whole)
    )
    return F.array_compact(F.array(entry))


def merge_exports(entries: DataFrame, keyspace: str, column_family: str) -> DataFrame:
    """The cells that live after all dumps (rows of `parse_export`, of any number of them).

    Of a cell the newest entry counts; at equal times a deletion, then the greater value. What is
    no newer than a deletion of its super column is gone. Deletions are
    combined per super column before they meet the cells, which by then are one per path.
    """
    cell = ["row_key", "super_column", "column_name"]
    last = newest(entries.where(F.col("column_name").isNotNull()), cell, ["ts", "is_deleted", "value"]).drop(RANK)
    owner = ["row_key", "super_column"]
    gone = entries.where(F.col("super_deleted_at").isNotNull()).groupBy(*owner)
    gone = gone.agg(F.max("super_deleted_at").alias("gone_at")).select(F.struct(*owner).alias("owner"), "gone_at")
    # Joined on a struct built after the grouping: a hot super column can be split.
    live = last.where(~F.col("is_deleted")).withColumn("owner", F.struct(*owner)).join(gone, "owner", "left")
    live = live.where(F.col("gone_at").isNull() | (F.col("ts") > F.col("gone_at")))
    named = live.withColumns({"keyspace": F.lit(keyspace), "column_family": F.lit(column_family)})
    return named.select(*CELL_COLUMNS)
