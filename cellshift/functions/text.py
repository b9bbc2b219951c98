"""Text forms of changes, snapshots, log records and bootstrap records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from cellshift.model import AUDIT_PREFIX, MUTATION_COLUMNS, PATH, ROW_KEYS

NULL_TEXT = "null"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(NULL_TEXT))


def _joined(separator: str, *names: str) -> Column:
    return F.concat_ws(separator, *[_text(n) for n in names])


# Style -> (key columns, value separator, value columns).
STYLES = {
    "change": (["op", *PATH], "", ["value"]),
    "log": (["op", *PATH], "-", ["value", "ts"]),
    "tracking": (["op", *ROW_KEYS, "column_name"], "", ["value"]),
    "snapshot": (PATH, "/", ["ts", "value"]),
    "differential": (PATH, "/", ["ts", "value", "op"]),
    "audit": (["row_key", "super_column", "column_name"], "-", ["value", "ts"]),
    "record": (ROW_KEYS, "/", ["op", "super_column", "column_name", "value", "ts"]),
    "audit_bootstrap": (["row_key"], ":", ["column_name", "ts"]),
    "tracking_bootstrap": (["row_key"], ":", ["column_name", "value", "ts"]),
}


def render_changes(
    df: DataFrame, style: str = "change", keep: Sequence[str] = ()
) -> DataFrame:
    """(key, value) text of typed records.

    `change` and `log` are the results of the scan, audit and log methods,
    `tracking` those of the tracking table, `differential` and `snapshot` the
    lines of those two; `audit`, `record` and the bootstrap styles are the
    records the methods exchange. Style `audit` expects `is_audit`. Columns in
    `keep`, such as the `seq` of mutations, stay beside the text.
    """
    keys, separator, values = STYLES[style]
    value = _joined(separator, *values)
    if style == "audit":
        value = F.concat(F.when(F.col("is_audit"), AUDIT_PREFIX).otherwise(""), value)
    return df.select(_joined("/", *keys).alias("key"), value.alias("value"), *keep)


def render_lines(rendered: DataFrame, separator: str = "\t") -> DataFrame:
    """One `line` per (key, value): tab for job output, `:` for tracking files."""
    return rendered.select(F.concat("key", F.lit(separator), "value").alias("line"))


def _named(c: Column) -> Column:
    return F.when(c != NULL_TEXT, c)


def _without_last(c: Column, last: Column) -> Column:
    """`c` without its last part and the separator before it."""
    return F.substring(c, F.lit(1), F.length(c) - F.length(last) - 1)


def split_last(c: Column, separator: str) -> tuple[Column, Column]:
    """What is before the last separator, and what is after it."""
    last = F.substring_index(c, separator, -1)
    return _without_last(c, last), last


# Below, fields that may hold the separator are the ones left over when the others
# have been taken from both ends. A time that is no number is read as null.


def parse_log_records(df: DataFrame) -> DataFrame:
    """Inverse of style `record`; `seq` is kept when the input carries it."""
    row = F.split("key", "/", 3)
    op, super_column, column, rest = (F.get(F.split("value", "/", 4), F.lit(i)) for i in range(4))
    value, ts = split_last(rest, "/")
    column_name = _named(column)
    out = df.select(
        *[F.get(row, F.lit(i)).alias(n) for i, n in enumerate(ROW_KEYS)],
        _named(super_column).alias("super_column"),
        column_name.alias("column_name"),
        op.alias("op"),
        F.when(column_name.isNotNull(), value).alias("value"),
        ts.try_cast("bigint").alias("ts"),
        *[F.col(c) for c in df.columns if c == "seq"],
    )
    return out.select(*[c for c in MUTATION_COLUMNS if c in out.columns])


def parse_audit_values(df: DataFrame) -> DataFrame:
    """Inverse of style `audit`: the time stamp follows the last `-`."""
    before, column_name = split_last(F.col("key"), "/")
    row_key, super_column = split_last(before, "/")
    is_audit = F.col("value").startswith(AUDIT_PREFIX)
    tagged, ts = split_last(F.col("value"), "-")
    untagged = F.substring(tagged, len(AUDIT_PREFIX) + 1, 2**31 - 1)
    return df.select(
        row_key.alias("row_key"),
        _named(super_column).alias("super_column"),
        column_name.alias("column_name"),
        is_audit.alias("is_audit"),
        F.when(is_audit, untagged).otherwise(tagged).alias("value"),
        ts.try_cast("bigint").alias("ts"),
    )


def parse_bootstrap(df: DataFrame, with_value: bool) -> DataFrame:
    """Inverse of the bootstrap styles: `col:ts` or `col:value:ts`."""
    named, ts = split_last(F.col("value"), ":")
    fields = {"column_name": named}
    if with_value:
        parts = F.split(named, ":", 2)
        fields = {"column_name": F.get(parts, F.lit(0)), "value": F.get(parts, F.lit(1))}
    return df.select(
        F.col("key").alias("row_key"),
        *[c.alias(n) for n, c in fields.items()],
        ts.try_cast("bigint").alias("ts"),
    )


def parse_path(path: Column) -> list[Column]:
    """The five parts of a `ks/cf/key/super/col` path; a row key may hold `/`."""
    head = F.split(path, "/", 3)
    keyspace, family, rest = (F.get(head, F.lit(i)) for i in range(3))
    before, column_name = split_last(rest, "/")
    row_key, super_column = split_last(before, "/")
    parts = [keyspace, family, row_key, _named(super_column), column_name]
    return [c.alias(n) for n, c in zip(PATH, parts)]
