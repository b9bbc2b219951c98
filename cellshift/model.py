"""The typed records every extraction method shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Fixed values of the data model.
AUDIT_PREFIX = "audit:"
TOMBSTONE = "tombstone"
UPSERT, INS, UPD, DEL = "upsert", "ins", "upd", "del"
UP_OLD, UP_NEW = "up_old", "up_new"
TRACKING_STATES = (UP_OLD, UP_NEW, INS, DEL)
SYSTEM_KEYSPACES = ("system", "local")

ROW_KEYS = ["keyspace", "column_family", "row_key"]
PATH = [*ROW_KEYS, "super_column", "column_name"]
PATH_HASH = "path_hash"
CELL_COLUMNS = [*PATH, "value", "ts"]
CHANGE_COLUMNS = ["op", *CELL_COLUMNS]
MUTATION_COLUMNS = [*PATH, "op", "value", "ts", "seq"]
TRACKING_COLUMNS = [*ROW_KEYS, "state", "column_name", "value", "ts"]

# Join keys of a cell: a hash of its path, its row key and everything else of the
# path in one `cell` struct; of a row: one `row` struct. Two structs are equal when
# their fields are, nulls included, so joins are null-safe without `<=>`, which would
# be rewritten to other expressions. And a struct is never a constant, even if one
# keyspace and family were given as literals: constants are dropped from join keys
# but not from grouping keys. Both keep a join lined up with the partitioning that a
# groupBy or a window on the same keys left behind. The hash decides nearly every
# comparison of a sort by looking at one number, and is what snapshots are bucketed on.
CELL_KEYS = [PATH_HASH, "row_key", "cell"]
_IN_CELL = [c for c in PATH if c != "row_key"]


def _schema(names: list[str], nullable: set[str]) -> T.StructType:
    longs = {"ts", "seq"}
    return T.StructType(
        [
            T.StructField(
                name, T.LongType() if name in longs else T.StringType(), name in nullable
            )
            for name in names
        ]
    )


CELL_SCHEMA = _schema(CELL_COLUMNS, {"super_column"})
CHANGE_SCHEMA = _schema(CHANGE_COLUMNS, {"super_column", "column_name", "value"})
MUTATION_SCHEMA = _schema(MUTATION_COLUMNS, {"super_column", "column_name", "value"})
TRACKING_SCHEMA = _schema(TRACKING_COLUMNS, set())


def with_cell(df: DataFrame) -> DataFrame:
    """Replace the path by CELL_KEYS; a stored hash is kept."""
    rest = [c for c in df.columns if c not in _IN_CELL]
    if PATH_HASH not in rest:
        rest.append(F.xxhash64(*PATH).alias(PATH_HASH))
    return df.select(*rest, F.struct(*_IN_CELL).alias("cell"))


def cell_path() -> list[Column]:
    """The path, read back from CELL_KEYS."""
    return [F.col(c) if c == "row_key" else F.col(f"cell.{c}").alias(c) for c in PATH]


def row_struct() -> Column:
    return F.struct(*ROW_KEYS).alias("row")


def cell_row() -> Column:
    """The `row` struct, read back from CELL_KEYS."""
    return F.struct(*cell_path()[: len(ROW_KEYS)]).alias("row")


def as_changes(df: DataFrame, op: Column | str, **replaced: Column) -> DataFrame:
    """Project `df` to the change record; keyword arguments replace columns."""
    op = F.lit(op) if isinstance(op, str) else op
    return df.select(
        op.alias("op"), *[replaced.get(c, F.col(c)).alias(c) for c in CELL_COLUMNS]
    )
