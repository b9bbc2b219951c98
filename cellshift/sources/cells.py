"""Wide tables in, cells out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellshift.functions.cycles import after, micros
from cellshift.model import CELL_COLUMNS

RESERVED = "__cell_"


def column_names(prefix: str, count: int) -> list[str]:
    """`prefix0 .. prefix<count-1>`, for families and for super columns alike."""
    return [f"{prefix}{i}" for i in range(count)]


def _column(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _source(keyspace: str, column_family: str) -> list[Column]:
    return [
        F.lit(keyspace).alias("keyspace"),
        F.lit(column_family).alias("column_family"),
    ]


def flatten_standard(
    df: DataFrame,
    key: str,
    columns: Sequence[str] | Mapping[str, str | Column],
    ts: str | Mapping[str, str],
    *,
    keyspace: str,
    column_family: str,
    since: int | None = None,
) -> DataFrame:
    """One cell per present value of the listed columns.

    `columns` lists source columns, or maps cell names to them. `ts` names the
    write time of the whole row, or maps each cell name to its own. `since` keeps
    cells written later; for a row-wide time the test reaches the scan.
    """
    if not isinstance(columns, Mapping):
        columns = {c: c for c in columns}
    values = {
        name: (_column(c) if isinstance(c, str) else c).cast("string")
        for name, c in columns.items()
    }
    head = [*_source(keyspace, column_family), _column(key).cast("string").alias("row_key")]
    if isinstance(ts, str):
        rows = df if since is None else df.where(after(df, ts, since))
        # Cells may be named like the ids: those wait under reserved names.
        ids = [f"{RESERVED}{n}" for n in ("keyspace", "column_family", "row_key", "ts")]
        wide = rows.select(
            *[c.alias(i) for c, i in zip([*head, micros(df, ts)], ids)],
            *[v.alias(n) for n, v in values.items()],
        )
        cells = wide.unpivot(ids, [_column(n) for n in values], "column_name", "value")
        cells = cells.select(
            *[F.col(i).alias(i.removeprefix(RESERVED)) for i in ids], "column_name", "value"
        )
    else:
        entries = [
            F.struct(
                F.lit(name).alias("column_name"), v.alias("value"), micros(df, ts[name]).alias("ts")
            )
            for name, v in values.items()
        ]
        cells = df.select(*head, F.inline(F.array(*entries)))
        if since is not None:
            cells = cells.where(F.col("ts") > since)
    return (
        cells.where(F.col("value").isNotNull())
        .withColumn("super_column", F.lit(None).cast("string"))
        .select(*CELL_COLUMNS)
    )


def _written_after(subs: Column, since: int | None) -> Column:
    """The entries of a `map<name, struct<value, ts>>` written later; all without a time."""
    return subs if since is None else F.map_filter(subs, lambda _, cell: cell["ts"] > since)


def flatten_map(
    df: DataFrame,
    key: str,
    columns: str,
    *,
    keyspace: str,
    column_family: str,
    since: int | None = None,
) -> DataFrame:
    """Rows whose cells sit in a `map<name, struct<value, ts>>`.

    `since` keeps cells written later; it is applied to the map, before it is expanded.
    """
    return df.select(
        *_source(keyspace, column_family),
        _column(key).cast("string").alias("row_key"),
        F.lit(None).cast("string").alias("super_column"),
        F.explode(_written_after(_column(columns), since)).alias("column_name", "cell"),
    ).select(
        *CELL_COLUMNS[:-2], F.col("cell.value").alias("value"), F.col("cell.ts").alias("ts")
    ).where(F.col("value").isNotNull())


def flatten_super(
    df: DataFrame,
    key: str,
    columns: str,
    *,
    keyspace: str,
    column_family: str,
    super_columns: Sequence[str] | None = None,
    since: int | None = None,
) -> DataFrame:
    """Rows of `map<super, map<name, struct<value, ts>>>`, all sub-columns of each
    super column. `super_columns` limits which super columns are read, `since` keeps
    cells written later; both are applied to the maps, before those are expanded."""
    wanted = _column(columns)
    if super_columns is not None:
        names = list(super_columns)
        wanted = F.map_filter(wanted, lambda name, _: name.isin(names))
    if since is not None:
        wanted = F.map_filter(
            F.transform_values(wanted, lambda _, subs: _written_after(subs, since)),
            lambda _, subs: F.cardinality(subs) > 0,
        )
    supers = df.select(
        *_source(keyspace, column_family),
        _column(key).cast("string").alias("row_key"),
        F.explode(wanted).alias("super_column", "subs"),
    )
    return supers.select(
        "keyspace", "column_family", "row_key", "super_column",
        F.explode("subs").alias("column_name", "cell"),
    ).select(
        *CELL_COLUMNS[:-2], F.col("cell.value").alias("value"), F.col("cell.ts").alias("ts")
    ).where(F.col("value").isNotNull())


def slice_columns(cells: DataFrame, names: Sequence[str]) -> DataFrame:
    """Keep the named columns; on a stored cell table the test is pushed down."""
    return cells.where(F.col("column_name").isin(list(names)))


def read_cells(
    spark: SparkSession,
    source: str,
    key: str,
    columns: Sequence[str] | Mapping[str, str | Column],
    ts: str | Mapping[str, str],
    *,
    keyspace: str,
    column_family: str,
    since: int | None = None,
) -> DataFrame:
    """Cells of a Parquet folder or a table; only the named columns are scanned.

    What holds a `/` is a folder. Give any other source as DataFrame to
    `flatten_standard`.
    """
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    return flatten_standard(
        df, key, columns, ts, keyspace=keyspace, column_family=column_family, since=since
    )
