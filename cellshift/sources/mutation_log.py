"""The bracketed text form of the mutation log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window, functions as F
from pyspark.sql.streaming.readwriter import DataStreamReader

from cellshift.functions.cells import FLAG_DELETION, FLAG_INSERTION, op_from_flag
from cellshift.model import DEL, MUTATION_COLUMNS

# Fixed values of the line layout: deletion markers of a live row or super column.
LIVE_LOCAL_DELETION = "-2147483648"
LIVE_MARKED_FOR_DELETE = "-9223372036854775808"

SEPARATOR = "]["
# What lies between two records of a file, and the mark of `render_log(escape=True)`.
RECORD_END = "]\n["
_MARK = "\x1b"
# Where a line was read, see `log_lines`.
FILE_COLUMNS = ("file_time", "file_path", "file_block")


def _line(*fields: Column | str) -> Column:
    columns = [F.lit(f) if isinstance(f, str) else f for f in fields]
    return F.concat(F.lit("["), F.concat_ws(SEPARATOR, *columns), F.lit("]"))


def _escaped(line: Column) -> Column:
    """The line with a mark behind each line break in it that could be taken for its end.

    Then no record holds the text between two records (`RECORD_END`), and none ends in
    a line break.
    """
    inner = F.substring(line, F.lit(2), F.char_length(line) - 2)
    marked = F.regexp_replace(inner, rf"\n(?=\[|{_MARK}|\z)", f"\n{_MARK}")
    return F.concat(F.lit("["), marked, F.lit("]"))


def render_log(mutations: DataFrame, is_super: bool = False, escape: bool = False) -> DataFrame:
    """One `value` line per mutation.

    Values are written as they are, line breaks included. `log_records` reads such lines back unless a
    value looks like the end of a record; with `escape` any value comes back.

    Without a column name the mutation deletes its super column, or its whole row
    when it has no super column either; the local deletion time of such a line is
    the mutation time in seconds. Text has no null: a null value is written as an empty
    one and read back as such.
    """
    flag = F.when(F.col("op") == DEL, str(FLAG_DELETION)).otherwise(str(FLAG_INSERTION))
    ts = F.col("ts").cast("string")
    local = F.expr("cast(ts div 1000000 as string)")
    value = F.coalesce("value", F.lit(""))
    head = (F.col("keyspace"), F.col("row_key"), "1", F.col("column_family"), "true")
    live = (LIVE_LOCAL_DELETION, LIVE_MARKED_FOR_DELETE, "1")

    row_deletion = _line(*head, local, ts, "0")
    cell = (F.col("column_name"), flag, ts, value)
    if is_super:
        named = _line(*head, *live, F.col("super_column"), "1", *live, *cell)
        super_deletion = _line(*head, *live, F.col("super_column"), "0", local, ts)
        line = (
            F.when(F.col("column_name").isNotNull(), named)
            .when(F.col("super_column").isNotNull(), super_deletion)
            .otherwise(row_deletion)
        )
    else:
        line = F.when(F.col("column_name").isNotNull(), _line(*head, *live, *cell))
        line = line.otherwise(row_deletion)
    return mutations.select((_escaped(line) if escape else line).alias("value"))


def _fields(lines: DataFrame, is_super: bool) -> DataFrame:
    """The bracketed fields of each line as array `f`.

    The last field is the cell value, which may itself hold the separator: the
    split stops there.
    """
    inner = F.expr("substring(value, 2, length(value) - 2)")
    fields = F.split(inner, r"\]\[", 17 if is_super else 12)
    return lines.select("*", fields.alias("f"))


def _shapes(is_super: bool) -> dict[int, tuple[Column, ...]]:
    """Number of fields -> (super column, column name, op, value, ts).

    Twelve fields are a cell of a standard family or the deletion of a super column.
    """
    def f(i: int) -> Column:
        return F.get("f", F.lit(i))

    none = F.lit(None).cast("string")
    shapes = {8: (none, none, F.lit(DEL), none, f(6))}
    if is_super:
        shapes[12] = (f(8), none, F.lit(DEL), none, f(11))
        shapes[17] = (f(8), f(13), op_from_flag(f(14).try_cast("int")), f(16), f(15))
    else:
        shapes[12] = (none, f(8), op_from_flag(f(9).try_cast("int")), f(11), f(10))
    return shapes


def _mutation(is_super: bool) -> Column:
    """The line as an array of one mutation.

    Null for an unknown shape or operation, and for a flag or time that is no number.
    """
    def f(i: int) -> Column:
        return F.get("f", F.lit(i))

    mutation = F.lit(None)
    for size, (super_column, column_name, op, value, ts) in _shapes(is_super).items():
        fields = F.struct(
            f(0).alias("keyspace"),
            f(3).alias("column_family"),
            f(1).alias("row_key"),
            super_column.alias("super_column"),
            column_name.alias("column_name"),
            op.alias("op"),
            value.alias("value"),
            ts.try_cast("bigint").alias("ts"),
        )
        known = (F.size("f") == size) & op.isNotNull() & ts.try_cast("bigint").isNotNull()
        mutation = F.when(known, F.array(fields)).otherwise(mutation)
    return mutation


def parse_log(lines: DataFrame, is_super: bool = False) -> DataFrame:
    """Mutations of log lines (column `value`).

    The kind of family must be given, since one line shape has two meanings. `seq`
    breaks ties between equal time stamps; it is taken from the input when there, for
    `log_lines` from the order of the files, else from the read order. A stream has no
    order before its batches are cut: there `seq` stays null, and the columns of
    `log_lines` stay beside the mutation. Lines of no known shape or operation, or with
    a flag or time that is no number, are left out, see `rejected_log_lines`;
    `split_log` keeps them.
    """
    if set(FILE_COLUMNS) <= set(lines.columns) and "seq" not in lines.columns:
        if lines.isStreaming:
            keep = [*FILE_COLUMNS]
        else:
            lines, keep = with_read_order(lines), []
    else:
        keep = []
    if "seq" in lines.columns:
        seq = F.col("seq").cast("bigint")
    elif lines.isStreaming:
        seq = F.lit(None).cast("bigint")
    else:
        seq = F.monotonically_increasing_id()
    # Expanding an array of one or none skips the rejected lines without parsing
    # every line a second time in a filter.
    fields = _fields(lines.select("value", *keep, seq.alias("seq")), is_super)
    return fields.select("seq", *keep, F.inline(_mutation(is_super))).select(*MUTATION_COLUMNS, *keep)


def split_log(lines: DataFrame, is_super: bool = False) -> DataFrame:
    """As `parse_log`, but rejected lines stay, as rows with null for every mutation
    column and the line in column `rejected`. One pass for both."""
    keep = [c for c in (*FILE_COLUMNS, "seq") if c in lines.columns]
    rows = _fields(lines.select("value", *keep), is_super)
    rows = rows.withColumn("mutation", _mutation(is_super))
    rejected = F.when(F.col("mutation").isNull(), F.col("value"))
    rows = rows.select(rejected.alias("rejected"), *keep, F.inline_outer("mutation"))
    if "seq" not in keep:
        rows = rows.withColumn("seq", F.lit(None).cast("bigint"))
    return rows.select(*MUTATION_COLUMNS, "rejected", *[c for c in keep if c != "seq"])


def log_lines(reader: DataFrameReader | DataStreamReader, path: str) -> DataFrame:
    """The lines of a log folder (`spark.read` or `spark.readStream`) and their places."""
    return _placed(reader.schema("value string").text(path), F.col("value"))


def log_records(reader: DataFrameReader | DataStreamReader, path: str, escaped: bool = False) -> DataFrame:
    """As `log_lines`, but a record may go over several lines.

    Files are split at what ends one record and begins the next, so a record that lies in two
    splits is read by the one it begins in. Any other line break belongs to the record, also a
    lone carriage return; a line that is no record is thus taken for the end of the one before
    it. `escaped` undoes `render_log(escape=True)`. Files end with a line break.
    """
    records = reader.schema("value string").option("lineSep", RECORD_END).text(path)
    first, last = F.startswith("value", F.lit("[")), F.endswith("value", F.lit("]\n"))
    start, dropped = first.cast("int"), first.cast("int") + 2 * last.cast("int")
    inner = F.substring("value", start + 1, F.char_length("value") - dropped)
    if escaped:
        inner = F.replace(inner, F.lit(f"\n{_MARK}"), F.lit("\n"))
    return _placed(records, F.concat(F.lit("["), inner, F.lit("]")))


def _placed(lines: DataFrame, value: Column) -> DataFrame:
    source = F.col("_metadata")
    return lines.select(
        value.alias("value"),
        source["file_modification_time"].alias("file_time"),
        source["file_path"].alias("file_path"),
        source["file_block_start"].alias("file_block"),
    )


def with_read_order(df: DataFrame) -> DataFrame:
    """`seq` by the files' times, then their paths, then the place within the file.

    Spark deals files out by size, so the order in which it reads them says nothing. The
    files are numbered from one row each; a place is the number of its 4 MB block and
    the row's number in its task, so 2**19 files, 1 TB a file and 2**26 rows a task fit.
    """
    placed = df.withColumn("seq", F.monotonically_increasing_id().bitwiseAND((1 << 26) - 1))
    files = placed.select("file_time", "file_path").distinct()
    nth = F.row_number().over(Window.orderBy("file_time", "file_path"))
    numbered = files.select(
        F.col("file_time").alias("t"), F.col("file_path").alias("p"), nth.cast("bigint").alias("nth")
    )
    block = F.expr("file_block div 4194304")
    seq = F.shiftleft("nth", 44) + F.shiftleft(block, 26) + F.col("seq")
    joined = placed.join(numbered, (F.col("file_time") == F.col("t")) & (F.col("file_path") == F.col("p")))
    return joined.withColumn("seq", seq).drop("t", "p", "nth", *FILE_COLUMNS)


def rejected_log_lines(lines: DataFrame, is_super: bool = False) -> DataFrame:
    """The lines `parse_log` leaves out, in a pass of their own."""
    rejected = F.when(_mutation(is_super).isNull(), F.array("value"))
    return _fields(lines, is_super).select(F.explode(rejected).alias("value"))


def read_log(spark: SparkSession, path: str, is_super: bool = False, escaped: bool | None = None) -> DataFrame:
    """The mutations of a log folder, in the order of its files.

    With `escaped` given, true or false, values may hold line breaks (`log_records`).
    """
    lines = log_lines(spark.read, path) if escaped is None else log_records(spark.read, path, escaped)
    return parse_log(lines, is_super)


def write_log(mutations: DataFrame, path: str, is_super: bool = False, escape: bool = False) -> None:
    """Append the lines of `mutations` to the log folder."""
    render_log(mutations, is_super, escape).write.mode("append").text(path)
