"""The shared test tables seen as cells, snapshots, tracking rows and mutations.

Each view reads a whole table. Instants are micros; `CYCLE` is 1998-01-01,
`RETENTION` 1996-01-01, and `LOW`/`HIGH` bound a window in January 2024.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellshift.functions.cycles import after, micros
from cellshift.model import CELL_COLUMNS, DEL, INS, UP_NEW, UP_OLD
from cellshift.operators.grouping import RANK, newest
from cellshift.sources.cells import flatten_standard, flatten_super, read_cells

KEYSPACE, TABLE, SUPER_TABLE, TRACKING_TABLE = "usertable", "data", "data_super", "dataTracking"
SOURCE = {"keyspace": KEYSPACE, "column_family": TABLE}
SUPER_SOURCE = {"keyspace": KEYSPACE, "column_family": SUPER_TABLE}

CYCLE = 883_612_800_000_000
RETENTION = 820_454_400_000_000
LOW = 1_704_844_800_000_000  # 2024-01-10
HIGH = 1_705_708_800_000_000  # 2024-01-20
DAY = 86_400_000_000
QUARTER = DAY // 4
AUDIT_AGE = 400 * DAY


def money(c: Column | str, add: int = 0) -> Column:
    """Two decimals as text; a double must not be cast to text directly."""
    amount = (F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")
    return ((amount + add) if add else amount).cast("string")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- orders as cells -------------------------------------------------------------

ORDER_COLUMNS = ("status", "price", "priority")


def order_columns(*names: str) -> dict[str, Column]:
    columns = {
        "status": F.col("o_orderstatus"),
        "price": money("o_totalprice"),
        "priority": F.col("o_orderpriority"),
    }
    return {n: columns[n] for n in names or ORDER_COLUMNS}


def cells_std(
    spark: SparkSession, sf_dir: str, *names: str, since: int | None = None
) -> DataFrame:
    """One row per order with columns status, price and priority."""
    return read_cells(
        spark, f"{sf_dir}/orders.parquet", "o_orderkey", order_columns(*names), "o_orderdate",
        since=since, **SOURCE,
    )


def _as_map(columns: dict[str, tuple[Column, Column]]) -> Column:
    entries = []
    for name, (value, ts) in columns.items():
        entries += [F.lit(name), F.struct(value.alias("value"), ts.alias("ts"))]
    return F.create_map(*entries)


def _super_rows(
    rows: DataFrame, columns: dict[str, tuple[Column, Column]], since: int | None = None
) -> DataFrame:
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    wide = rows.select("o_custkey", F.create_map(name, _as_map(columns)).alias("columns"))
    return flatten_super(wide, "o_custkey", "columns", since=since, **SUPER_SOURCE)


def cells_super(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """One row and super column per order, under the customer's key."""
    orders = table(spark, sf_dir, "orders")
    ts = micros(orders, "o_orderdate")
    return _super_rows(orders, {n: (c, ts) for n, c in order_columns().items()}, since)


def customer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, whose orders are as many super columns of one map."""
    orders = table(spark, sf_dir, "orders")
    ts = micros(orders, "o_orderdate")
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    entry = F.struct(name, _as_map({n: (c, ts) for n, c in order_columns().items()}))
    return orders.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(entry)).alias("columns"))


# --- two dumps of the order book --------------------------------------------------


def _old_book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Orders placed up to CYCLE; those now in progress were still open."""
    orders = table(spark, sf_dir, "orders")
    ts = micros(orders, "o_orderdate")
    status = F.when(F.col("o_orderstatus") == "P", "O").otherwise(F.col("o_orderstatus"))
    values = order_columns()
    return orders.where(~after(orders, "o_orderdate", CYCLE)), {
        "status": (status, ts),
        "price": (values["price"], ts),
        "priority": (values["priority"], ts),
    }


def _new_book(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Orders since RETENTION: a later status in progress, a surcharge on urgent
    orders under the old time, and the priority of finished ones written again."""
    orders = table(spark, sf_dir, "orders")
    ts = micros(orders, "o_orderdate")
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    price = F.when(priority == "1-URGENT", money("o_totalprice", add=1))
    return orders.where(after(orders, "o_orderdate", RETENTION - 1)), {
        "status": (status, F.when(status == "P", ts + DAY).otherwise(ts)),
        "price": (price.otherwise(money("o_totalprice")), ts),
        "priority": (priority, F.when(status == "F", ts + 1).otherwise(ts)),
    }


def _book_cells(rows: DataFrame, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    wide = rows.select(
        "o_orderkey",
        *[v.alias(n) for n, (v, _) in columns.items()],
        *[t.alias(f"{n}_ts") for n, (_, t) in columns.items()],
    )
    return flatten_standard(
        wide, "o_orderkey", list(columns), {n: f"{n}_ts" for n in columns}, **SOURCE
    )


def snap_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book_cells(*_old_book(spark, sf_dir))


def snap_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _book_cells(*_new_book(spark, sf_dir))


def snap_old_super(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _super_rows(*_old_book(spark, sf_dir))


def snap_new_super(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _super_rows(*_new_book(spark, sf_dir))


# --- audit cells -------------------------------------------------------------------


def _audit_ts(ts: Column) -> Column:
    """In-progress orders were inserted as they are, open ones written over, and
    finished ones have no audit cell."""
    status = F.col("o_orderstatus")
    return F.when(status == "P", ts).when(status == "O", ts - AUDIT_AGE)


def audit_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ts = micros(orders, "o_orderdate")
    wide = orders.select(
        "o_orderkey", ts.alias("ts"), _audit_ts(ts).alias("audit_ts"),
        *[c.alias(n) for n, c in order_columns().items()],
    )
    audit_value = F.when(F.col("audit_ts").isNotNull(), F.col("ts").cast("string"))
    values: dict[str, str | Column] = {n: n for n in ORDER_COLUMNS}
    values |= {f"audit:{n}": audit_value for n in ORDER_COLUMNS}
    times = {n: "audit_ts" if n.startswith("audit:") else "ts" for n in values}
    return flatten_standard(wide, "o_orderkey", values, times, **SOURCE)


def audit_cells_super(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    ts = micros(orders, "o_orderdate")
    audit_ts = _audit_ts(ts)
    columns = {n: (c, ts) for n, c in order_columns().items()}
    audit_value = F.when(audit_ts.isNotNull(), ts.cast("string"))
    columns |= {f"audit:{n}": (audit_value, audit_ts) for n in ORDER_COLUMNS}
    return _super_rows(orders, columns)


def audit_wide(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    """Orders with value, time column and audit time per cell name."""
    orders = table(spark, sf_dir, "orders")
    audit_ts = _audit_ts(micros(orders, "o_orderdate"))
    return orders, {n: (c, "o_orderdate", audit_ts) for n, c in order_columns().items()}


# --- events as versions, tracking rows and mutations -------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with the number in `props`, taken out once for all its uses."""
    events = table(spark, sf_dir, "events")
    return events.withColumn("number", F.regexp_extract("props", r"(\d+)", 1))


def _field() -> Column:
    """`field0 .. field9`, by the last digit of the number in `props`."""
    return F.concat(F.lit("field"), F.right("number", F.lit(1)))


def _day() -> Column:
    return F.col("ts").cast("date").cast("string")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a version of cell (user, event type): few, hot paths."""
    events = _events(spark, sf_dir)
    return events.select(
        F.lit(KEYSPACE).alias("keyspace"),
        F.lit(TABLE).alias("column_family"),
        F.col("user_id").cast("string").alias("row_key"),
        F.lit(None).cast("string").alias("super_column"),
        F.col("event_type").alias("column_name"),
        money("value").alias("value"),
        micros(events, "ts").alias("ts"),
    ).select(*CELL_COLUMNS)


def tracking_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a tracking row; (row, state, column) may repeat."""
    events = _events(spark, sf_dir)
    event = F.col("event_type")
    state = (
        F.when(event.isin("click", "purchase"), UP_NEW)
        .when(event == "signup", INS)
        .when(event == "error", DEL)
        .otherwise(UP_OLD)
    )
    return events.select(
        F.lit(KEYSPACE).alias("keyspace"),
        F.lit(TRACKING_TABLE).alias("column_family"),
        F.col("user_id").cast("string").alias("row_key"),
        state.alias("state"),
        _field().alias("column_name"),
        money("value").alias("value"),
        micros(events, "ts").alias("ts"),
    )


def tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tracking table those rows leave: the last of each (row, state, column)."""
    keys = ["keyspace", "column_family", "row_key", "state", "column_name"]
    return newest(tracking_entries(spark, sf_dir), keys, ["ts", "value"]).drop(RANK)


def _moment(events: DataFrame) -> Column:
    """Event time by quarters of a day, so that many mutations have equal times."""
    return micros(events, "ts") - F.pmod(micros(events, "ts"), F.lit(QUARTER))


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user and day as mutations of one row; a tenth of the errors
    delete the row."""
    events = _events(spark, sf_dir)
    error = F.col("event_type") == "error"
    row_deletion = error & (F.col("number").cast("int") < 10)
    return events.select(
        F.lit(KEYSPACE).alias("keyspace"),
        F.lit(TABLE).alias("column_family"),
        F.concat_ws("@", F.col("user_id").cast("string"), _day()).alias("row_key"),
        F.lit(None).cast("string").alias("super_column"),
        F.when(~row_deletion, _field()).alias("column_name"),
        F.when(error, DEL).otherwise(INS).alias("op"),
        F.when(~row_deletion, money("value")).alias("value"),
        _moment(events).alias("ts"),
        F.col("event_id").alias("seq"),
    )


# What values of `multiline_mutations` hold, by the last digit of the event.
BREAKS = ["\n", "\n\n", "\r", "\r\n", "]\n[", "][", "]\n", "\n[", "\n\x1b[", "]"]


def multiline_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`mutations` with a break around every value."""
    rows = mutations(spark, sf_dir)
    around = F.element_at(F.array(*map(F.lit, BREAKS)), (F.col("seq") % 10 + 1).cast("int"))
    value = F.when(F.col("value").isNotNull(), F.concat(around, F.col("value"), around))
    return rows.withColumn("value", value)


def mutations_super(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as mutations of a user's row with one super column per day; some
    errors delete the row, some the super column."""
    events = _events(spark, sf_dir)
    error = F.col("event_type") == "error"
    number = F.col("number").cast("int")
    row_deletion = error & (number < 2)
    deletion = error & (number < 10)
    return events.select(
        F.lit(KEYSPACE).alias("keyspace"),
        F.lit(SUPER_TABLE).alias("column_family"),
        F.col("user_id").cast("string").alias("row_key"),
        F.when(~row_deletion, _day()).alias("super_column"),
        F.when(~deletion, _field()).alias("column_name"),
        F.when(error, DEL).otherwise(INS).alias("op"),
        F.when(~deletion, money("value")).alias("value"),
        _moment(events).alias("ts"),
        F.col("event_id").alias("seq"),
    )


def tombstone_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells with deletion markers: errors are deleted cells of a standard
    row; in the super rows the super column `error` is deleted and clicks are
    deleted sub-columns."""
    events = _events(spark, sf_dir)
    event = F.col("event_type")
    ts = micros(events, "ts")
    none = F.lit(None).cast("bigint")
    common = [money("value").alias("value"), ts.alias("ts")]

    def markers(deleted: Column, super_deleted_at: Column) -> list[Column]:
        return [
            deleted.alias("is_deleted"),
            F.when(deleted, ts).alias("deleted_at"),
            super_deleted_at.alias("super_deleted_at"),
        ]

    def head(family: str) -> list[Column]:
        return [F.lit(KEYSPACE).alias("keyspace"), F.lit(family).alias("column_family")]

    standard = events.select(
        *head(TABLE),
        F.concat_ws("@", F.col("user_id").cast("string"), _day()).alias("row_key"),
        F.lit(None).cast("string").alias("super_column"),
        _field().alias("column_name"),
        *common,
        *markers(event == "error", none),
    )
    supers = events.select(
        *head(SUPER_TABLE),
        F.col("user_id").cast("string").alias("row_key"),
        event.alias("super_column"),
        _field().alias("column_name"),
        *common,
        *markers(event == "click", F.when(event == "error", ts)),
    )
    return standard.unionByName(supers)


# Event type -> serialization flag and -> keyspace, to exercise the log filters.
EVENT_FLAGS = {"view": 0, "error": 1, "click": 2, "signup": 4, "purchase": 8}
EVENT_KEYSPACES = {"view": "local", "signup": "system", "click": None}


def flagged_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as logged columns with a raw flag in place of the operation."""
    events = _events(spark, sf_dir)
    flag = F.lit(None).cast("int")
    for event, number in EVENT_FLAGS.items():
        flag = F.when(F.col("event_type") == event, number).otherwise(flag)
    return events.select(
        F.lit(KEYSPACE).alias("keyspace"),
        F.lit(TABLE).alias("column_family"),
        F.col("user_id").cast("string").alias("row_key"),
        F.lit(None).cast("string").alias("super_column"),
        _field().alias("column_name"),
        flag.alias("flag"),
        money("value").alias("value"),
        micros(events, "ts").alias("ts"),
        F.col("event_id").alias("seq"),
    )


def flagged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same columns as log lines that show the raw flag; where the number in `props`
    ends in 0 the flag is no number, where it ends in 1 the time is none."""
    rows = flagged_mutations(spark, sf_dir)
    flag = F.when(F.col("column_name") == "field0", "flag").otherwise(F.col("flag").cast("string"))
    time = F.when(F.col("column_name") == "field1", "never").otherwise(F.col("ts").cast("string"))
    line = (
        F.lit(KEYSPACE), F.col("row_key"), F.lit("1"), F.lit(TABLE), F.lit("true"),
        F.lit("-2147483648"), F.lit("-9223372036854775808"), F.lit("1"), F.col("column_name"),
        flag, time, F.col("value"),
    )
    text = F.concat(F.lit("["), F.concat_ws("][", *line), F.lit("]"))
    return rows.select(text.alias("value"))


def mixed_keyspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mutations of several keyspaces, some unknown."""
    keyspace = F.lit(KEYSPACE)
    for event, name in EVENT_KEYSPACES.items():
        keyspace = F.when(F.col("event_type") == event, name).otherwise(keyspace)
    events = _events(spark, sf_dir)
    return events.select(
        keyspace.alias("keyspace"),
        F.col("user_id").cast("string").alias("row_key"),
        _field().alias("column_name"),
        money("value").alias("value"),
        micros(events, "ts").alias("ts"),
    )
