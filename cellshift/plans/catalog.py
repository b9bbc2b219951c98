"""Every operator as a query over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellshift.functions import cells as cell_functions
from cellshift.functions.text import (
    parse_audit_values,
    parse_bootstrap,
    parse_log_records,
    render_changes,
    render_lines,
)
from cellshift.model import (
    CHANGE_SCHEMA,
    DEL,
    INS,
    MUTATION_SCHEMA,
    TRACKING_SCHEMA,
    UPD,
)
from cellshift.operators import log
from cellshift.operators.audit import bootstrap_audit, changes_by_audit, changes_by_audit_wide
from cellshift.operators.differential import changes_by_differential, latest_cells, tag_union
from cellshift.operators.scan import changes_by_scan, in_window
from cellshift.operators.tracking import (
    bootstrap_tracking,
    changes_by_tracking,
    maintain_tracking,
)
from cellshift.plans import fixtures as fx
from cellshift.session import shared_dir
from cellshift.sources.cells import column_names, flatten_map, slice_columns
from cellshift.sources.cells import flatten_super as flatten_super_rows
from cellshift.sources.chains import compact, load_chained, store_changes, store_delta, store_full
from cellshift.sources.digests import changes_by_digests, store_digest_snapshot
from cellshift.sources.log_files import load_log
from cellshift.sources.mutation_log import (
    log_lines,
    parse_log,
    read_log,
    rejected_log_lines,
    render_log,
    split_log,
    write_log,
)
from cellshift.sources.periods import append_by_time, scan_by_time
from cellshift.sources.sinks import append_changes, sort_by_key, write_changes
from cellshift.sources.snapshots import (
    load_snapshot,
    load_snapshot_table,
    parse_snapshot,
    store_snapshot,
    store_snapshot_table,
)
from cellshift.sources.state import cycle_window
from cellshift.sources.tables import create_cell_table, create_tracking, load_tracking, write_tracking
from cellshift.sources.tombstones import export_cells, merge_exports, parse_export
from cellshift.streaming.cycles import (
    current_changes,
    current_tracking,
    rejected_lines,
    run_cycle,
    run_tracking_cycle,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _styled(style: str, df: DataFrame, what: str) -> DataFrame:
    return render_changes(df, style).select(F.lit(style).alias("style"), what)


def _union(parts: list[DataFrame]) -> DataFrame:
    result, *rest = parts
    for part in rest:
        result = result.unionByName(part)
    return result


# --- sources and text -----------------------------------------------------------------


@query
def slice_columns_query(spark, sf):
    """Two columns by pruning the scan, plus one by a predicate on super cells."""
    pruned = fx.cells_std(spark, sf, "status", "price")
    return pruned.unionByName(slice_columns(fx.cells_super(spark, sf), ["priority"]))


@query
def flatten_standard(spark, sf):
    return fx.cells_std(spark, sf)


@query
def flatten_standard_map(spark, sf):
    """The rows of the map form; cells without a value are not there."""
    orders = fx.table(spark, sf, "orders")
    ts = fx.micros(orders, "o_orderdate")
    urgent = F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus"))
    columns = {"price": (fx.money("o_totalprice"), ts), "urgent": (urgent, ts)}
    wide = orders.select("o_orderkey", fx._as_map(columns).alias("columns"))
    return flatten_map(wide, "o_orderkey", "columns", **fx.SOURCE)


@query
def flatten_super(spark, sf):
    return fx.cells_super(spark, sf)


@query
def slice_super_columns(spark, sf):
    """A list of super columns of rows that hold many: `order_0` to `order_99`."""
    rows = fx.customer_rows(spark, sf)
    names = column_names("order_", 100)
    return flatten_super_rows(rows, "o_custkey", "columns", super_columns=names, **fx.SUPER_SOURCE)


@query
def flatten_generated_names(spark, sf):
    """Ten generated column names over the line items, one cell each."""
    names = column_names("field", 10)
    sources = [
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_orderkey",
    ]
    items = fx.table(spark, sf, "lineitem")
    money = {"l_quantity", "l_extendedprice", "l_discount", "l_tax"}
    columns: dict[str, str | Column] = {
        n: fx.money(s) if s in money else s for n, s in zip(names, sources)
    }
    return fx.flatten_standard(items, "l_orderkey", columns, "l_shipdate", **fx.SOURCE)


@query
def change_keys_text(spark, sf):
    scanned = changes_by_scan(fx.cells_std(spark, sf, since=fx.CYCLE), fx.CYCLE)
    supers = changes_by_scan(fx.cells_super(spark, sf), fx.CYCLE)
    pending = changes_by_tracking(fx.tracking(spark, sf))
    return _union(
        [
            _styled("change", scanned, "key"),
            _styled("change", supers, "key"),
            _styled("tracking", pending, "key"),
            _styled("snapshot", fx.cells_super(spark, sf), "key"),
            _styled("record", fx.mutations(spark, sf), "key"),
        ]
    )


@query
def change_values_text(spark, sf):
    cells = fx.cells_std(spark, sf)
    audit = cell_functions.split_audit_name(fx.audit_cells(spark, sf))
    mutations = fx.mutations_super(spark, sf)
    lines = render_lines(render_changes(changes_by_tracking(fx.tracking(spark, sf)), "tracking"), ":")
    return _union(
        [
            _styled("snapshot", cells, "value"),
            _styled("audit", audit, "value"),
            _styled("log", mutations, "value"),
            _styled("differential", changes_by_scan(cells, fx.CYCLE), "value"),
            _styled("record", mutations, "value"),
            _styled("audit_bootstrap", cells, "value"),
            _styled("tracking_bootstrap", cells, "value"),
            lines.select(F.lit("tracking_line").alias("style"), F.col("line").alias("value")),
        ]
    )


@query
def parse_log_records_query(spark, sf):
    mutations = fx.mutations_super(spark, sf)
    records = render_changes(mutations, "record", keep=["seq"])
    return parse_log_records(records)


@query
def parse_audit_records(spark, sf):
    audit = cell_functions.split_audit_name(fx.audit_cells_super(spark, sf))
    return parse_audit_values(render_changes(audit, "audit"))


@query
def parse_bootstrap_records(spark, sf):
    cells = fx.cells_std(spark, sf)
    short = parse_bootstrap(render_changes(cells, "audit_bootstrap"), with_value=False)
    full = parse_bootstrap(render_changes(cells, "tracking_bootstrap"), with_value=True)
    return full.unionByName(short.withColumn("value", F.lit(None).cast("string")))


@query
def parse_snapshot_lines(spark, sf):
    cells = fx.cells_std(spark, sf).unionByName(fx.cells_super(spark, sf))
    lines = render_lines(render_changes(cells, "snapshot"))
    return parse_snapshot(lines.withColumnRenamed("line", "value"))


@query
def sorted_changes(spark, sf):
    changes = changes_by_scan(fx.cells_std(spark, sf, since=fx.CYCLE), fx.CYCLE)
    return sort_by_key(render_changes(changes, "change"))


@query
def render_log_standard(spark, sf):
    return render_log(fx.mutations(spark, sf))


@query
def render_log_super(spark, sf):
    return render_log(fx.mutations_super(spark, sf), is_super=True)


@query
def parse_log_text(spark, sf):
    standard = parse_log(render_log(fx.mutations(spark, sf)))
    supers = parse_log(render_log(fx.mutations_super(spark, sf), True), True)
    return standard.unionByName(supers).drop("seq")


@query
def parse_multiline_log(spark, sf):
    """Values with line breaks, with what separates fields and with what separates records."""
    path = f"{run_dir(spark)}/log"
    write_log(fx.multiline_mutations(spark, sf), path, escape=True)
    return read_log(spark, path, escaped=True).drop("seq")


@query
def log_source_order(spark, sf):
    """Changes of a log whose equal times, of a quarter of a day, only the places in its files tell apart.

    A row's mutations lie in one file, in their order; tasks read ranges of 64 KB or, of a larger log, a 200th.
    """
    path = f"{run_dir(spark)}/log"
    ordered = fx.mutations(spark, sf).repartition("row_key").sortWithinPartitions("seq")
    write_log(ordered.withColumn("ts", F.expr("ts div 21600000000")), path)
    return log.changes_by_log(load_log(spark, path, block_bytes=64 << 10))


@query
def parse_flagged_log_text(spark, sf):
    """Lines with any flag: writes and deletions are read, the rest is rejected."""
    lines = fx.flagged_lines(spark, sf)
    parsed = parse_log(lines).select("row_key", "column_name", "op", "value", "ts")
    rejected = rejected_log_lines(lines).select(
        *[F.lit(None).cast("string").alias(c) for c in ("row_key", "column_name")],
        F.lit("reject").alias("op"),
        "value",
        F.lit(None).cast("bigint").alias("ts"),
    )
    return parsed.unionByName(rejected)


@query
def export_cells_tombstones(spark, sf):
    return export_cells(fx.tombstone_cells(spark, sf))


@query
def export_read_back(spark, sf):
    """Every shape of the export, written as text, read and parsed."""
    path = f"{run_dir(spark)}/export"
    export_cells(fx.tombstone_cells(spark, sf)).write.text(path)
    return parse_export(spark.read.text(path).withColumnRenamed("value", "line"))


@query
def merged_exports(spark, sf):
    """Three dumps: all cells before any super column was deleted, those up to LOW, those up to HIGH."""
    path = f"{run_dir(spark)}/export"
    cells = fx.tombstone_cells(spark, sf)
    early = cells.withColumn("super_deleted_at", F.lit(None).cast("bigint"))
    for dump in (early, cells.where(F.col("ts") < fx.LOW), cells.where((F.col("ts") >= fx.LOW) & (F.col("ts") < fx.HIGH))):
        export_cells(dump).write.mode("append").text(path)
    entries = parse_export(spark.read.text(path).withColumnRenamed("value", "line"))
    return merge_exports(entries, fx.KEYSPACE, fx.TABLE)


@query
def hex_to_string(spark, sf):
    """Names as hex, one digit too many, and back."""
    customers = fx.table(spark, sf, "customer")
    hexed = F.concat(F.hex("c_name"), F.lit("7"))
    return customers.select("c_custkey", cell_functions.hex_to_string(hexed).alias("name"))


# --- filters --------------------------------------------------------------------------


@query
def tracking_window_filter(spark, sf):
    return in_window(fx.versions(spark, sf), fx.LOW, fx.HIGH)


@query
def log_drop_system(spark, sf):
    return cell_functions.drop_system(fx.mixed_keyspaces(spark, sf))


@query
def log_ops_from_flags(spark, sf):
    accepted, rejected = cell_functions.ops_from_flags(fx.flagged_mutations(spark, sf))
    return accepted.select("row_key", "column_name", "op", "value", "ts").unionByName(
        rejected.select("row_key", "column_name", "value", "ts").withColumn("op", F.lit("reject"))
    )


@query
def audit_name_split(spark, sf):
    return cell_functions.split_audit_name(fx.audit_cells(spark, sf))


# --- scan and audit -------------------------------------------------------------------


@query
def scan_standard(spark, sf):
    return changes_by_scan(fx.cells_std(spark, sf, since=fx.CYCLE), fx.CYCLE)


@query
def scan_clustered(spark, sf):
    """The scan over a stored table, whose older periods are not read; some cells came late."""
    path = f"{run_dir(spark)}/cells"
    cells = fx.cells_std(spark, sf)
    late = F.pmod(F.xxhash64("row_key"), F.lit(10)) == 0
    append_by_time(cells.where(~late), path, 30 * fx.DAY)
    append_by_time(cells.where(late), path, 30 * fx.DAY)
    return scan_by_time(spark, path, fx.CYCLE, width=30 * fx.DAY)


@query
def scan_super(spark, sf):
    return changes_by_scan(fx.cells_super(spark, sf, since=fx.CYCLE), fx.CYCLE)


@query
def audit_bootstrap(spark, sf):
    return bootstrap_audit(fx.cells_std(spark, sf), fx.CYCLE)


@query
def audit_bootstrap_super(spark, sf):
    return bootstrap_audit(fx.cells_super(spark, sf), fx.CYCLE)


@query
def audit_changes(spark, sf):
    return changes_by_audit(fx.audit_cells(spark, sf), fx.CYCLE)


@query
def audit_changes_super(spark, sf):
    return changes_by_audit(fx.audit_cells_super(spark, sf), fx.CYCLE)


@query
def audit_changes_wide(spark, sf):
    rows, columns = fx.audit_wide(spark, sf)
    return changes_by_audit_wide(rows, "o_orderkey", columns, fx.CYCLE, **fx.SOURCE)


@query
def audit_after_bootstrap(spark, sf):
    """Bootstrap, then extract: every newer cell is an update."""
    return changes_by_audit(bootstrap_audit(fx.cells_std(spark, sf), fx.CYCLE), fx.CYCLE)


# --- snapshots ------------------------------------------------------------------------


@query
def snapshot_standard(spark, sf):
    return fx.snap_new(spark, sf)


@query
def snapshot_super(spark, sf):
    return fx.snap_new_super(spark, sf)


@query
def snapshot_tagged_union(spark, sf):
    return tag_union(fx.snap_old(spark, sf), fx.snap_new(spark, sf))


@query
def differential(spark, sf):
    """Order keys are unique, so each dump has one cell per path."""
    return changes_by_differential(fx.snap_old(spark, sf), fx.snap_new(spark, sf), unique=True)


@query
def differential_super(spark, sf):
    old, new = fx.snap_old_super(spark, sf), fx.snap_new_super(spark, sf)
    return changes_by_differential(old, new, unique=True)


@query
def differential_dedup(spark, sf):
    """Dumps that hold every version: those up to HIGH and those since LOW."""
    versions = fx.versions(spark, sf)
    old = versions.where(F.col("ts") <= fx.HIGH)
    new = versions.where(F.col("ts") >= fx.LOW)
    return changes_by_differential(old, new)


@query
def snapshot_dedup(spark, sf):
    return latest_cells(fx.versions(spark, sf))


@query
def diff_inserts(spark, sf):
    old, new = fx.snap_old(spark, sf), fx.snap_new(spark, sf)
    return changes_by_differential(old, new, [INS], unique=True)


@query
def diff_deletes(spark, sf):
    old, new = fx.snap_old(spark, sf), fx.snap_new(spark, sf)
    return changes_by_differential(old, new, [DEL], unique=True)


@query
def diff_updates(spark, sf):
    old, new = fx.snap_old(spark, sf), fx.snap_new(spark, sf)
    return changes_by_differential(old, new, [UPD], unique=True)


@query
def stored_differential(spark, sf):
    """Both snapshots written, read back and compared."""
    base = f"{run_dir(spark)}/snapshots"
    store_snapshot(fx.snap_old(spark, sf), base, 1)
    store_snapshot(fx.snap_new(spark, sf), base, 2)
    old, new = load_snapshot(spark, base, 1), load_snapshot(spark, base, 2)
    return changes_by_differential(old, new, unique=True)


# --- tracking -------------------------------------------------------------------------


@query
def tracking_bootstrap(spark, sf):
    return bootstrap_tracking(fx.cells_std(spark, sf), fx.CYCLE)


@query
def tracking_bootstrap_old(spark, sf):
    return bootstrap_tracking(fx.cells_std(spark, sf), only_old=True)


@query
def tracking_bootstrap_super(spark, sf):
    return bootstrap_tracking(fx.cells_super(spark, sf), only_old=True)


@query
def tracking_changes(spark, sf):
    return changes_by_tracking(fx.tracking(spark, sf))


@query
def tracking_window(spark, sf):
    return changes_by_tracking(
        fx.tracking_entries(spark, sf), fx.TABLE, (fx.LOW, fx.HIGH), unique=False
    )


@query
def tracking_maintain(spark, sf):
    """Over a stored table, whose states are partitions."""
    path = f"{run_dir(spark)}/tracking"
    write_tracking(fx.tracking(spark, sf), path)
    return maintain_tracking(load_tracking(spark, path), (fx.LOW, fx.HIGH), fx.HIGH)


# --- log ------------------------------------------------------------------------------


@query
def log_key_deletions(spark, sf):
    return log.key_deletions(fx.mutations_super(spark, sf))


@query
def log_after_delete(spark, sf):
    return log.after_deletion(fx.mutations(spark, sf))


@query
def log_tombstones(spark, sf):
    return log.row_tombstones(fx.mutations(spark, sf))


@query
def log_super_deletions(spark, sf):
    return log.super_deletions(fx.mutations_super(spark, sf))


@query
def log_super_tombstones(spark, sf):
    return log.super_tombstones(fx.mutations_super(spark, sf))


@query
def log_latest(spark, sf):
    return log.latest_mutations(fx.mutations(spark, sf))


@query
def log_net_changes(spark, sf):
    return log.net_changes(fx.mutations_super(spark, sf))


@query
def log_changes_upsert(spark, sf):
    return log.changes_by_log(fx.mutations(spark, sf), "upsert")


@query
def log_changes_classified(spark, sf):
    return log.changes_by_log(fx.mutations(spark, sf))


@query
def log_changes_upsert_super(spark, sf):
    return log.changes_by_log(fx.mutations_super(spark, sf), "upsert")


@query
def log_changes_classified_super(spark, sf):
    return log.changes_by_log(fx.mutations_super(spark, sf))


@query
def log_changes_super_scope(spark, sf):
    return log.changes_by_log(fx.mutations_super(spark, sf), scope="super")


# --- cycles ---------------------------------------------------------------------------


def _stream_in_parts(spark, mutations: DataFrame, mode: str) -> DataFrame:
    """A log of four appended parts, each taken up by a query that is started anew.

    Parts follow the numbers of the events, not their times: deletions come after cells
    they remove and before others, and equal times meet across parts.
    """
    base = run_dir(spark)
    for part in range(4):
        mutations.where(F.col("seq") % 4 == part).write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(MUTATION_SCHEMA).parquet(f"{base}/log")
        run_cycle(stream, f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return current_changes(spark, f"{base}/checkpoint", mode)


@query
def stream_log_changes(spark, sf):
    return _stream_in_parts(spark, fx.mutations(spark, sf), "classified")


@query
def compacted_changes(spark, sf):
    """From the state, which Spark compacts, as upserts."""
    return _stream_in_parts(spark, fx.mutations(spark, sf), "upsert")


@query
def stream_rejected_lines(spark, sf):
    """Text lines with unknown flags and bad numbers, in two cycles: none is lost."""
    base = run_dir(spark)
    lines = fx.flagged_lines(spark, sf)
    for part in (F.length("value") % 2 == 0, F.length("value") % 2 == 1):
        lines.where(part).write.mode("append").text(f"{base}/log")
        stream = split_log(log_lines(spark.readStream, f"{base}/log"))
        run_cycle(stream, f"{base}/checkpoint", f"{base}/out").awaitTermination()
    return rejected_lines(spark, f"{base}/out")


@query
def stream_tracking(spark, sf):
    """All tracking rows in three parts by time, `up_old` included, extracted and maintained
    by windows of ten days: the table after the last."""
    base = run_dir(spark)
    rows = fx.tracking_entries(spark, sf)
    ts = F.col("ts")
    for part in (ts < fx.LOW, (ts >= fx.LOW) & (ts < fx.HIGH), ts >= fx.HIGH):
        rows.where(part).write.mode("append").parquet(f"{base}/arrivals")
        stream = spark.readStream.schema(TRACKING_SCHEMA).parquet(f"{base}/arrivals")
        run_tracking_cycle(stream, f"{base}/checkpoint", f"{base}/out", fx.HIGH - fx.LOW, fx.LOW).awaitTermination()
    return current_tracking(spark, f"{base}/checkpoint")


@query
def stream_tracking_changes(spark, sf):
    """What those windows reported, each when it was closed."""
    base = run_dir(spark)
    fx.tracking_entries(spark, sf).write.parquet(f"{base}/arrivals")
    stream = spark.readStream.schema(TRACKING_SCHEMA).parquet(f"{base}/arrivals")
    run_tracking_cycle(stream, f"{base}/checkpoint", f"{base}/out", fx.HIGH - fx.LOW, fx.LOW, fx.TABLE).awaitTermination()
    return spark.read.parquet(f"{base}/out/changes")


# --- sinks, state and tables ------------------------------------------------------------


@query
def written_changes(spark, sf):
    """Parquet and text, each written twice over and read back."""
    base = run_dir(spark)
    changes = changes_by_scan(fx.cells_super(spark, sf, since=fx.CYCLE), fx.CYCLE)
    for given in (changes_by_scan(fx.cells_std(spark, sf), fx.CYCLE), changes):
        write_changes(given, f"{base}/parquet")
        write_changes(given, f"{base}/text", style="change")
    typed = render_changes(spark.read.schema(CHANGE_SCHEMA).parquet(f"{base}/parquet"), "change")
    parts = F.split("value", "\t", 2)
    text = spark.read.text(f"{base}/text").select(parts[0].alias("key"), parts[1].alias("value"))
    return typed.select(F.lit("parquet").alias("form"), "key", "value").unionByName(
        text.withColumn("form", F.lit("text"))
    )


@query
def appended_cycles(spark, sf):
    """Three cycles, the second run twice; the first attempt of it was another result."""
    base = f"{run_dir(spark)}/changes"
    changes = changes_by_scan(fx.cells_std(spark, sf, since=fx.CYCLE), fx.CYCLE)
    for cycle, name in ((1, "status"), (2, "status"), (2, "price"), (3, "priority")):
        append_changes(changes.where(F.col("column_name") == name), base, cycle)
    return spark.read.parquet(base)


@query
def missing_snapshot(spark, sf):
    """A pair of which one was never stored adds nothing to a pair that was."""
    base = f"{run_dir(spark)}/snapshots"
    store_snapshot(fx.snap_old(spark, sf), base, 1)
    store_snapshot(fx.snap_new(spark, sf), base, 2)
    old, new, none = (load_snapshot(spark, base, n) for n in (1, 2, 3))
    return changes_by_differential(old, new).unionByName(changes_by_differential(new, none))


@query
def bucketed_differential(spark, sf):
    """Snapshots stored in buckets of the join keys: comparing them shuffles nothing."""
    name = f"snapshot_{run_name(spark)}"
    store_snapshot_table(fx.snap_old(spark, sf), name, 1, 8)
    store_snapshot_table(fx.snap_new(spark, sf), name, 2, 8)
    old, new = load_snapshot_table(spark, name, 1), load_snapshot_table(spark, name, 2)
    return changes_by_differential(old, new, unique=True)


@query
def digest_differential(spark, sf):
    """Two dumps with digests: only buckets whose digests differ are read."""
    base = f"{run_dir(spark)}/snapshots"
    store_digest_snapshot(fx.snap_old(spark, sf), base, 1, 64)
    store_digest_snapshot(fx.snap_new(spark, sf), base, 2, 64)
    return changes_by_digests(spark, base, 1, 2, unique=True)


@query
def digest_differential_few(spark, sf):
    """A dump, and the same with one order in a thousand gone and another one rewritten."""
    base = f"{run_dir(spark)}/snapshots"
    cells = fx.snap_new(spark, sf)
    last = F.pmod(F.col("row_key").cast("long"), F.lit(1000))
    store_digest_snapshot(cells, base, 1)
    changed = cells.where(last != 7).withColumn("ts", F.when(last == 8, F.col("ts") + 1).otherwise(F.col("ts")))
    store_digest_snapshot(changed, base, 2)
    return changes_by_digests(spark, base, 1, 2)


@query
def chained_scans(spark, sf):
    """A dump of all versions up to LOW and two scans after it, compacted in between."""
    path = f"{run_dir(spark)}/chain"
    versions = fx.versions(spark, sf)
    store_full(latest_cells(versions.where(F.col("ts") <= fx.LOW)), path, 1)
    for number, (last, until) in enumerate(((fx.LOW, fx.HIGH), (fx.HIGH, fx.HIGH + 365 * fx.DAY)), 2):
        store_delta(changes_by_scan(versions, last, until=until), path, number)
        if number == 2:
            compact(spark, path, number)
    return load_chained(spark, path, 3)


@query
def chained_differential(spark, sf):
    """The old dump and what a differential found: together the new dump."""
    path = f"{run_dir(spark)}/chain"
    old, new = fx.snap_old(spark, sf), fx.snap_new(spark, sf)
    changes = changes_by_differential(old, new, unique=True)
    store_full(old, path, 1)
    store_changes(changes, path, 2)
    return load_chained(spark, path, 2)


@query
def cycle_scans(spark, sf):
    """Two cycles whose windows meet: every cell belongs to one of them."""
    base = run_dir(spark)
    for now in (fx.CYCLE, fx.HIGH):
        with cycle_window(spark, f"{base}/cycle", now) as (last, until):
            found = changes_by_scan(fx.cells_std(spark, sf, since=last), last, until=until)
            append_changes(found, f"{base}/changes", now)
    return spark.read.parquet(f"{base}/changes")


@query
def retried_cycles(spark, sf):
    """Three windows of the book. The second is run three times: it fails before it appends,
    then between append and save, and then ends, each time called with a later instant."""
    base = run_dir(spark)

    def attempt(now, fails_before=False, fails_after=False):
        with cycle_window(spark, f"{base}/cycle", now) as (last, until):
            found = changes_by_scan(fx.cells_std(spark, sf, since=last), last, until=until)
            if fails_before:
                raise InterruptedError
            append_changes(found, f"{base}/changes", until)
            if fails_after:
                raise InterruptedError

    attempt(fx.RETENTION)
    for now, failure in ((fx.CYCLE, "fails_before"), (fx.CYCLE + fx.DAY, "fails_after")):
        with suppress(InterruptedError):
            attempt(now, **{failure: True})
    attempt(fx.LOW)
    attempt(fx.HIGH)
    return spark.read.parquet(f"{base}/changes")


@query
def created_tracking(spark, sf):
    """A tracking table that is filled, created anew and filled with another table's rows."""
    path = f"{run_dir(spark)}/tracking"
    create_tracking(spark, path)
    write_tracking(fx.tracking(spark, sf), path)
    create_tracking(spark, path)
    rows = bootstrap_tracking(fx.cells_std(spark, sf), fx.CYCLE)
    rows.write.mode("append").partitionBy("keyspace", "column_family", "state").parquet(path)
    return load_tracking(spark, path)


@query
def created_tables(spark, sf):
    """Two tables of a new database, filled and read back."""
    database = f"cells_{run_name(spark)}"
    create_cell_table(spark, database, fx.TABLE, fx.SUPER_TABLE)
    for table, cells in ((fx.TABLE, fx.cells_std(spark, sf)), (fx.SUPER_TABLE, fx.cells_super(spark, sf))):
        cells.write.mode("append").insertInto(f"{database}.{table}")
    return spark.table(f"{database}.{fx.TABLE}").unionByName(spark.table(f"{database}.{fx.SUPER_TABLE}"))


def run_dir(spark: SparkSession) -> str:
    """A new folder for one run, under the folder the executors share."""
    return f"{shared_dir(spark)}/cellshift-{run_name(spark)}"


def run_name(spark: SparkSession) -> str:
    return spark.sql("SELECT replace(uuid(), '-', '')").first()[0]


for _name in ("slice_columns", "parse_log_records"):
    QUERIES[_name] = QUERIES.pop(f"{_name}_query")
