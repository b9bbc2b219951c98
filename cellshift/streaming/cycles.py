"""Extraction cycles over streams, with all state in Spark's own store.

Each cycle is a run of a streaming query over what has arrived since the last one. The query's
checkpoint takes the place of the saved cycle: a lost executor or a restarted query goes
on from the last batch that was committed. What has to be remembered of each cell lies
in RocksDB state that Spark logs, snapshots and compacts below the checkpoint, and is read
from there as a table (`net_state`, `current_tracking`):

* of a log, each cell's newest mutation, the one before it and its first insertion
  (`LogCells`). `changes_by_log` over those equals one run over the whole log.
* of a tracking table, each cell's founding row and what is pending (`TrackedCells`), with
  an event-time timer at the end of each window that has something pending.

Python state is fetched and stored by messages, about a millisecond a key however little it
holds. So the key is a bucket of cells, by their hash: a batch pays for the buckets it touches
and some microseconds for each cell in them, touched or not.

Rows are reduced per cell before the shuffle, so that a cell with a third of all rows sends few
records per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from cellshift.model import CHANGE_COLUMNS, DEL, INS, MUTATION_COLUMNS, PATH, ROW_KEYS, TRACKING_COLUMNS, UP_NEW, UP_OLD
from cellshift.operators.log import changes_by_log
from cellshift.operators.tracking import CELL
from cellshift.sources.mutation_log import FILE_COLUMNS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CELL = "cell"  # name of the state variable
BUCKETS = 16_384  # part of the checkpoint: another number needs a new one


def _bucket(*cell: str) -> Column:
    return F.pmod(F.xxhash64(*cell), F.lit(BUCKETS)).cast("int").alias("bucket")


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def _state(spark: SparkSession, checkpoint: str) -> DataFrame | None:
    """The state as of the last committed batch, a row for each cell; None before the first."""
    try:
        state = spark.read.format("statestore").option("stateVarName", _CELL).load(checkpoint)
        return state.select(F.inline("value.cells"))
    except PySparkException as e:  # no checkpoint, or none with a committed batch
        if "STDS" not in (e.getCondition() or ""):
            raise
        return None


# --- the log ----------------------------------------------------------------------------

_PATH_DDL = ", ".join(f"{c} string" for c in PATH)
_NEWEST = "op string, value string, ts bigint, prev_op string, prev_ts bigint, inserted_at bigint, mutations bigint"
_ARRIVED = f"{_PATH_DDL}, {_NEWEST}, place string, prev_place string"


def _fields(ddl: str) -> str:
    """Columns of a table as fields of a struct."""
    return ", ".join(f"{name}: {kind}" for name, kind in (c.split() for c in ddl.split(", ")))


def reduce_arrivals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per cell of each Arrow batch: its newest mutation, the one before, its first
    insertion and how many there were. Equal times: by `place`, then by the order read."""
    read = 0
    for df in batches:
        rank = df["seq"].astype("Int64").fillna(pd.Series(range(read, read + len(df)), index=df.index))
        read += len(df)
        df["place"] = df["place"] + rank.map(lambda n: f"{n + (1 << 63):020d}")
        df["cell"] = df.groupby(PATH, dropna=False, sort=False).ngroup()
        df = df.sort_values(["ts", "place"], kind="stable")
        last = df.drop_duplicates("cell", keep="last").set_index("cell")
        before = df.drop(index=df.index[~df.duplicated("cell", keep="last")])
        before = before.drop_duplicates("cell", keep="last").set_index("cell")
        cells = df.groupby("cell")
        out = last[[*PATH, "op", "value", "ts", "place"]].copy()
        out["prev_op"], out["prev_place"] = before["op"], before["place"]
        out["prev_ts"] = before["ts"].astype("Int64")
        out["inserted_at"] = df[df["op"] == INS].groupby("cell")["ts"].min().astype("Int64")
        out["mutations"] = cells.size()
        yield out[[c.split()[0] for c in _ARRIVED.split(", ")]]


class LogCells(StatefulProcessor):
    """The two newest mutations of each cell of a bucket and the time of its first insertion.

    Of equal times the one that arrived in a later batch is the newer one.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cells = handle.getValueState(_CELL, f"cells array<struct<{_fields(_PATH_DDL)}, {_fields(_NEWEST)}>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n = len(PATH)
        held = self.cells.get()
        cells = {c[:n]: c[n:] for c in held[0]} if held else {}
        arrived = {}
        for r in rows:
            arrived.setdefault(r[:n], []).append(r)
        for path, new in arrived.items():
            cells[path] = self._merged(cells.get(path), new)
        self.cells.update(([path + kept for path, kept in cells.items()],))
        return (Row(**dict(zip(PATH, path, strict=True))) for path in arrived)

    def _merged(self, held: tuple | None, rows: list[Row]) -> tuple:
        found, inserted, mutations = [], [], 0
        if held is not None:
            op, value, ts, prev_op, prev_ts, first, mutations = held
            found.append((ts, 0, "1", op, value))
            if prev_op is not None:
                found.append((prev_ts, 0, "0", prev_op, None))
            inserted.append(first)
        for r in rows:
            found.append((r.ts, 1, r.place, r.op, r.value))
            if r.prev_op is not None:
                found.append((r.prev_ts, 1, r.prev_place, r.prev_op, None))
            inserted.append(r.inserted_at)
            mutations += r.mutations
        found.sort(key=lambda m: m[:3], reverse=True)
        ts, _, _, op, value = found[0]
        prev_ts, _, _, prev_op, _ = found[1] if len(found) > 1 else (None,) * 5
        first = min((t for t in inserted if t is not None), default=None)
        return op, value, ts, prev_op, prev_ts, first, mutations

    def close(self) -> None:
        pass


def touched_cells(mutations: DataFrame) -> DataFrame:
    """The streaming paths that a batch of `mutations` touched; what they need is state."""
    if set(FILE_COLUMNS) <= set(mutations.columns):
        place = F.format_string("%020d|%s|%020d|", F.unix_micros("file_time"), "file_path", "file_block")
    else:
        place = F.lit("")
    arrived = mutations.select(*PATH, "op", "value", "ts", "seq", place.alias("place")).mapInPandas(reduce_arrivals, _ARRIVED)
    cells = arrived.select("*", _bucket(*PATH)).groupBy("bucket")
    return cells.transformWithState(LogCells(), _PATH_DDL, "Update", "None")


class Cycle:
    """The queries of one cycle."""

    def __init__(self, *queries: StreamingQuery):
        self.queries = queries

    def awaitTermination(self) -> None:
        for query in self.queries:
            query.awaitTermination()


def run_cycle(mutations: DataFrame, checkpoint: str, base: str) -> Cycle:
    """Take up all mutations that arrived since the last cycle, then stop.

    `mutations` is a streaming DataFrame, such as `split_log` over
    `log_lines(spark.readStream, ...)`. Results are read with `current_changes`; below `base`
    lie the paths each batch touched (`touched`) and the rejected lines, if `mutations` has them.
    """
    spark = mutations.sparkSession
    queries = []
    if "rejected" in mutations.columns:
        lines = mutations.where(F.col("rejected").isNotNull()).select(F.col("rejected").alias("value"))
        sink = lines.writeStream.format("parquet").option("path", f"{base}/rejected")
        queries.append(_start(sink, f"{checkpoint}/rejected"))
        mutations = mutations.where(F.col("rejected").isNull())

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{base}/touched/batch={number}")

    with _rocksdb(spark):
        sink = touched_cells(mutations).writeStream.outputMode("update").foreachBatch(write)
        queries.append(_start(sink, f"{checkpoint}/cells"))
    return Cycle(*queries)


def _start(sink, checkpoint: str) -> StreamingQuery:
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def net_state(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The mutations that decide the changes of all cells: at most three a cell.

    A row has one of them only if it had one.
    """
    state = _state(spark, f"{checkpoint}/cells")
    types = ", ".join(f"{c} {'bigint' if c in ('ts', 'seq') else 'string'}" for c in MUTATION_COLUMNS)
    if state is None:
        return spark.createDataFrame([], types)

    def mutation(op, value, ts, seq: int):
        return F.struct(op.alias("op"), value.cast("string").alias("value"), ts.alias("ts"), F.lit(seq).cast("bigint").alias("seq"))

    newest = mutation(state["op"], state["value"], state["ts"], 2)
    before = F.when(state["prev_op"].isNotNull(), mutation(state["prev_op"], F.lit(None), state["prev_ts"], 1))
    # A third one, unless one of the two is an insertion of that time.
    among = ((state["op"] == INS) & (state["ts"] == state["inserted_at"])) | ((state["prev_op"] == INS) & (state["prev_ts"] == state["inserted_at"]))
    third = state["inserted_at"].isNotNull() & ~F.coalesce(among, F.lit(False))
    first = F.when(third, mutation(F.lit(INS), F.lit(None), state["inserted_at"], 0))
    each = F.explode(F.array_compact(F.array(newest, before, first))).alias("m")
    return state.select(*PATH, each).select(*PATH, "m.*").select(*MUTATION_COLUMNS)


def current_changes(spark: SparkSession, checkpoint: str, mode: str = "classified", scope: str = "row") -> DataFrame:
    """The net changes after all cycles, as `changes_by_log` over the whole log."""
    return changes_by_log(net_state(spark, checkpoint), mode, scope)


def batch_changes(
    spark: SparkSession, checkpoint: str, base: str, number: int, mode: str = "classified", scope: str = "row"
) -> DataFrame:
    """The current changes of the rows that batch `number` touched."""
    try:
        touched = spark.read.schema(_PATH_DDL).parquet(f"{base}/touched/batch={number}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        touched = spark.createDataFrame([], _PATH_DDL)
    rows = F.struct(*ROW_KEYS).alias("row")
    state = net_state(spark, checkpoint).select("*", rows)
    own = state.join(touched.select(rows).distinct(), "row", "left_semi").drop("row")
    return changes_by_log(own, mode, scope)


def rejected_lines(spark: SparkSession, base: str) -> DataFrame:
    """(value): the lines that were no mutations."""
    try:
        return spark.read.schema("value string").parquet(f"{base}/rejected")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "value string")


# --- the tracking table -------------------------------------------------------------------

# What a cell's row in `up_old` came from, by precedence within a window.
_RANK = {UP_OLD: 0, DEL: 1, INS: 2, UP_NEW: 3}
_TRACKED = (
    f"cells array<struct<{_fields(', '.join(f'{c} string' for c in CELL))}, until: bigint, rank: int, value: string, ts: bigint, "
    "pending: array<struct<until: bigint, state: string, ts: bigint, value: string>>>>"
)
_CHANGED = ", ".join(f"{c} {'bigint' if c == 'ts' else 'string'}" for c in CHANGE_COLUMNS) + ", cycle bigint"


class TrackedCells(StatefulProcessor):
    """A bucket of cells of a tracking table, whose windows close as event time passes their ends.

    Pending rows wait for the end of their window, or, if that has passed, of the next one.
    There the newest row of each state is a change, and one of them takes the cell's place in
    `up_old`, dated with the window's end: the update, else the insertion; a deletion alone takes
    it away. Founding rows (`up_old`) take their place when they arrive, unless
    something of the same window or a later one has it.
    """

    def __init__(self, width: int, origin: int, source_table: str | None):
        self.width, self.origin, self.source_table = width, origin, source_table

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getValueState(_CELL, _TRACKED)
        # End of the first window that has something pending: most timers of a batch that closes
        # many windows need not fetch the cells.
        self.waiting = handle.getValueState("waiting", "until bigint")

    def _end(self, ts: int) -> int:
        """End of the window that holds `ts`."""
        return ts - (ts - self.origin) % self.width + self.width

    def _get(self) -> dict[tuple, tuple]:
        """Cell -> (what it has in `up_old`, {(until, state): (ts, value)} of what is pending)."""
        held, n = self.cells.get(), len(CELL)
        cells = {}
        for c in held[0] if held else ():
            old = None if c[n] is None else c[n : n + 4]
            cells[c[:n]] = old, {(until, state): (ts, value) for until, state, ts, value in c[n + 4]}
        return cells

    def _put(self, cells: dict[tuple, tuple]) -> None:
        self.cells.update((
            [
                (*cell, *(old or (None,) * 4), [(until, state, *what) for (until, state), what in sorted(kept.items())])
                for cell, (old, kept) in cells.items()
            ],
        ))
        self.waiting.update((min(self._ends(cells), default=None),))

    def _ends(self, cells: dict[tuple, tuple]) -> set[int]:
        return {until for _, kept in cells.values() for until, _ in kept}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = [r for r in rows if r.at is None]  # the others tell the time and nothing else
        if not rows:
            return iter(())
        cells = self._get()
        timed = self._ends(cells)
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        for r in rows:
            cell = tuple(r[c] for c in CELL)
            old, kept = cells.get(cell) or (None, {})
            until = self._end(r.ts)
            if r.state == UP_OLD:
                new = (until, _RANK[UP_OLD], r.value, r.ts)
                if old is None or (new[:2], r.ts, r.value) > (old[:2], old[3], old[2] or ""):
                    old = new
            else:
                if until <= passed:
                    until = self._end(passed)
                kept[until, r.state] = max(kept.get((until, r.state), (r.ts, r.value)), (r.ts, r.value))
            cells[cell] = old, kept
        for until in self._ends(cells) - timed:
            self.handle.registerTimer(until // 1000)
        self._put(cells)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        (first,) = self.waiting.get() or (None,)
        if first is None or first > now:
            return iter(())
        # All windows that have ended, at the first timer of them.
        now = max(now, timerValues.getCurrentWatermarkInMs() * 1000)
        cells, changed = self._get(), []
        for cell, (old, kept) in cells.items():
            keyspace, table, row_key, column = cell
            for until, state in sorted(k for k in kept if k[0] <= now):  # by window
                ts, value = kept.pop((until, state))
                op = "upd" if state == UP_NEW else state
                changed.append(Row(op=op, keyspace=keyspace, column_family=self.source_table or table, row_key=row_key,
                                   super_column=None, column_name=column, value=value, ts=ts, cycle=until))
                if old is None or (until, _RANK[state]) > old[:2]:
                    old = (until, _RANK[state], None if state == DEL else value, until)
            cells[cell] = old, kept
        self._put(cells)
        return iter(changed)

    def close(self) -> None:
        pass


def run_tracking_cycle(
    arrivals: DataFrame, checkpoint: str, base: str, width: int, origin: int = 0, source_table: str | None = None
) -> Cycle:
    """Take up the tracking rows that arrived, extract and maintain what windows they closed.

    Windows are `width` micros long, counted from `origin`, whole milliseconds both. A window is closed
    by the first row with a time at or after its end. The changes lie in
    `<base>/changes`, by the window's end (`cycle`).
    """
    if width % 1000 or origin % 1000 or width <= 0:
        raise ValueError("windows begin and end at whole milliseconds")
    def newest_of_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            window = (df["ts"] - origin) // width
            last = df.assign(window=window).sort_values(["ts", "value"]).drop_duplicates([*CELL, "state", "window"], keep="last")
            last = last[TRACKING_COLUMNS].assign(at=None)
            # Spark drops rows whose event time has passed, and late rows are to stay. So rows
            # have none but for a copy of the newest one, which moves the clock on.
            clock = last.nlargest(1, "ts")
            yield pd.concat([last, clock.assign(at=clock["ts"])]).astype({"at": "Int64"})

    rows = arrivals.select(*TRACKING_COLUMNS)
    rows = rows.mapInPandas(newest_of_windows, T.StructType([*rows.schema.fields, T.StructField("at", T.LongType())]))
    timed = rows.withColumn("at", F.timestamp_micros("at")).withWatermark("at", "0 seconds")
    cells = timed.select("*", _bucket(*CELL)).groupBy("bucket").transformWithState(
        TrackedCells(width, origin, source_table), _CHANGED, "Append", "EventTime"
    )
    sink = cells.writeStream.outputMode("append").format("parquet").partitionBy("cycle").option("path", f"{base}/changes")
    with _rocksdb(arrivals.sparkSession):
        return Cycle(_start(sink, f"{checkpoint}/tracked"))


def current_tracking(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The whole tracking table: `up_old` and what is pending."""
    state = _state(spark, f"{checkpoint}/tracked")
    if state is None:
        return spark.createDataFrame([], ", ".join(f"{c} {'bigint' if c == 'ts' else 'string'}" for c in TRACKING_COLUMNS))
    old = state.where("rank is not null and rank <> 1").select(*CELL, F.lit(UP_OLD).alias("state"), "value", "ts")
    waiting = state.select(*CELL, F.explode("pending").alias("p")).select(*CELL, "p.state", "p.value", "p.ts")
    return old.select(*TRACKING_COLUMNS).unionByName(waiting.select(*TRACKING_COLUMNS))
