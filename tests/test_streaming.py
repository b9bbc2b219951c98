import random

import pandas as pd
import pytest
from helpers import rows
from pyspark.sql import functions as F
from test_log import random_log

from cellshift import (
    batch_changes,
    changes_by_log,
    current_changes,
    current_tracking,
    log_lines,
    net_state,
    rejected_lines,
    run_cycle,
    run_tracking_cycle,
    split_log,
    write_log,
)
from cellshift.model import MUTATION_COLUMNS, MUTATION_SCHEMA, PATH, TRACKING_SCHEMA
from cellshift.operators.log import reduce_log
from cellshift.streaming import cycles
from cellshift.streaming.cycles import reduce_arrivals

KEPT = ["op", "row_key", "super_column", "column_name", "value", "ts"]
SECOND = 1_000_000


class Log:
    """A folder of mutations that grows, and the query over it, started anew for each part."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, str(folder)

    def add(self, mutations):
        mutations.write.mode("append").parquet(f"{self.folder}/log")
        stream = self.spark.readStream.schema(MUTATION_SCHEMA).parquet(f"{self.folder}/log")
        run_cycle(stream, f"{self.folder}/checkpoint", f"{self.folder}/out").awaitTermination()

    def changes(self, *how):
        return current_changes(self.spark, f"{self.folder}/checkpoint", *how)

    def state(self):
        return net_state(self.spark, f"{self.folder}/checkpoint")


def test_cycles_equal_one_run_over_all_input(spark, mutations, tmp_path):
    made = random_log(21, ["s", "t"])
    path, checkpoint = str(tmp_path / "log"), str(tmp_path / "checkpoint")
    for start in range(0, len(made), 200):
        # Coalesced, so that the lines of a part are read in the order written.
        write_log(mutations(*made[start : start + 200]).coalesce(1), path, is_super=True)
        stream = split_log(log_lines(spark.readStream, path), is_super=True)
        run_cycle(stream, checkpoint, str(tmp_path / "out")).awaitTermination()
    # Text has no null: a written cell without a value reads as an empty one.
    for scope in ("super", "row"):
        found = current_changes(spark, checkpoint, scope=scope)
        expected = changes_by_log(mutations(*made), scope=scope)
        assert rows(found, *KEPT) == rows(expected, *KEPT)


def test_parts_in_any_order(spark, mutations, tmp_path):
    """Equal times are told apart by the part, then by the number in it."""
    made = random_log(8, [None, "s"])
    random.Random(1).shuffle(made)
    log = Log(spark, tmp_path)
    half = len(made) // 2
    for part in (made[:half], made[half:]):
        log.add(mutations(*part))
    numbered = [(*m[:-1], m[-1] + (1_000_000 if i >= half else 0)) for i, m in enumerate(made)]
    for mode in ("classified", "upsert"):
        assert rows(log.changes(mode)) == rows(changes_by_log(mutations(*numbered), mode))


def test_only_what_a_cell_needs_is_state(spark, mutations, tmp_path):
    """Three mutations of a cell that was written 1500 times."""
    log = Log(spark, tmp_path)
    for number in range(3):
        log.add(mutations(*[("r", None, "a", "ins", str(i), 1000 * number + i, i) for i in range(500)]))
    assert log.state().count() == 3
    assert rows(log.changes(), "op", "value", "ts") == [("upd", "499", 2499)]


def test_a_hot_cell_is_reduced_before_the_shuffle(mutations):
    made = [(f"r{i % 3}", None, "a", "ins" if i % 5 else "del", str(i), i // 7, i) for i in range(1000)]
    df = mutations(*made).select(*MUTATION_COLUMNS).toPandas().assign(place="")
    found = pd.concat(reduce_arrivals(iter([df[:600].copy(), df[600:].copy()])))
    assert len(found) == 6  # three cells in two batches
    assert found["mutations"].sum() == 1000
    last = found[(found.row_key == "r0")].iloc[-1]
    assert (last.value, last.ts, last.prev_ts) == ("999", 142, 142)


def test_a_cycle_without_news_and_an_empty_log(spark, mutations, tmp_path):
    log = Log(spark, tmp_path)
    assert rows(log.changes()) == [] and rows(log.state()) == []
    log.add(mutations(("r", None, "a", "ins", "1", 1, 0)))
    log.add(mutations(("r", None, "a", "ins", "1", 1, 0)).where("false"))
    assert rows(log.changes(), "op", "value") == [("ins", "1")]


def test_the_changes_of_a_batch(spark, mutations, tmp_path):
    log = Log(spark, tmp_path)
    log.add(mutations(("r", None, "a", "ins", "1", 1, 0), ("r", None, "b", "ins", "1", 1, 1), ("x", None, "a", "ins", "1", 1, 2)))
    log.add(mutations(("r", None, "a", "ins", "2", 2, 0)))
    found = batch_changes(spark, f"{tmp_path}/checkpoint", f"{tmp_path}/out", 1)
    assert rows(found, "row_key", "column_name", "op", "value") == [("r", "a", "upd", "2"), ("r", "b", "ins", "1")]
    assert rows(batch_changes(spark, f"{tmp_path}/checkpoint", f"{tmp_path}/out", 9)) == []


def test_the_reduced_log_has_the_same_changes(spark, mutations):
    for seed in range(4):
        log = mutations(*random_log(seed, [None, "s", "t"]))
        for mode in ("classified", "upsert"):
            for scope in ("row", "super"):
                found = changes_by_log(reduce_log(log), mode, scope)
                assert rows(found) == rows(changes_by_log(log, mode, scope))


def test_rejected_lines_are_kept(spark, mutations, tmp_path):
    path, out = str(tmp_path / "log"), str(tmp_path / "out")
    assert rows(rejected_lines(spark, out)) == []
    write_log(mutations(("r", None, "a", "ins", "1", 5, 0)), path)
    bad = ["[ks][r][1]", "no line"]
    spark.createDataFrame([(x,) for x in bad], "value string").write.mode("append").text(path)
    stream = split_log(log_lines(spark.readStream, path))
    run_cycle(stream, str(tmp_path / "cp"), out).awaitTermination()
    assert rows(rejected_lines(spark, out)) == sorted((x,) for x in bad)
    assert rows(current_changes(spark, str(tmp_path / "cp")), "op", "value") == [("ins", "1")]


def test_a_later_deletion_clears_earlier_results(spark, mutations, tmp_path):
    log = Log(spark, tmp_path)
    log.add(mutations(("r", None, "a", "ins", "1", 1, 0)))
    assert log.changes("upsert").count() == 1
    log.add(mutations(("r", None, None, "del", None, 2, 0)))
    assert log.changes("upsert").count() == 0


class Tracked:
    def __init__(self, spark, folder, width=10 * SECOND):
        self.spark, self.folder, self.width = spark, str(folder), width

    def add(self, arrivals):
        arrivals.coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        stream = self.spark.readStream.schema(TRACKING_SCHEMA).parquet(f"{self.folder}/in")
        run_tracking_cycle(stream, f"{self.folder}/cp", f"{self.folder}/out", self.width, source_table="data").awaitTermination()

    def table(self):
        found = current_tracking(self.spark, f"{self.folder}/cp").withColumn("ts", F.col("ts") / SECOND)
        return rows(found, "row_key", "state", "column_name", "value", "ts")

    def changes(self):
        found = self.spark.read.parquet(f"{self.folder}/out/changes")
        found = found.withColumn("cycle", (F.col("cycle") / SECOND).cast("int"))
        return rows(found, "cycle", "op", "column_family", "column_name", "value")


def test_tracking_cycles(spark, tracking, tmp_path):
    t = Tracked(spark, tmp_path)
    s = SECOND
    t.add(tracking(("r", "ins", "a", "1", 5 * s), ("r", "ins", "b", "1", 5 * s), ("r", "up_old", "z", "0", s)))
    # Nothing came at 10 seconds or later: the first window is open.
    assert t.table() == [("r", "ins", "a", "1", 5), ("r", "ins", "b", "1", 5), ("r", "up_old", "z", "0", 1)]
    t.add(tracking(("r", "up_new", "a", "2", 11 * s), ("r", "up_new", "a", "3", 12 * s), ("r", "del", "b", "1", 13 * s)))
    assert t.changes() == [(10, "ins", "data", "a", "1"), (10, "ins", "data", "b", "1")]
    t.add(tracking(("r", "ins", "c", "1", 25 * s)))
    assert t.changes()[2:] == [(20, "del", "data", "b", "1"), (20, "upd", "data", "a", "3")]
    assert t.table() == [("r", "ins", "c", "1", 25), ("r", "up_old", "a", "3", 20), ("r", "up_old", "z", "0", 1)]


def test_late_and_founding_rows(spark, tracking, tmp_path):
    t = Tracked(spark, tmp_path)
    s = SECOND
    t.add(tracking(("r", "ins", "a", "1", 5 * s), ("r", "ins", "x", "x", 31 * s)))
    t.add(tracking(("r", "up_new", "a", "late", 6 * s), ("r", "up_old", "a", "old", 7 * s), ("r", "up_old", "n", "new", 8 * s)))
    # The late row waits for the end of the window that is open now; founding rows are there at once,
    # unless the cell has had a later change.
    assert t.table() == [
        ("r", "ins", "x", "x", 31), ("r", "up_new", "a", "late", 6), ("r", "up_old", "a", "1", 10), ("r", "up_old", "n", "new", 8),
    ]
    t.add(tracking(("r", "up_old", "a", "refreshed", 44 * s)))
    assert t.table() == [("r", "up_old", "a", "refreshed", 44), ("r", "up_old", "n", "new", 8), ("r", "up_old", "x", "x", 40)]
    assert t.changes() == [(10, "ins", "data", "a", "1"), (40, "ins", "data", "x", "x"), (40, "upd", "data", "a", "late")]


def test_a_deleted_cell_stays_away_from_older_founding_rows(spark, tracking, tmp_path):
    t = Tracked(spark, tmp_path)
    s = SECOND
    t.add(tracking(("r", "up_old", "a", "0", s), ("r", "del", "a", "0", 12 * s)))
    t.add(tracking(("r", "ins", "b", "1", 25 * s)))
    t.add(tracking(("r", "up_old", "a", "older", 15 * s)))
    assert t.table() == [("r", "ins", "b", "1", 25)]
    with pytest.raises(ValueError):
        Tracked(spark, tmp_path / "x", width=1500).add(tracking(("r", "ins", "b", "1", 25 * s)))


def test_paths_of_the_state(spark, mutations, tmp_path):
    log = Log(spark, tmp_path)
    log.add(mutations(("r", None, "a", "ins", None, 1, 0), ("r", "s", None, "del", None, 2, 1)))
    assert rows(log.state(), *PATH[2:], "op", "value") == [("r", "s", None, "del", None), ("r", None, "a", "ins", None)]


def test_cells_share_a_key_of_the_state(spark, mutations, tracking, tmp_path, monkeypatch):
    """Two keys for 60 cells; what belongs to one cell does not touch the others."""
    monkeypatch.setattr(cycles, "BUCKETS", 2)
    made = [(f"r{i % 20}", None, "abc"[i // 20 % 3], "del" if i % 7 == 0 else "ins", str(i), i % 5, i) for i in range(180)]
    log = Log(spark, tmp_path / "log")
    for part in (made[:100], made[100:]):
        log.add(mutations(*part))
    assert rows(log.changes()) == rows(changes_by_log(mutations(*made)))
    keys = spark.read.format("statestore").option("stateVarName", "cell")
    assert keys.load(f"{tmp_path}/log/checkpoint/cells").count() == 2
    t = Tracked(spark, tmp_path / "tracking")
    t.add(tracking(*[(f"r{i}", "ins", "a", str(i), (i % 4 * 10 + 5) * SECOND) for i in range(40)]))
    t.add(tracking(("x", "up_old", "a", "0", 61 * SECOND)))
    assert t.changes() == sorted([(i % 4 * 10 + 10, "ins", "data", "a", str(i)) for i in range(40)], key=repr)
    assert len(t.table()) == 41 and keys.load(f"{tmp_path}/tracking/cp/tracked").count() == 2
