import pytest
from helpers import rows

from cellshift import (
    append_changes,
    changes_by_scan,
    create_cell_table,
    cycle_window,
    extract_cycle,
    planned_cycle,
    read_cycle,
    save_cycle,
    sort_by_key,
    write_changes,
)
from cellshift.model import CELL_COLUMNS, as_changes
from cellshift.session import shared_dir

T0 = 1_700_000_000_000_000


def test_cycles_are_saved_and_read(spark, tmp_path):
    path = str(tmp_path / "cycle")
    assert read_cycle(spark, None, default=3) == 3
    assert read_cycle(spark, path) == 0
    save_cycle(spark, path, T0)
    assert read_cycle(spark, path) == T0
    save_cycle(spark, path, T0 - 5)  # the last one saved counts, not the greatest
    assert read_cycle(spark, path) == T0 - 5


def test_a_window_is_saved_only_after_success(spark, tmp_path):
    path = str(tmp_path / "cycle")
    with pytest.raises(RuntimeError):
        with cycle_window(spark, path, T0):
            raise RuntimeError
    assert read_cycle(spark, path) == 0
    with cycle_window(spark, path, T0) as window:
        assert window == (0, T0)
    with cycle_window(spark, path) as (last, now):
        assert last == T0 < now


def test_a_failed_window_is_run_again_as_planned(spark, cells, tmp_path):
    state, out = str(tmp_path / "cycle"), str(tmp_path / "out")
    there = cells(("a", "c", "v", T0 - 1), ("b", "c", "v", T0 + 1))

    def extract(last, until):
        return changes_by_scan(there, last, until=until)

    def lost(last, until):
        append_changes(extract(last, until), out, until)
        raise RuntimeError  # between append and save

    for later in (0, 5, 10):
        with pytest.raises(RuntimeError):
            extract_cycle(spark, state, out, lost, now=T0 + later)
        assert read_cycle(spark, state) == 0
        assert planned_cycle(spark, state) == T0
    assert extract_cycle(spark, state, out, extract, now=T0 + 20) == T0
    assert planned_cycle(spark, state) is None
    assert extract_cycle(spark, state, out, extract, now=T0 + 20) == T0 + 20
    assert rows(spark.read.parquet(out), "row_key", "cycle") == [("a", T0), ("b", T0 + 20)]


def test_a_plan_belongs_to_the_cycle_it_follows(spark, tmp_path):
    path = str(tmp_path / "cycle")
    with pytest.raises(RuntimeError):
        with cycle_window(spark, path, T0):
            raise RuntimeError
    save_cycle(spark, path, T0 - 7)  # set by hand: the plan is void
    assert planned_cycle(spark, path) is None
    with cycle_window(spark, path, T0 + 1) as window:
        assert window == (T0 - 7, T0 + 1)


def test_results_accumulate_and_a_repeated_cycle_replaces_itself(spark, cells, tmp_path):
    path = str(tmp_path / "out")
    first, second = (as_changes(cells(("r", c, "v", 1)), "ins") for c in "ab")
    append_changes(first, path, 1)
    append_changes(first, path, 2)
    append_changes(second, path, 2)
    assert rows(spark.read.parquet(path), "cycle", "column_name") == [(1, "a"), (2, "b")]
    text = str(tmp_path / "text")
    append_changes(first, text, 1, style="tracking")
    append_changes(second, text, 2, style="tracking")
    assert rows(spark.read.text(text), "value") == [("ins/ks/data/r/a:v",), ("ins/ks/data/r/b:v",)]


def test_overwriting_sink(spark, cells, tmp_path):
    path = str(tmp_path / "out")
    for column in "ab":
        write_changes(as_changes(cells(("r", column, "v", 1)), "ins"), path)
    assert rows(spark.read.parquet(path), "column_name") == [("b",)]
    write_changes(as_changes(cells(("r", "c", "v", 1)), "ins"), path, style="change")
    assert rows(spark.read.text(path)) == [("ins/ks/data/r/null/c\tv",)]


def test_sorted_output(spark):
    frame = spark.createDataFrame([(c,) for c in "cab"], "key string")
    assert [r[0] for r in sort_by_key(frame).collect()] == ["a", "b", "c"]


def test_cell_tables(spark, cells):
    create_cell_table(spark, "ks1", "data", "data_super")
    table = spark.table("ks1.data")
    assert table.columns == CELL_COLUMNS and table.count() == 0
    cells(("r", "c", "v", 1)).write.mode("append").insertInto("ks1.data")
    create_cell_table(spark, "ks1", "data")
    assert spark.table("ks1.data").count() == 0
    create_cell_table(spark, "ks1", "data", drop_keyspace=True)
    assert not spark.catalog.tableExists("ks1.data_super")


def test_the_shared_folder_is_the_one_the_session_names(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
