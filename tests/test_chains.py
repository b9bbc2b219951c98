import random

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from cellshift import changes_by_differential, changes_by_scan
from cellshift.sources import chains
from cellshift.sources.chains import chain, compact, load_chained, store_changes, store_delta, store_full


def dump(seed, n=400):
    rng = random.Random(seed)
    return [(f"r{i % 17}", rng.choice([None, "s"]), f"c{i}", rng.choice("xy"), rng.randrange(9)) for i in range(n) if rng.random() < 0.8]


def test_a_chain_of_differentials_equals_the_dumps(spark, cells, tmp_path):
    path = str(tmp_path)
    dumps = [cells(*dump(n)).dropDuplicates(["row_key", "super_column", "column_name"]).cache() for n in range(6)]
    store_full(dumps[0], path, 0)
    for n in range(1, 6):
        changes = changes_by_differential(dumps[n - 1], dumps[n], unique=True)
        store_delta(changes.where("op <> 'del'"), path, n, changes.where("op = 'del'"))
        if n == 3:
            compact(spark, path, n)
    assert [chain(spark, path, n) for n in (0, 2, 3, 5)] == [[0], [0, 1, 2], [3], [3, 4, 5]]
    for n in range(6):
        assert rows(load_chained(spark, path, n)) == rows(dumps[n])


def test_a_scan_as_delta(spark, cells, tmp_path):
    path = str(tmp_path)
    store_full(cells(("r", "a", "1", 5), ("r", "b", "1", 5)), path, 1)
    now = cells(("r", "a", "2", 7), ("r", "a", "3", 8), ("r", "b", "1", 5), ("r", "c", "1", 9))
    store_delta(changes_by_scan(now, 5, allow_small=True), path, 2)
    assert rows(load_chained(spark, path, 2), "column_name", "value") == [("a", "3"), ("b", "1"), ("c", "1")]


def test_the_last_delta_counts_not_the_last_time(spark, cells, tmp_path):
    """A cell that is deleted and written again with an earlier time is there."""
    path = str(tmp_path)
    store_full(cells(("r", "a", "1", 5)), path, 1)
    store_delta(cells().where("false"), path, 2, cells(("r", "a", "1", 5)))
    assert rows(load_chained(spark, path, 2)) == []
    store_delta(cells(("r", "a", "0", 3)), path, 3, cells(("r", "a", "1", 5)))
    assert rows(load_chained(spark, path, 3), "value", "ts") == [("0", 3)]
    store_delta(cells(("r", "a", "9", 9)), path, 3)  # stored again
    assert rows(load_chained(spark, path, 3), "value", "ts") == [("9", 9)]


def test_what_was_not_stored(spark, cells, tmp_path):
    path = str(tmp_path)
    assert load_chained(spark, path, 1) is None
    store_delta(cells(("r", "a", "1", 5)), path, 1)
    assert load_chained(spark, path, 1) is None  # no dump below it
    store_full(cells(("r", "a", "1", 5)), path, 2)
    assert load_chained(spark, path, 3) is None
    with pytest.raises(ValueError):
        compact(spark, path, 3)


def test_the_dump_is_not_shuffled_for_a_small_delta(spark, cells, tmp_path, monkeypatch):
    path = str(tmp_path)
    store_full(cells(*dump(1)), path, 1)
    store_delta(cells(("r0", "c0", "new", 99)), path, 2)
    found = load_chained(spark, path, 2)
    assert "BroadcastHashJoin" in plan(found)
    monkeypatch.setattr(chains, "BROADCAST_CELLS", 0)
    large = load_chained(spark, path, 2)
    assert "BroadcastHashJoin" not in plan(large)
    assert rows(large) == rows(found)


def test_changes_are_stored_in_one_pass(spark, cells, tmp_path):
    """The same delta as from both kinds of changes apart, shuffled once; a path in both is there."""
    old, new = cells(("r", "a", "1", 5), ("r", "b", "1", 5)), cells(("r", "b", "2", 6), ("r", "c", "1", 7))
    changes = changes_by_differential(old, new, unique=True)
    both = changes.unionByName(changes.where("column_name = 'b'").withColumn("op", F.lit("del")))
    for n, found in ((1, changes), (2, both)):
        store_full(old, f"{tmp_path}/{n}", 1)
        store_changes(found, f"{tmp_path}/{n}", 2)
        assert rows(load_chained(spark, f"{tmp_path}/{n}", 2)) == rows(new)
        assert "Window" not in plan(load_chained(spark, f"{tmp_path}/{n}", 2))
