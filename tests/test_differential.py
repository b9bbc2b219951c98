import random

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from cellshift import (
    changes_by_differential,
    flatten_standard,
    load_snapshot,
    parse_snapshot,
    store_snapshot,
)
from cellshift.operators.differential import latest_cells
from cellshift.sources import snapshots
from cellshift.sources.snapshots import (
    load_snapshot_table,
    read_snapshot_text,
    store_snapshot_table,
)
from cellshift.sources.sinks import write_changes


@pytest.fixture
def pair(cells):
    old = cells(
        ("r", "same", "v", 1),
        ("r", "value", "v", 1),
        ("r", "time", "v", 1),
        ("r", "gone", "v", 1),
        ("r", "s", "same", "v", 1),
        ("r", "", "empty", "v", 1),
    )
    new = cells(
        ("r", "same", "v", 1),
        ("r", "value", "w", 1),
        ("r", "time", "v", 2),
        ("r", "added", "n", 3),
        ("r", "s", "same", "v", 1),
        ("r", "t", "same", "v", 1),
        ("r", "empty", "v", 1),
    )
    return old, new


EXPECTED = sorted(
    [
        ("upd", None, "value", "w", 1),
        ("upd", None, "time", "v", 2),
        ("del", None, "gone", "v", 1),
        ("ins", None, "added", "n", 3),
        ("ins", "t", "same", "v", 1),
        # An empty super column is not the same as none.
        ("del", "", "empty", "v", 1),
        ("ins", None, "empty", "v", 1),
    ],
    key=repr,
)
SHOWN = ["op", "super_column", "column_name", "value", "ts"]


@pytest.mark.parametrize("unique", [True, False])
def test_classes(pair, unique):
    assert rows(changes_by_differential(*pair, unique=unique), *SHOWN) == EXPECTED


@pytest.mark.parametrize("ops", [["ins"], ["del"], ["upd"], ["ins", "upd"]])
@pytest.mark.parametrize("unique", [True, False])
def test_selected_classes(pair, ops, unique):
    found = changes_by_differential(*pair, ops=ops, unique=unique)
    assert rows(found, *SHOWN) == [r for r in EXPECTED if r[0] in ops]


def test_unknown_class(pair):
    with pytest.raises(ValueError):
        changes_by_differential(*pair, ops=["upsert"])


def test_nothing_changed(pair):
    old, _ = pair
    assert changes_by_differential(old, old).count() == 0


def test_last_copy_of_a_path_counts(cells):
    old = cells(("r", "c", "a", 1), ("r", "c", "b", 2), ("r", "c", "b", 2))
    new = cells(("r", "c", "b", 2), ("r", "c", "a", 1))
    assert changes_by_differential(old, new).count() == 0
    assert rows(latest_cells(old), "value") == [("b",)]


def test_applying_the_changes_to_the_old_snapshot_gives_the_new(cells):
    rnd = random.Random(7)

    def snapshot():
        paths = [(f"r{i}", rnd.choice([None, "s"]), f"c{j}") for i in range(20) for j in range(5)]
        return {p: (rnd.choice("ab"), rnd.randint(1, 2)) for p in paths if rnd.random() < 0.7}

    old, new = snapshot(), snapshot()
    frames = [cells(*[(*p, *v) for p, v in s.items()]) for s in (old, new)]
    result = dict(old)
    for op, k, s, c, v, ts in rows(
        changes_by_differential(*frames), "op", "row_key", "super_column", "column_name", "value", "ts"
    ):
        if op == "del":
            assert result.pop((k, s, c)) == (v, ts)
        else:
            assert ((k, s, c) in result) == (op == "upd")
            result[(k, s, c)] = (v, ts)
    assert result == new


def test_stored_snapshots(spark, pair, tmp_path):
    base = str(tmp_path / "snapshots")
    for number, snapshot in enumerate(pair):
        store_snapshot(snapshot, base, number)
    store_snapshot(pair[0].limit(1), base, 7)
    store_snapshot(pair[0], base, 7)  # replaces number 7 alone
    assert load_snapshot(spark, base, 7).count() == pair[0].count()
    found = changes_by_differential(load_snapshot(spark, base, 0), load_snapshot(spark, base, 1))
    assert rows(found, *SHOWN) == EXPECTED


def test_missing_snapshot(spark, pair, tmp_path):
    assert load_snapshot(spark, str(tmp_path), 3) is None
    assert load_snapshot_table(spark, "never_stored", 3) is None
    assert changes_by_differential(pair[0], None).collect() == []
    with pytest.raises(ValueError):
        changes_by_differential(None, None)


def test_a_larger_snapshot_has_more_buckets(spark, cells, monkeypatch):
    monkeypatch.setattr(snapshots, "CELLS_PER_BUCKET", 10)
    made = [cells(*[(f"r{i}", "a", str(n), 1) for i in range(n, size)]) for n, size in enumerate((100, 200, 1000))]
    for number, snapshot in enumerate(made):
        store_snapshot_table(snapshot, "grown", number, buckets=4)
    tables = [load_snapshot_table(spark, "grown", n) for n in range(3)]
    # The second one keeps the number of the first, the third is too large to.
    assert [snapshots._buckets_stored(spark, f"grown_{n}") for n in range(3)] == [16, 16, 128]
    assert "Exchange" not in plan(changes_by_differential(*tables[:2], unique=True))
    for n in (0, 1):
        found = changes_by_differential(tables[n], tables[n + 1], unique=True)
        assert rows(found) == rows(changes_by_differential(made[n], made[n + 1], unique=True))


def test_bucketed_snapshots_are_compared_without_a_shuffle(spark, pair):
    for number, snapshot in enumerate(pair):
        store_snapshot_table(snapshot, "snap", number, buckets=4)
    old, new = (load_snapshot_table(spark, "snap", n) for n in (0, 1))
    # The tables are small enough to be broadcast, which is not what is tested.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = changes_by_differential(old, new, unique=True)
        assert rows(found, *SHOWN) == EXPECTED
        assert "Exchange" not in plan(found)
        for op in ("ins", "del", "upd"):
            found = changes_by_differential(old, new, [op], unique=True)
            assert "Exchange" not in plan(found)
            assert rows(found, *SHOWN) == [r for r in EXPECTED if r[0] == op]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_snapshot_text(spark, cells, tmp_path):
    made = cells(
        ("a/b", "c", "two words/and a slash", 12),
        ("r", "s", "c", "tab\there", -3),
    )
    path = str(tmp_path / "text")
    write_changes(made, path, style="snapshot")
    assert rows(read_snapshot_text(spark, path)) == rows(made)
    line = spark.createDataFrame([("ks/data/r/null/c\t5/v w",)], "value string")
    assert rows(parse_snapshot(line)) == [("ks", "data", "r", None, "c", "v w", 5)]


def test_wide_snapshots_are_not_broadcast(spark, tmp_path):
    """Many cells in a small file, in a session with Spark's own broadcast settings."""
    names = [f"c{i}" for i in range(40)]
    wide = spark.range(0, 20_000, 1, 4).select(
        F.col("id").cast("string").alias("k"), *[F.lit("v").alias(n) for n in names], F.lit(5).cast("bigint").alias("t")
    )
    path = str(tmp_path / "wide")
    wide.write.parquet(path)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")}
    for k in before:
        spark.conf.set(k, "10MB")
    try:
        cells = flatten_standard(spark.read.parquet(path), "k", names, "t", keyspace="ks", column_family="data")
        for op in ("ins", "del", "upd"):
            found = changes_by_differential(cells, cells, [op], unique=True)
            assert found.count() == 0
            assert "Broadcast" not in plan(found)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
