from helpers import plan, rows

from cellshift import (
    bootstrap_tracking,
    changes_by_tracking,
    create_tracking,
    maintain_tracking,
)
from cellshift.sources.tables import load_tracking, write_tracking

SHOWN = ["state", "column_name", "value", "ts"]


def test_bootstrap(cells):
    made = cells(("r", "a", "v", 100), ("r", "s", "b", "w", 101))
    assert rows(bootstrap_tracking(made, 100), *SHOWN) == [
        ("up_new", "s/b", "w", 101),
        ("up_old", "a", "v", 100),
        ("up_old", "s/b", "w", 101),
    ]
    assert rows(bootstrap_tracking(made, only_old=True), *SHOWN) == [
        ("up_old", "a", "v", 100),
        ("up_old", "s/b", "w", 101),
    ]


def test_states_become_operations(tracking):
    made = tracking(
        ("r", "up_old", "a", "1", 5),
        ("r", "up_new", "a", "2", 6),
        ("r", "ins", "b", "3", 6),
        ("r", "del", "c", "4", 6),
    )
    found = changes_by_tracking(made)
    assert rows(found, "op", "column_family", "column_name", "value") == [
        ("del", "track", "c", "4"),
        ("ins", "track", "b", "3"),
        ("upd", "track", "a", "2"),
    ]
    assert rows(changes_by_tracking(made, "data"), "column_family") == [("data",)] * 3


def test_both_ends_of_the_window_are_outside(tracking):
    made = tracking(*[("r", "ins", f"c{ts}", "v", ts) for ts in (10, 11, 19, 20)])
    found = changes_by_tracking(made, window=(10, 20))
    assert rows(found, "column_name") == [("c11",), ("c19",)]


def test_repeated_rows(tracking):
    made = tracking(("r", "ins", "a", "1", 5), ("r", "ins", "a", "2", 6), ("r", "ins", "a", "3", 30))
    found = changes_by_tracking(made, window=(0, 20), unique=False)
    assert rows(found, "value") == [("2",)]


def test_maintenance(tracking):
    made = tracking(
        ("r", "up_old", "updated", "1", 1),
        ("r", "up_new", "updated", "2", 11),
        ("r", "ins", "inserted", "3", 11),
        ("r", "up_old", "deleted", "4", 1),
        ("r", "del", "deleted", "4", 11),
        ("r", "up_old", "both", "5", 1),
        ("r", "up_new", "both", "6", 11),
        ("r", "ins", "both", "7", 12),
        ("r", "del", "both", "8", 13),
        ("r", "up_old", "kept", "9", 11),
        ("r", "up_old", "later", "10", 1),
        ("r", "up_new", "later", "11", 20),
        ("other", "up_old", "deleted", "12", 1),
    )
    expected = sorted(
        [
            ("r", "up_old", "updated", "2", 99),
            ("r", "up_old", "inserted", "3", 99),
            ("r", "up_old", "both", "6", 99),
            ("r", "up_old", "kept", "9", 11),
            ("r", "up_old", "later", "10", 1),
            ("r", "up_new", "later", "11", 20),
            ("other", "up_old", "deleted", "12", 1),
        ],
        key=repr,
    )
    once = maintain_tracking(made, (10, 20), 99)
    assert rows(once, "row_key", *SHOWN) == expected
    assert rows(maintain_tracking(once, (10, 20), 120), "row_key", *SHOWN) == expected


def test_stored_versions_prune_the_old_section(spark, tracking, tmp_path):
    path = str(tmp_path / "v0")
    create_tracking(spark, path)
    assert load_tracking(spark, path).count() == 0
    made = tracking(("r", "up_old", "a", "1", 5), ("r", "ins", "b", "2", 6))
    write_tracking(made, path)
    stored = load_tracking(spark, path)
    assert rows(stored) == rows(made)
    assert "PartitionFilters: [state" in plan(changes_by_tracking(stored))
