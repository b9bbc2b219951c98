import pytest
from helpers import rows
from pyspark.sql import functions as F

from cellshift import bootstrap_audit, changes_by_audit, changes_by_audit_wide
from cellshift.functions.cells import split_audit_name

L = 100

# (effective, audit, class) around the cycle; None is an absent cell.
BOUNDARY = [
    (150, 50, "upd"),
    (150, 150, "ins"),
    (150, 120, "ins"),
    (150, 100, None),
    (150, 151, None),
    (100, 50, None),
    (99, 99, None),
    (150, None, "upd"),
    (None, 150, None),
]


@pytest.mark.parametrize("super_column", [None, "s"])
def test_classes_at_the_boundary(cells, super_column):
    made, expected = [], []
    for i, (e, a, op) in enumerate(BOUNDARY):
        if e is not None:
            made.append((f"r{i}", super_column, "c", f"v{i}", e))
        if a is not None:
            made.append((f"r{i}", super_column, "audit:c", "old", a))
        if op is not None:
            expected.append((op, f"r{i}", super_column, "c", f"v{i}", e))
    found = changes_by_audit(cells(*made), L, allow_small=True)
    assert rows(found, "op", "row_key", "super_column", "column_name", "value", "ts") == sorted(
        expected, key=repr
    )


def test_the_boundary_class_can_be_chosen(cells):
    made = cells(("r", "c", "v", 150), ("r", "audit:c", "x", 100))
    found = changes_by_audit(made, L, boundary="upd", allow_small=True)
    assert rows(found, "op", "value") == [("upd", "v")]


def test_only_the_first_colon_splits_a_name(cells):
    found = split_audit_name(cells(("r", "audit:a:b", "v", 1), ("r", "x:audit:", "v", 1)))
    assert rows(found, "column_name", "is_audit") == [("a:b", True), ("x:audit:", False)]


def test_a_value_that_looks_like_an_audit_value_is_only_a_value(cells):
    found = changes_by_audit(cells(("r", "c", "audit:v-1", 150)), L, allow_small=True)
    assert rows(found, "op", "value") == [("upd", "audit:v-1")]


def test_bootstrap(cells):
    found = bootstrap_audit(cells(("r", "a", "v", 100), ("r", "s", "b", "w", 101)), 100)
    assert rows(found, "super_column", "column_name", "value", "ts") == sorted(
        [
            (None, "a", "v", 100),
            (None, "audit:a", "100", 100),
            ("s", "b", "w", 101),
            ("s", "audit:b", "101", -800),
        ],
        key=repr,
    )


def test_newer_cells_are_updates_after_a_bootstrap(cells):
    made = bootstrap_audit(cells(("r", "a", "v", 100), ("r", "b", "w", 101)), 100)
    assert rows(changes_by_audit(made, 100, allow_small=True), "op", "column_name") == [("upd", "b")]


def test_wide_rows_give_the_same_classes_without_a_shuffle(spark, cells):
    base = 1_000_000_000_000_000
    wide, made = [], []
    for i, (e, a, _) in enumerate(BOUNDARY):
        value = f"v{i}" if e is not None else None
        wide.append((f"r{i}", value, base + (e or 0), None if a is None else base + a))
        if e is not None:
            made.append((f"r{i}", "c", value, base + e))
        if a is not None:
            made.append((f"r{i}", "audit:c", "x", base + a))
    df = spark.createDataFrame(wide, "id string, v string, t bigint, a bigint")
    columns = {"c": (F.col("v"), "t", F.col("a"))}
    found = changes_by_audit_wide(
        df, "id", columns, base + L, keyspace="ks", column_family="data"
    )
    assert rows(found) == rows(changes_by_audit(cells(*made), base + L))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
