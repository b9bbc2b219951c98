import pytest
from helpers import files_read, plan, rows

from cellshift import append_by_time, changes_by_scan, load_by_time, scan_by_time


def made(cells, start, n):
    return cells(*[(f"r{i % 7}", f"c{i}", f"v{i}", start + i) for i in range(n)])


@pytest.mark.parametrize("last, until", [(0, None), (55, None), (99, 140), (100, 100), (149, 500), (10**6, None)])
def test_the_same_as_a_scan_of_all(spark, cells, tmp_path, last, until):
    path = str(tmp_path / "cells")
    parts = [made(cells, 0, 150), made(cells, 40, 100)]  # the second part comes late
    for part in parts:
        append_by_time(part, path, 10)
    expected = changes_by_scan(parts[0].unionByName(parts[1]), last, allow_small=True, until=None)
    if until is not None:
        expected = expected.where(f"ts <= {until}")
    found = load_by_time(spark, path, last, until, 10)
    assert rows(found) == rows(expected.drop("op"))
    assert rows(scan_by_time(spark, path, last, width=10, allow_small=True).drop("op")) == rows(
        changes_by_scan(parts[0].unionByName(parts[1]), last, allow_small=True).drop("op"))


def test_older_periods_are_not_read(spark, cells, tmp_path):
    path = str(tmp_path / "cells")
    append_by_time(made(cells, 0, 1000), path, 10)
    found = scan_by_time(spark, path, 974, width=10, allow_small=True)
    assert found.count() == 25
    assert files_read(found) == 3 < 100 <= files_read(load_by_time(spark, path, width=10))
    assert "GreaterThan(ts,974)" in plan(found)  # row groups, in the first of the three


def test_instants_before_1970(spark, cells, tmp_path):
    path = str(tmp_path / "cells")
    append_by_time(made(cells, -25, 50), path, 10)
    assert {r.ts for r in load_by_time(spark, path, -11, 3, 10).collect()} == set(range(-10, 4))
    assert load_by_time(spark, str(tmp_path / "none")).count() == 0
