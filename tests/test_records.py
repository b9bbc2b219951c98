"""Texts that hold what separates them: log records over several lines, and exports."""

import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from cellshift import changes_by_log, export_cells, log_records, merge_exports, parse_export, parse_log, read_log, run_cycle, write_log
from cellshift import current_changes, split_log
from cellshift.sources.tombstones import rejected_export_lines

PIECES = ["\n", "\r", "]\n[", "][", "]", "[", "\x1b", "a", "é", "]\n", "\n[", "\n\x1b", "[ks][r][1][data][true][5][6][0]", "/", ":"]


def wild(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(9))) for _ in range(n)]


@pytest.mark.parametrize("is_super", [False, True])
@pytest.mark.parametrize("split", [40, 300, 1 << 20])
def test_any_value_comes_back_over_any_splits(spark, mutations, tmp_path, split, is_super):
    values = wild(split, 300)
    made = mutations(*[(f"r{i}", "s" if is_super else None, "c", "ins", v, i, i) for i, v in enumerate(values)])
    write_log(made.repartition(3), str(tmp_path), is_super, escape=True)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        found = read_log(spark, str(tmp_path), is_super, escaped=True)
        columns = [c for c in made.columns if c != "seq"]
        assert rows(found, *columns) == rows(made, *columns)
        if split == 40:
            assert log_records(spark.read, str(tmp_path)).rdd.getNumPartitions() > 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_raw_values_with_line_breaks(spark, mutations, tmp_path):
    """As a trigger writes them: no marks."""
    values = ["one\ntwo", "\n", "a\r\nb", "][\n]", "x]", "", "\x1b\n\x1b["]
    made = mutations(*[(f"r{i}", None, "c", "ins", v, i, i) for i, v in enumerate(values)], ("d", None, None, "del", None, 9, 9))
    write_log(made.coalesce(1), str(tmp_path))
    assert rows(read_log(spark, str(tmp_path), escaped=False), "row_key", "value", "ts") == rows(made, "row_key", "value", "ts")


def test_a_stream_of_records(spark, mutations, tmp_path):
    log = str(tmp_path / "log")
    parts = [[("r", None, "a", "ins", "1\n[", 1, 0)], [("r", None, "a", "ins", "]\n[\n2", 2, 1), ("r", None, "b", "ins", "\n", 2, 2)]]
    for part in parts:
        write_log(mutations(*part), log, escape=True)
        stream = split_log(log_records(spark.readStream, log, escaped=True))
        run_cycle(stream, str(tmp_path / "cp"), str(tmp_path / "out")).awaitTermination()
    expected = changes_by_log(mutations(*parts[0], *parts[1]))
    assert rows(current_changes(spark, str(tmp_path / "cp"))) == rows(expected)


def test_an_empty_log(spark, tmp_path):
    spark.createDataFrame([], "value string").write.text(str(tmp_path / "log"))
    assert parse_log(log_records(spark.read, str(tmp_path / "log"))).count() == 0


EXPORTED = "keyspace string, column_family string, row_key string, super_column string, column_name string, value string, ts bigint, is_deleted boolean, deleted_at bigint, super_deleted_at bigint"


@pytest.fixture
def entries(spark):
    """entries((key, super, column, value, ts, is_deleted, super_deleted_at), ...)"""

    def make(*given):
        full = [("ks", "data", k, s, c, v, ts, gone, ts if gone else None, at) for k, s, c, v, ts, gone, at in given]
        return spark.createDataFrame(full, EXPORTED)

    return make


def test_the_export_is_read_back(entries):
    values = [v for v in wild(3, 60)] + ["null", "x/1/true:y", "a/b/-9/c/5/false:z", "5:null", "/7:null"]
    given = []
    for i, v in enumerate(values):
        given.append((f"r/{i}:x", None, f"c:{i}", v, i - 5, i % 3 == 0, None))
        given.append((f"r/{i}", f"s:{i}", f"c{i}", v, i - 5, i % 3 == 1, None))
    given.append(("r", "gone", "c", "v", 3, False, 77))
    given.append(("r", "gone", "d", "v", 3, False, 78))
    found = parse_export(export_cells(entries(*given)))
    expected = [(k, s, c, None if gone else v, ts, gone, None) for k, s, c, v, ts, gone, _ in given[:-2]]
    expected.append(("r", "gone", None, None, None, True, 78))
    assert rows(found) == sorted(expected, key=repr)


def test_lines_of_no_shape(spark):
    lines = spark.createDataFrame([("st/r/c/5/maybe:v",), ("xx",), ("su/r/s/5:v",), ("st/r/c/5/false:v",)], "line string")
    assert rows(rejected_export_lines(lines)) == [("st/r/c/5/maybe:v",), ("su/r/s/5:v",), ("xx",)]
    assert rows(parse_export(lines), "value") == [("v",)]


def test_dumps_are_reconciled(spark, entries):
    dumps = [
        entries(("r", None, "a", "1", 1, False, None), ("r", None, "b", "1", 9, False, None), ("k", "s", "x", "1", 5, False, None),
                ("k", "s", "y", "1", 8, False, None), ("k", "t", "x", "1", 5, False, None)),
        entries(("r", None, "a", "2", 2, False, None), ("r", None, "b", "0", 9, True, None), ("k", "s", "x", "1", 5, False, 5)),
        entries(("r", None, "a", "0", 1, True, None), ("r", None, "c", "0", 3, True, None), ("r", None, "c", "new", 4, False, None)),
    ]
    lines = export_cells(dumps[0])
    for dump in dumps[1:]:
        lines = lines.unionByName(export_cells(dump))
    found = merge_exports(parse_export(lines), "ks", "data")
    assert rows(found, "row_key", "super_column", "column_name", "value") == [
        ("k", "s", "y", "1"), ("k", "t", "x", "1"), ("r", None, "a", "2"), ("r", None, "c", "new"),
    ]
    assert rows(merge_exports(parse_export(lines.where("false")), "ks", "data")) == []
    hot = spark.range(3000).select(F.lit("su/hot/s/-9223372036854775808/c").alias("h"), (F.col("id") % 7).alias("c"), "id")
    lines = hot.select(F.concat("h", "c", F.lit("/"), "id", F.lit("/false:v"), "id").alias("line"))
    assert rows(merge_exports(parse_export(lines), "ks", "data"), "ts") == [(n,) for n in range(2993, 3000)]
