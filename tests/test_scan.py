import datetime

import pytest
from helpers import rows
from pyspark.sql import functions as F, types as T

from cellshift import changes_by_scan, column_names, flatten_standard, flatten_super
from cellshift.functions.cycles import check_cycle, micros, new_cycle
from cellshift.sources.cells import flatten_map

L = 1_500_000_000_000_000
NAMES = {"keyspace": "ks", "column_family": "data"}


def test_a_cell_written_at_the_cycle_is_not_new(cells):
    found = changes_by_scan(cells(("r", "a", "1", L), ("r", "b", "2", L + 1)), L)
    assert rows(found, "op", "column_name", "value") == [("upsert", "b", "2")]


def test_cycles_in_another_unit_are_refused(cells):
    with pytest.raises(ValueError):
        changes_by_scan(cells(("r", "a", "1", L)), 1_400_000_000_000)
    assert changes_by_scan(cells(("r", "a", "1", L)), 5, allow_small=True).count() == 1
    assert check_cycle(0) == 0
    assert check_cycle(new_cycle()) > L


def test_column_names():
    assert column_names("field", 3) == ["field0", "field1", "field2"]
    assert column_names("field", 0) == []


def test_absent_values_give_no_cell(spark):
    df = spark.createDataFrame(
        [(1, "x", None, 7), (2, None, "y", 8)], "id int, a string, b string, ts bigint"
    )
    cells = flatten_standard(df, "id", ["a", "b"], "ts", **NAMES)
    assert rows(cells, "row_key", "column_name", "value", "ts") == [
        ("1", "a", "x", 7),
        ("2", "b", "y", 8),
    ]


def test_times_per_column(spark):
    df = spark.createDataFrame([(1, "x", "y", 7, 8)], "id int, a string, b string, t bigint, u bigint")
    cells = flatten_standard(df, "id", ["a", "b"], {"a": "t", "b": "u"}, since=7, **NAMES)
    assert rows(cells, "column_name", "ts") == [("b", 8)]


def test_map_and_super_rows(spark):
    schema = "id int, m map<string, struct<value: string, ts: bigint>>"
    flat = spark.createDataFrame([(1, {"a": ("x", 1), "b": (None, 2)})], schema)
    assert rows(flatten_map(flat, "id", "m", **NAMES), "column_name", "value") == [("a", "x")]
    nested = flat.select("id", F.create_map(F.lit("s0"), "m", F.lit("s1"), "m").alias("m"))
    supers = flatten_super(nested, "id", "m", **NAMES, super_columns=["s1", "s2"])
    assert rows(supers, "super_column", "column_name", "value", "ts") == [("s1", "a", "x", 1)]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_micros_do_not_depend_on_the_session_zone(spark, zone):
    instant = datetime.datetime(2024, 3, 10, 7, 30, 1, 234567)  # in a clock change
    schema = T.StructType([T.StructField("t", T.TimestampNTZType())])
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(instant,)], schema)
        got = df.select(micros(df, "t")).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == (instant - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
