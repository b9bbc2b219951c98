"""Every registered query against its SQL on the smallest test tables."""

import duckdb
import pytest
from helpers import SF, plan, rows

import __spark_entry__ as driver
from cellshift.plans import catalog, oracle

TABLES = ["orders", "events", "customer", "lineitem"]
QUERIES, SQL = catalog.QUERIES, oracle.ORACLE_SQL


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    result = duck.execute(SQL[name])
    columns = sorted(d[0] for d in result.description)
    assert sorted(frame.columns) == columns
    order = [[d[0] for d in result.description].index(c) for c in columns]
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    assert expected, "the query should have something to find"
    assert rows(frame, *columns) == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0


# Exchanges without broadcasts; what is not listed needs none.
SHUFFLES = {
    "differential": 2,
    "differential_super": 2,
    "differential_dedup": 1,
    "diff_inserts": 2,
    "diff_deletes": 2,
    "diff_updates": 2,
    "audit_changes": 1,
    "log_latest": 1,
    "log_net_changes": 1,
    "log_changes_upsert": 4,
    "log_changes_classified": 5,
    "scan_standard": 0,
    "scan_super": 0,
    "audit_changes_wide": 0,
    "audit_bootstrap": 0,
    "tracking_bootstrap": 0,
    "tracking_window": 1,
    "parse_log_text": 0,
    "flatten_super": 0,
}


@pytest.mark.parametrize("name", sorted(SHUFFLES))
def test_shuffles(spark, name):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        text = plan(QUERIES[name](spark, SF))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert text.count("Exchange ") == SHUFFLES[name], text
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_the_scan_reads_what_it_needs(spark):
    text = plan(QUERIES["scan_standard"](spark, SF))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in text
    text = plan(QUERIES["slice_columns"](spark, SF)).split("data_super")[0]
    assert "o_orderpriority" not in text and "o_custkey" not in text
