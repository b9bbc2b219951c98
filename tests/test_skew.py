"""A third of all rows under one key: the plans must split it or never gather it."""

import pytest
from helpers import plan, rows
from pyspark.sql import functions as F

from cellshift import changes_by_audit, changes_by_differential, changes_by_log
from cellshift.model import CELL_COLUMNS, MUTATION_COLUMNS, MUTATION_SCHEMA
from cellshift.operators import log
from cellshift.streaming.cycles import current_changes, run_cycle

SMALL_PARTITIONS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_partitions(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_PARTITIONS}
    for k, v in SMALL_PARTITIONS.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot_row(spark, tmp_path):
    """60,000 mutations of as many cells, a third of them in row `hot`; every
    hundredth row is deleted, the hot one halfway."""
    n = 60_000
    key = F.when(F.col("id") < n // 3, "hot").otherwise(
        F.concat(F.lit("r"), (F.col("id") % 4000).cast("string"))
    )
    base = spark.range(0, n, 1, 8).select(
        F.lit("ks").alias("keyspace"),
        F.lit("data").alias("column_family"),
        key.alias("row_key"),
        F.lit(None).cast("string").alias("super_column"),
        F.concat(F.lit("c"), F.col("id").cast("string")).alias("column_name"),
        F.lit("ins").alias("op"),
        F.concat(F.lit("v"), F.sha2(F.col("id").cast("string"), 256)).alias("value"),
        F.col("id").alias("ts"),
        F.col("id").alias("seq"),
    )
    deleted = spark.range(0, 4000, 100, 2)
    deletions = deleted.select(
        F.lit("ks").alias("keyspace"),
        F.lit("data").alias("column_family"),
        F.when(F.col("id") == 0, "hot")
        .otherwise(F.concat(F.lit("r"), F.col("id").cast("string")))
        .alias("row_key"),
        *[F.lit(None).cast("string").alias(c) for c in ("super_column", "column_name")],
        F.lit("del").alias("op"),
        F.lit(None).cast("string").alias("value"),
        F.lit(n // 6).cast("bigint").alias("ts"),
        F.lit(n).cast("bigint").alias("seq"),
    )
    path = str(tmp_path / "hot")
    base.unionByName(deletions).select(*MUTATION_COLUMNS).write.parquet(path)
    return spark.read.parquet(path)


def run(df) -> str:
    df.collect()
    return plan(df)


def test_the_partition_of_a_hot_row_is_split(hot_row, small_partitions):
    for df in (
        changes_by_log(hot_row),
        changes_by_log(hot_row, "upsert"),
        log.after_deletion(hot_row),
        log.row_tombstones(hot_row),
    ):
        assert "skew=true" in run(df)


def test_its_result_is_whole(hot_row, small_partitions):
    found = {tuple(r) for r in changes_by_log(hot_row).groupBy("row_key", "op").count().collect()}
    hot = {(op, n) for key, op, n in found if key == "hot"}
    # Cells 0 .. 9,999 were there before the deletion, number 10,000 at its time.
    assert hot == {("del", 10_000), ("ins", 9_999)}
    expected = hot_row.where("row_key != 'hot' and op = 'ins'").count()
    assert sum(n for key, _, n in found if key != "hot") == expected


def hot_path(spark, column_name="c"):
    """30,000 cells; a third are copies of one path."""
    n = 30_000
    name = F.when(F.col("id") < n // 3, "c").otherwise(F.concat(F.lit("c"), F.col("id").cast("string")))
    return spark.range(0, n, 1, 8).select(
        F.lit("ks").alias("keyspace"),
        F.lit("data").alias("column_family"),
        F.lit("r").alias("row_key"),
        F.lit(None).cast("string").alias("super_column"),
        name.alias("column_name"),
        F.concat(F.lit("v"), F.col("id").cast("string")).alias("value"),
        (F.col("id") + 1).alias("ts"),
    ).select(*CELL_COLUMNS)


def test_copies_of_a_path_meet_once(spark):
    old = hot_path(spark)
    new = old.withColumn("ts", F.col("ts") + 1).where("ts != 10001 or column_name = 'c'")
    found = changes_by_differential(old, new)
    assert rows(found.where("column_name = 'c'"), "op", "value", "ts") == [("upd", "v9999", 10001)]
    assert found.count() == 20_001


def test_copies_of_a_cell_and_its_audit_cell_meet_once(spark):
    cells = hot_path(spark)
    audit = cells.withColumns(
        {"column_name": F.concat(F.lit("audit:"), "column_name"), "ts": F.col("ts") - 1}
    )
    found = changes_by_audit(cells.unionByName(audit), 5_000, allow_small=True)
    assert rows(found.where("column_name = 'c'"), "op", "value", "ts") == [("ins", "v9999", 10000)]
    assert found.count() == 20_001


def test_a_hot_row_in_the_history_of_a_stream(spark, hot_row, small_partitions, tmp_path):
    base = str(tmp_path)
    for part in ("ts <= 10000", "ts > 10000"):
        hot_row.where(part).select(*MUTATION_COLUMNS).write.mode("append").parquet(f"{base}/log")
        stream = spark.readStream.schema(MUTATION_SCHEMA).parquet(f"{base}/log")
        run_cycle(stream, f"{base}/checkpoint", f"{base}/out").awaitTermination()
    found = current_changes(spark, f"{base}/checkpoint")
    assert "skew=true" in run(found)
    assert rows(found) == rows(changes_by_log(hot_row))
