"""Snapshots with digests, so that a comparison reads only what differs.

Cells are dealt over buckets by their path and stored with a folder for each bucket. Beside
them stands a tree of digests: a leaf for each bucket, and above it nodes for
`FANOUT` children each, up to one root. A digest is made of sums, so that it does not depend on the
order of the cells and a parent's is the sum of its children's: the number of cells, and
the sums of two independent 64-bit hashes of path, value and time, as unbounded numbers. Two
buckets with equal digests hold equal cells but for an accident of one in 2**128.

A comparison walks down from the root, a level at a time, below nodes that differ, and
then joins the buckets that differ; the folders of the others are not listed for reading.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cellshift.model import CELL_COLUMNS, CELL_SCHEMA, PATH
from cellshift.operators.differential import changes_by_differential

BUCKETS = 4096
FANOUT = 16
_DIGEST = ["cells", "first", "second"]
_NODES = "level int, node bigint, cells bigint, first decimal(38,0), second decimal(38,0)"


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*PATH), F.lit(buckets)).cast("int")


def _levels(buckets: int) -> int:
    """Levels of the tree, the leaves and the root among them."""
    levels = 1
    while buckets > 1:
        buckets, levels = -(-buckets // FANOUT), levels + 1
    return levels


def _cells(spark: SparkSession, base: str, number: int) -> DataFrame:
    schema = T.StructType([*CELL_SCHEMA.fields, T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(f"{base}/cells/snapshot={number}")


def store_digest_snapshot(cells: DataFrame, base: str, number: int, buckets: int = BUCKETS) -> None:
    """Write snapshot `number` and its digests; an earlier one of that number is replaced.

    The digests are those of the cells as stored, and written last: a snapshot without them
    is not there. They cost one scan of it and a shuffle of `buckets` rows per task.
    """
    spark = cells.sparkSession
    write = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    write(spark.createDataFrame([], _NODES)).parquet(f"{base}/digests/snapshot={number}")
    dealt = cells.select(*CELL_COLUMNS, _bucket(buckets).alias("bucket")).hint("rebalance", "bucket")
    write(dealt).partitionBy("bucket").parquet(f"{base}/cells/snapshot={number}")
    hashes = [F.xxhash64(*seed, *CELL_COLUMNS).cast("decimal(20,0)") for seed in ([], [F.lit(1)])]
    leaves = _cells(spark, base, number).groupBy("bucket").agg(
        F.count("*").alias("cells"),
        *[F.sum(h).cast("decimal(38,0)").alias(name) for h, name in zip(hashes, _DIGEST[1:], strict=True)],
    )
    level = F.explode(F.sequence(F.lit(0), F.lit(_levels(buckets) - 1)))
    node = F.expr(f"bucket div cast(pow({FANOUT}, level) as bigint)")
    nodes = leaves.withColumn("level", level).withColumn("node", node).groupBy("level", "node")
    tree = nodes.agg(*[F.sum(c).cast("decimal(38,0)" if c != "cells" else "bigint").alias(c) for c in _DIGEST])
    write(tree.hint("rebalance")).parquet(f"{base}/digests/snapshot={number}")


def load_digest_snapshot(spark: SparkSession, base: str, number: int) -> DataFrame | None:
    """The cells of snapshot `number`, or None when it was never stored."""
    return None if _tree(spark, base, number) is None else _cells(spark, base, number).select(*CELL_COLUMNS)


def read_buckets(spark: SparkSession, base: str, number: int, buckets: Collection[int]) -> DataFrame:
    """The cells of snapshot `number` in some buckets; the files of others are not opened."""
    return _cells(spark, base, number).where(F.col("bucket").isin(*buckets)).select(*CELL_COLUMNS)


def _tree(spark: SparkSession, base: str, number: int) -> DataFrame | None:
    try:
        tree = spark.read.schema(_NODES).parquet(f"{base}/digests/snapshot={number}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return tree


def differing_buckets(spark: SparkSession, base: str, old: int, new: int) -> list[int]:
    """The buckets of which the digests differ: no more numbers than there are buckets.

    Both snapshots must have been stored with the same number of buckets.
    """
    trees = [_tree(spark, base, n) for n in (old, new)]
    depths = [t.agg(F.max("level")).first()[0] for t in trees]
    if None not in depths and depths[0] != depths[1]:
        raise ValueError("the snapshots were stored with different numbers of buckets")
    depth = max(d for d in (*depths, 0) if d is not None)
    below: list[int] | None = None
    for level in range(depth, -1, -1):
        o, n = (t.where(F.col("level") == level) for t in trees)
        if below is not None:
            o, n = (t.where(F.expr(f"node div {FANOUT}").isin(below)) for t in (o, n))
        digest = F.struct(*_DIGEST).alias("digest")
        o, n = o.select("node", digest).alias("o"), n.select("node", digest).alias("n")
        both = o.join(n, "node", "full_outer").where(~F.col("o.digest").eqNullSafe(F.col("n.digest")))
        below = sorted(r[0] for r in both.select("node").collect())
        if not below:
            break
    return below or []


def changes_by_digests(
    spark: SparkSession,
    base: str,
    old: int,
    new: int,
    ops: Collection[str] | None = None,
    unique: bool = False,
) -> DataFrame:
    """`changes_by_differential` of two stored snapshots, reading the buckets that differ."""
    if any(load_digest_snapshot(spark, base, n) is None for n in (old, new)):
        return changes_by_differential(None, spark.createDataFrame([], CELL_SCHEMA), ops, unique)
    buckets = differing_buckets(spark, base, old, new)
    sides = [read_buckets(spark, base, n, buckets) for n in (old, new)]
    return changes_by_differential(*sides, ops, unique)
