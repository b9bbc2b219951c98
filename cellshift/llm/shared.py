"""Folders all executors see, row keys that need no numbering, and size checks."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after it was counted and has no more rows than this.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`, or where it is unset a folder of the warehouse.

    The warehouse is the one other place that a session shares with its executors.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    return (named or spark.conf.get("spark.sql.warehouse.dir") + "/_steps").rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """df, written as Parquet to the shared folder and read from there.

    Cuts the lineage: a lost executor costs no more than the step it was in. Shuffle
    files of the finished step are freed as soon as the driver's garbage is collected,
    so that is asked for, once the listeners have let go of the step.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    time.sleep(0.5)
    spark.sparkContext._jvm.System.gc()
    step = spark.read.schema(df.schema).parquet(path)
    step.step_path = path
    return step


def discard(*steps: DataFrame) -> None:
    """Delete what `materialise` wrote for steps that nothing will read any more."""
    for step in steps:
        context = step.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(step.step_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def keyed(df: DataFrame, id_column: str, text_column: str, keep: list[str] = ()) -> DataFrame:
    """(k1, k2, id, text, *keep): a key made of what the row holds.

    Equal rows share a key and get equal results, so a join on it is right for repeated
    rows, repeated ids and null ids alike, however the input is split or read again.
    Null texts become empty ones.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return df.select(
        F.xxhash64(F.col(id_column), F.lit(1)).alias("k1"),
        F.xxhash64(F.lit(2), text).alias("k2"),
        F.col(id_column).alias("id"),
        text.alias("text"),
        *keep,
    )


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows; else Spark shuffles it.

    df should be cheap to count, such as a materialised table.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged. lower() alone would change É as well."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, upper, upper.lower())
    )
