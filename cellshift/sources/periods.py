"""Cell tables clustered by write time, for scans that read what was written since.

Cells lie in a folder for each period of their write time, and within a file in the order of
time. A scan after an instant leaves out the folders of older periods before any file is
opened, and in the others the row groups whose bounds, kept by Parquet, lie before
it. Cells that come late are appended to the period of their time, so a table is not rewritten.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cellshift.functions.cycles import check_cycle
from cellshift.model import CELL_COLUMNS, CELL_SCHEMA
from cellshift.operators.scan import changes_by_scan

DAY = 86_400_000_000
PERIOD = "period"
_STORED = T.StructType([*CELL_SCHEMA.fields, T.StructField(PERIOD, T.LongType())])


def append_by_time(cells: DataFrame, path: str, width: int = DAY) -> None:
    """Add cells to the table at `path`, whose periods are `width` micros long.

    A period that holds very many cells is written by several tasks, each of which has its own
    range of time; small ones are written by one.
    """
    # Rounded down, also before 1970.
    period = F.expr(f"(ts - pmod(ts, {width})) div {width}").cast("bigint")
    dealt = cells.select(*CELL_COLUMNS, period.alias(PERIOD)).repartitionByRange(PERIOD, "ts")
    dealt.sortWithinPartitions(PERIOD, "ts").write.mode("append").partitionBy(PERIOD).parquet(path)


def load_by_time(spark: SparkSession, path: str, after: int | None = None, until: int | None = None, width: int = DAY) -> DataFrame:
    """The cells written after `after` and up to `until`; empty if nothing was stored."""
    try:
        cells = spark.read.schema(_STORED).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CELL_SCHEMA)
    if after is not None:
        cells = cells.where((F.col(PERIOD) >= after // width) & (F.col("ts") > after))
    if until is not None:
        cells = cells.where((F.col(PERIOD) <= until // width) & (F.col("ts") <= until))
    return cells.select(*CELL_COLUMNS)


def scan_by_time(
    spark: SparkSession, path: str, last_cycle: int, until: int | None = None, width: int = DAY, allow_small: bool = False
) -> DataFrame:
    """`changes_by_scan` of the table at `path`, reading the periods of the window."""
    check_cycle(last_cycle, allow_small)
    return changes_by_scan(load_by_time(spark, path, last_cycle, until, width), last_cycle, allow_small, until)
