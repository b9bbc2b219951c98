"""Instants: everything inside the engine is micros since 1970 as BIGINT."""

from __future__ import annotations

import time
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F, types as T

MIN_MICROS = 100_000_000_000_000  # 1973; smaller values are seconds or millis


def new_cycle() -> int:
    """A stamp for the cycle that starts now."""
    return time.time_ns() // 1000


def check_cycle(cycle: int, allow_small: bool = False) -> int:
    """Reject stamps in another unit: `ts > last_cycle` would hold for every cell."""
    if cycle < 0 or (0 < cycle < MIN_MICROS and not allow_small):
        raise ValueError(f"{cycle} is not an instant in microseconds")
    return cycle


def micros(df: DataFrame, name: str) -> Column:
    """Column `name` as micros; BIGINT is taken to be micros already."""
    dtype = df.schema[name].dataType
    c = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):
        if df.sparkSession.conf.get("spark.sql.session.timeZone") == "UTC":
            return F.unix_micros(c.cast("timestamp"))
        # A cast would shift by the session time zone: build it from the fields.
        seconds = F.unix_date(c.cast("date")) * 86400 + F.hour(c) * 3600 + F.minute(c) * 60
        fraction = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
        return seconds.cast("bigint") * 1_000_000 + fraction
    return c.cast("bigint")


def after(df: DataFrame, name: str, cycle: int) -> Column:
    """`name > cycle`, stated in the column's own type so that the scan can use it."""
    dtype = df.schema[name].dataType
    instant = datetime(1970, 1, 1) + timedelta(microseconds=cycle)
    c = F.col("`" + name.replace("`", "``") + "`")
    if isinstance(dtype, T.TimestampType):
        return c > F.lit(instant.replace(tzinfo=timezone.utc))
    if isinstance(dtype, T.TimestampNTZType):
        text = instant.isoformat(sep=" ", timespec="microseconds")
        return c > F.expr(f"timestamp_ntz'{text}'")
    return c > F.lit(cycle)
