"""Column expressions on names, flags and encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellshift.model import AUDIT_PREFIX, DEL, INS, SYSTEM_KEYSPACES

# Bits of the serialization flag of a logged column.
FLAG_INSERTION = 0
FLAG_DELETION = 1
FLAG_EXPIRATION = 2
FLAG_COUNTER = 4
FLAG_COUNTER_UPDATE = 8


def split_audit_name(df: DataFrame) -> DataFrame:
    """`audit:<col>` becomes (`<col>`, is_audit); only the first `:` counts."""
    is_audit = F.col("column_name").startswith(AUDIT_PREFIX)
    base = F.substring("column_name", len(AUDIT_PREFIX) + 1, 2**31 - 1)
    return df.withColumns(
        {
            "is_audit": is_audit,
            "column_name": F.when(is_audit, base).otherwise(F.col("column_name")),
        }
    )


def op_from_flag(flag: Column) -> Column:
    """Operation of a serialization flag; null for counters and expiring cells."""
    special = FLAG_EXPIRATION | FLAG_COUNTER | FLAG_COUNTER_UPDATE
    return F.when(flag == FLAG_DELETION, DEL).when(flag.bitwiseAND(special) == 0, INS)


def ops_from_flags(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split on column `flag` into (rows with `op`, rejected rows with their flag)."""
    tagged = df.withColumn("op", op_from_flag(F.col("flag")))
    accepted = tagged.where(F.col("op").isNotNull()).drop("flag")
    return accepted, tagged.where(F.col("op").isNull()).drop("op")


def drop_system(df: DataFrame) -> DataFrame:
    """Leave out the store's own keyspaces and rows whose keyspace is unknown."""
    keyspace = F.col("keyspace")
    return df.where(keyspace.isNotNull() & ~keyspace.isin(*SYSTEM_KEYSPACES))


def hex_to_string(hexed: Column) -> Column:
    """One character per byte; an odd last digit is dropped."""
    length = F.length(hexed)
    even = F.substring(hexed, F.lit(1), (length - length % 2).cast("int"))
    return F.decode(F.unhex(even), "ISO-8859-1")
