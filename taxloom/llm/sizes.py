"""Sizes of stored tables, which decide between a broadcast and a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: A table of at most this many bytes as measured by Spark is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8 << 20


def stored_bytes(df: DataFrame) -> int:
    """The size that Spark knows for a table that was written and read back."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES else df
