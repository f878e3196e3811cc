"""Range joins as equi-joins on buckets.

A nested-loop join compares every row with every row. Here one side looks up the one or two buckets
its range touches and the other side sits in exactly one bucket, so each qualifying pair meets once.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

SCALE = 1_000_000  # six decimal places as whole numbers


def units(amount: Column) -> Column:
    """Amount in millionths as a long; an amount beyond 9.2 trillion raises instead of wrapping."""
    return (amount.cast("decimal(24,6)") * F.lit(SCALE)).cast("bigint")


def tolerance_units(tolerance) -> int:
    value = Decimal(str(tolerance)) * SCALE
    if value < 0 or value != int(value):
        raise ValueError(f"tolerance must be >= 0 with at most six decimals: {tolerance}")
    return int(value)


def bucket(value: Column, width: int) -> Column:
    """Floor division of whole numbers, also below zero, without passing through doubles."""
    if width == 1:
        return value
    exact = value - F.pmod(value, F.lit(width).cast("bigint"))
    return F.call_function("div", exact, F.lit(width).cast("bigint"))


def bucket_range(low: Column, high: Column, width: int) -> Column:
    return F.sequence(bucket(low, width), bucket(high, width))


def day_number(date: Column) -> Column:
    return F.unix_date(date).cast("bigint")
