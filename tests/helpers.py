import datetime as dt
from decimal import Decimal

ROWS = ("row_id string, ordinal bigint, source string, reference string, date date, "
        "amount decimal(24,6), description string")


def row(row_id, amount, ref=None, day=None, desc=None, ordinal=None):
    """A reconciliation row; the id's first letter is its side, its digits the default ordinal."""
    side = row_id[0]
    number = int("".join(c for c in row_id if c.isdigit()) or 0)
    when = dt.date(2024, 1, 1) + dt.timedelta(days=day) if day is not None else None
    return (row_id, number if ordinal is None else ordinal, side, ref, when, Decimal(str(amount)), desc)


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def kinds(items):
    return sorted(r["kind"] for r in items.select("kind").collect())
