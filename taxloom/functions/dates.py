"""Date parsing. Text that is not a date gives null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# After ISO: day-first forms, then month-first where day-first cannot be read. Each format is tried only on
# text of its shape, because a failed parse costs far more than a pattern test.
_FORMATS = (
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"), (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"), (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^\d{8}$", "yyyyMMdd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"), (r"^[A-Za-z]{4,} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy"), (r"^\d{1,2}-\d{1,2}-\d{2}$", "d-M-yy"), (r"^\d{1,2}\.\d{1,2}\.\d{2}$", "d.M.yy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{2}$", "d MMM yy"), (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"), (r"^\d{1,2}-\d{1,2}-\d{2}$", "M-d-yy"),
)


def iso_date(text: Column) -> Column:
    head = F.substring(F.trim(text), 1, 10)
    return F.when(head.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(head, "yyyy-MM-dd"))


def ledger_date(text: Column) -> Column:
    """A date as people write it. A time behind it is left off, and dashes, commas and dots around a month's name count as spaces."""
    t = F.regexp_replace(F.trim(text), r"[ T]+\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?( ?[AaPp][Mm]|Z)?$", "")
    named = F.trim(F.regexp_replace(t, r"[-,. ]+", " "))
    t = F.when(t.rlike("[A-Za-z]"), F.initcap(named)).otherwise(t)
    return F.coalesce(iso_date(t), *[F.when(t.rlike(shape), F.try_to_date(t, fmt)) for shape, fmt in _FORMATS])
