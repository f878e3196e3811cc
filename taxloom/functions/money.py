"""Amounts, rates and rounding as Column expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from taxloom import constants as C

AMOUNT = "decimal(24,6)"
MONEY = "decimal(24,2)"


def dec(value) -> Column:
    """A decimal literal that keeps the scale it was written with."""
    return F.lit(Decimal(str(value)))


def round_currency(amount: Column) -> Column:
    """Two places, half away from zero."""
    return F.round(amount, 2).cast(MONEY)


def rate_of(category: Column) -> Column:
    expr = F.lit(None).cast("decimal(5,4)")
    for name, rate in C.RATES.items():
        expr = F.when(category == name, dec(rate).cast("decimal(5,4)")).otherwise(expr)
    return expr


def line_vat(base: Column, category: Column) -> Column:
    return round_currency(base.cast(AMOUNT) * rate_of(category))


def flag_reason(flag: Column) -> Column:
    return (
        F.when(flag == "reverse_charge_import_of_services",
               "Imported services under reverse charge: the amount needs a manual check.")
        .when(flag == "related_party_zero_rating",
              "Zero rate claimed between related parties: confirm before relying on it.")
    )


def grid_key(amount: Column, tolerance) -> Column:
    """Half-even rounding onto the tolerance grid; equality of keys, not distance."""
    tol = Decimal(str(tolerance))
    if tol == 0:
        return amount.cast(AMOUNT)
    # Scaled so the division is exact where the grid is a power of ten and has ample digits otherwise.
    return F.bround((amount.cast("decimal(24,6)") / F.lit(tol)).cast("decimal(38,12)"), 0).cast("decimal(38,0)")


def is_vat_gap(a: Column, b: Column) -> Column:
    """Amounts apart by 15 % of the smaller one, give or take half a point."""
    low, high = F.least(a, b), F.greatest(a, b)
    gap = F.abs(high - low - dec(C.VAT_GAP_RATIO) * low) <= dec(C.VAT_GAP_BAND) * low
    return (low > 0) & gap


def parse_signed(text: Column) -> Column:
    """Text to decimal: everything but digits, dot and minus is dropped; nonsense gives null."""
    return F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("decimal(38,6)").cast(AMOUNT)


def parse_absolute(text: Column) -> Column:
    return F.abs(parse_signed(text))


def row_amount(debit: Column, credit: Column, amount: Column) -> Column:
    """Non-zero debit, else non-zero credit, else the amount column (where zero counts)."""
    zero = F.lit(0)
    return F.coalesce(F.nullif(debit, zero), F.nullif(credit, zero), amount)


def format_amount(amount: Column) -> Column:
    return F.coalesce(F.format_number(amount, 2), F.lit(""))


def format_difference(a: Column, b: Column) -> Column:
    return format_amount(a - b)


def category_rate(text: Column) -> Column:
    """A register's own category text as a rate; zero is tested first, unknown text gives null."""
    t = F.lower(text)
    zero, std = dec("0.00").cast("decimal(5,4)"), dec("0.15").cast("decimal(5,4)")
    return (
        F.when(t.contains("zero") | t.contains("0%"), zero)
        .when(t.contains("exempt"), zero)
        .when(t.contains("standard") | t.contains("15%"), std)
    )


def default_rate(choice: Column) -> Column:
    return F.coalesce(rate_of(choice), dec("0.15").cast("decimal(5,4)"))
