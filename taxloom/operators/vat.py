"""VAT per line, per invoice, and against printed totals.

Lines: ``invoice_id, line_id, description, taxable_base, tax_category[, flag]``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taxloom import constants as C
from taxloom.functions import money as M


def calculate_lines(lines: DataFrame) -> DataFrame:
    """Rate and VAT of every line; a flag keeps the number and adds a reason."""
    if "flag" not in lines.columns:
        lines = lines.withColumn("flag", F.lit(None).cast("string"))
    return lines.withColumns({
        "taxable_base": F.col("taxable_base").cast(M.AMOUNT),
        "rate": M.rate_of(F.col("tax_category")),
        "vat_amount": M.line_vat(F.col("taxable_base"), F.col("tax_category")),
        "flagged_for_manual_review": F.col("flag").isNotNull(),
        "flag_reason": M.flag_reason(F.col("flag")),
    })


def invoice_totals(lines: DataFrame, key: str = "invoice_id", currency: str = C.CURRENCY) -> DataFrame:
    """Subtotal, VAT (sum of already rounded line VAT) and grand total per invoice.

    Only numbers are aggregated, so the map side combines before the one shuffle on the invoice key.
    """
    calc = calculate_lines(lines)
    return (
        calc.groupBy(key).agg(
            F.sum("taxable_base").cast(M.AMOUNT).alias("subtotal"),
            F.sum("vat_amount").cast(M.MONEY).alias("total_vat"),
            F.bool_or("flagged_for_manual_review").alias("has_flagged_lines"),
            F.count(F.lit(1)).alias("line_count"),
        )
        .withColumn("grand_total", (F.col("subtotal") + F.col("total_vat")).cast(M.AMOUNT))
        .withColumn("currency", F.lit(currency))
    )


def significant(document_value: Column, recalculated: Column, tolerance) -> Column:
    """Further apart than the tolerance; a value that cannot be read counts as significant."""
    return F.coalesce(F.abs(document_value - recalculated) > M.dec(tolerance), F.lit(True))


def validate_totals(totals: DataFrame, printed: DataFrame, key: str = "invoice_id",
                    tolerance=C.MISMATCH_TOLERANCE) -> DataFrame:
    """Printed against recalculated figures: one row per field that differs at two places.

    ``printed``: key, total_vat, grand_total. A figure that is not printed is not compared.
    """
    joined = totals.select(key, F.col("total_vat").alias("calc_vat"), F.col("grand_total").alias("calc_total")).join(
        printed.select(key, F.col("total_vat").alias("doc_vat"), F.col("grand_total").alias("doc_total")), key)
    fields = F.array(
        F.struct(F.lit("total_vat").alias("field"), F.col("doc_vat").cast(M.AMOUNT).alias("document_value"),
                 F.col("calc_vat").cast(M.AMOUNT).alias("recalculated_value")),
        F.struct(F.lit("grand_total").alias("field"), F.col("doc_total").cast(M.AMOUNT).alias("document_value"),
                 F.col("calc_total").cast(M.AMOUNT).alias("recalculated_value")),
    )
    return (
        joined.select(key, F.inline(fields))
        .filter(F.round("document_value", 2) != F.round("recalculated_value", 2))
        .withColumn("within_tolerance", ~significant(F.col("document_value"), F.col("recalculated_value"), tolerance))
    )


def split_classifications(proposed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Proposed categories (line_id, tax_category, confidence) split into usable and rejected ones."""
    ok = F.coalesce(F.col("tax_category").isin(*C.CATEGORIES), F.lit(False))
    valid = proposed.filter(ok)
    invalid = proposed.filter(~ok).withColumn(
        "reason", F.concat(F.lit("not a tax category: "), F.coalesce("tax_category", F.lit("(none)"))))
    return valid, invalid
