"""JSON payloads: invoice lines in, calculation results in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taxloom import constants as C
from taxloom.functions.money import AMOUNT

_LINES = "array<struct<line_id:string,description:string,taxable_base:string,tax_category:string,flag:string>>"
RESULT = ("struct<lines:array<struct<line_id:string,description:string,taxable_base:decimal(24,6),tax_category:string,"
          "rate:decimal(5,4),vat_amount:decimal(24,2),flagged_for_manual_review:boolean,flag_reason:string>>,"
          "subtotal:decimal(24,6),total_vat:decimal(24,2),grand_total:decimal(24,6),currency:string,has_flagged_lines:boolean>")


def parse_lines(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``invoice_id, payload`` to (lines, rejects). One bad line rejects its invoice, with the first reason."""
    parsed = payloads.withColumn("items", F.from_json("payload", _LINES))
    checked = F.transform("items", lambda li, i: F.struct(
        F.coalesce(li["line_id"], i.cast("string")).alias("line_id"), F.coalesce(li["description"], F.lit("")).alias("description"),
        li["taxable_base"].try_cast(AMOUNT).alias("taxable_base"), li["tax_category"].alias("tax_category"),
        F.nullif(li["flag"], F.lit("")).alias("flag"),
        F.when(~F.coalesce(li["tax_category"].isin(*C.CATEGORIES), F.lit(False)), F.concat(F.lit("line "), i.cast("string"), F.lit(": unknown tax category")))
        .when((li["flag"] != "") & ~li["flag"].isin(*C.CALCULATION_FLAGS), F.concat(F.lit("line "), i.cast("string"), F.lit(": unknown flag")))
        .when(li["taxable_base"].try_cast(AMOUNT).isNull(), F.concat(F.lit("line "), i.cast("string"), F.lit(": amount is not a number")))
        .alias("problem")))
    staged = parsed.withColumn("checked", checked).withColumn("reason", F.when(
        F.coalesce(F.size("items"), F.lit(0)) <= 0, "no lines").otherwise(
        F.get(F.filter(F.transform("checked", lambda c: c["problem"]), lambda p: p.isNotNull()), 0)))
    good = staged.filter(F.col("reason").isNull()).select("invoice_id", F.inline("checked")).drop("problem")
    return good, staged.filter(F.col("reason").isNotNull()).select("invoice_id", "payload", "reason")


def results_to_json(lines: DataFrame, totals: DataFrame) -> DataFrame:
    """One JSON text per invoice (its lines and totals)."""
    fields = ["line_id", "description", "taxable_base", "tax_category", "rate", "vat_amount", "flagged_for_manual_review", "flag_reason"]
    packed = lines.groupBy("invoice_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("lines"))
    whole = F.struct("lines", "subtotal", "total_vat", "grand_total", "currency", "has_flagged_lines")
    return totals.join(packed, "invoice_id").select("invoice_id", F.to_json(whole).alias("payload"))


def results_from_json(payloads: DataFrame) -> DataFrame:
    """The stored result as it was; nothing is recomputed."""
    return payloads.select("invoice_id", F.from_json("payload", RESULT).alias("r")).select("invoice_id", "r.*")
