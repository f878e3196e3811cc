"""Invoice check: rules, recomputed VAT against printed totals, clean or flagged.

Invoices: ``filename, seller struct, buyer struct, issue_date string, line_items array<struct<line_id,
description,taxable_base,tax_category_code,vat_amount>>, totals struct[, extraction_error string]``.

An invoice is one row, so everything but the category suggestions is computed inside the row: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taxloom import constants as C
from taxloom.functions import money as M
from taxloom.operators import structure as S
from taxloom.operators.vat import significant

MISMATCH = ("struct<field:string,document_value:decimal(24,6),recalculated_value:decimal(24,6),"
            "within_tolerance:boolean>")
FINDINGS = "array<struct<part:string,pos:int,severity:string,what:string,text:string>>"


def mapped_category(code: Column) -> Column:
    expr = F.lit(None).cast("string")
    for ubl, category in C.UBL_CODE_TO_CATEGORY.items():
        expr = F.when(code == ubl, category).otherwise(expr)
    return expr


def resolve_categories(invoices: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Adds ``lines``: line items with a tax category (own code, else a suggestion, else standard).

    The usable ``suggestions(filename, line_id, tax_category)`` of an invoice are one map, looked up inside the row, so the
    invoices are read once.
    """
    suggested = F.lit(None).cast("map<string,string>")
    if suggestions is not None:
        named = F.col("filename").isNotNull() & F.col("line_id").isNotNull()
        wanted = suggestions.filter(named & F.col("tax_category").isin(*C.CATEGORIES)).groupBy("filename", "line_id").agg(
            F.max("tax_category").alias("tax_category"))
        per_invoice = wanted.groupBy("filename").agg(
            F.map_from_entries(F.collect_list(F.struct("line_id", "tax_category"))).alias("suggested"))
        invoices = invoices.join(per_invoice, "filename", "left")
        suggested = F.col("suggested")
    lines = F.transform("line_items", lambda li: F.struct(
        li["line_id"].alias("line_id"), li["description"].alias("description"),
        li["taxable_base"].cast("string").try_cast(M.AMOUNT).alias("taxable_base"),
        F.coalesce(mapped_category(li["tax_category_code"]), F.try_element_at(suggested, li["line_id"]),
                   F.lit("standard")).alias("tax_category"),
    ))
    return invoices.withColumn("lines", lines).drop("suggested")


def category_resolution(invoices: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    return resolve_categories(invoices, suggestions).select("filename", F.inline("lines"))


def _recalculated(lines: Column) -> tuple[Column, Column]:
    zero = F.lit(0).cast("decimal(34,6)")
    base = F.aggregate(lines, zero, lambda acc, li: (acc + li["taxable_base"]).cast("decimal(34,6)"))
    vat = F.aggregate(lines, zero, lambda acc, li: (
        acc + M.line_vat(li["taxable_base"], li["tax_category"])).cast("decimal(34,6)"))
    return base.cast(M.AMOUNT), vat.cast(M.AMOUNT)


def check_invoices(invoices: DataFrame, as_of, suggestions: DataFrame | None = None,
                   tolerance=C.MISMATCH_TOLERANCE) -> DataFrame:
    """One row per invoice: status, extracted summary, issues, mismatches."""
    if "extraction_error" not in invoices.columns:
        invoices = invoices.withColumn("extraction_error", F.lit(None).cast("string"))
    resolved = resolve_categories(invoices, suggestions)
    has_lines = F.coalesce(F.size("lines") > 0, F.lit(False))
    unusable = F.exists("lines", lambda li: li["taxable_base"].isNull())
    failed = F.col("extraction_error").isNotNull()
    doc_vat = F.col("totals.tax_amount").cast("string").try_cast(M.AMOUNT)
    doc_total = F.col("totals.tax_inclusive_amount").cast("string").try_cast(M.AMOUNT)

    own = S.collect(
        S.when_issue(~has_lines, "not_readable_as_invoice", None, "error", "No line items were found."),
        S.when_issue(has_lines & doc_vat.isNull() & doc_total.isNull(), "no_printed_totals", None, "warning",
                     "No printed totals to compare with."),
        S.when_issue(has_lines & unusable, "calculation_failed", None, "error", "A line amount is not a number."),
    )
    issues = F.when(failed, S.collect(S.issue("extraction_failed", None, "error", F.col("extraction_error")))).otherwise(
        F.concat(S.extracted_issues(as_of), own))

    base, vat = _recalculated(F.col("lines"))
    staged = resolved.select(
        "*", issues.alias("structural_issues"),
        F.when(has_lines & ~unusable & ~failed, base).alias("subtotal"),
        F.when(has_lines & ~unusable & ~failed, vat).alias("total_vat"),
    ).withColumn("grand_total", (F.col("subtotal") + F.col("total_vat")).cast(M.AMOUNT))

    def mismatch(field: str, printed: Column, calc: Column) -> Column:
        return F.when(F.round(printed, 2) != F.round(calc, 2), F.struct(
            F.lit(field).alias("field"), printed.alias("document_value"), calc.alias("recalculated_value"),
            (~significant(printed, calc, tolerance)).alias("within_tolerance")))

    mismatches = F.filter(F.array(mismatch("total_vat", doc_vat, F.col("total_vat")),
                                  mismatch("grand_total", doc_total, F.col("grand_total"))),
                          lambda m: m.isNotNull()).cast(f"array<{MISMATCH}>")
    checked = staged.withColumn("mismatches", mismatches)
    flagged = F.exists("structural_issues", lambda i: i["severity"] == "error") | F.exists(
        "mismatches", lambda m: ~m["within_tolerance"])
    return checked.select(
        "filename", F.when(flagged, "flagged").otherwise("clean").alias("status"),
        F.struct(
            F.col("seller.name").alias("seller_name"), F.col("seller.vat_number").alias("seller_vat_number"),
            F.col("buyer.name").alias("buyer_name"), "issue_date",
            F.col("totals.tax_exclusive_amount").alias("tax_exclusive_amount"),
            F.col("totals.tax_amount").alias("tax_amount"),
            F.col("totals.tax_inclusive_amount").alias("tax_inclusive_amount"),
        ).alias("extracted"),
        "structural_issues", "mismatches", "subtotal", "total_vat", "grand_total",
    )


def batch_counts(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "clean").alias("clean"),
        F.count_if(F.col("status") == "flagged").alias("flagged"),
    )


def status_reason() -> Column:
    """All error messages and one sentence for real mismatches; a note on clean rounding gaps."""
    errors = F.transform(F.filter("structural_issues", lambda i: i["severity"] == "error"), lambda i: i["message"])
    gap = F.exists("mismatches", lambda m: ~m["within_tolerance"])
    said = F.array_join(F.concat(errors, F.when(gap, F.array(F.lit("Printed totals differ from the recalculated ones.")))
                                 .otherwise(F.array().cast("array<string>"))), " | ")
    fields = F.array_join(F.transform(F.filter("mismatches", lambda m: m["within_tolerance"]),
                                      lambda m: m["field"]), ", ")
    rounding = F.when(fields != "", F.concat(F.lit("Rounding only ("), fields, F.lit(")"))).otherwise("")
    return F.when(F.col("status") == "flagged", said).otherwise(rounding)


def invoice_summary(checked: DataFrame) -> DataFrame:
    return checked.select("filename", "status", "extracted.*", status_reason().alias("reason"))


def issue_detail(checked: DataFrame) -> DataFrame:
    """One row per finding of a flagged invoice."""
    rules = F.transform("structural_issues", lambda i, pos: F.struct(
        F.lit("issue").alias("part"), pos.alias("pos"), i["severity"].alias("severity"), i["rule_id"].alias("what"), i["message"].alias("text")))
    gaps = F.transform("mismatches", lambda m, pos: F.struct(
        F.lit("mismatch").alias("part"), pos.alias("pos"), F.when(m["within_tolerance"], "rounding").otherwise("error").alias("severity"),
        m["field"].alias("what"), F.concat(F.lit("printed "), M.format_amount(m["document_value"]), F.lit(", recalculated "),
                                           M.format_amount(m["recalculated_value"])).alias("text")))
    given = lambda found: F.coalesce(found, F.array().cast(FINDINGS))
    # One list per invoice, so that the check runs once; a filter by status would be moved below it and run the rules a second time.
    found = F.when(F.col("status") == "flagged", F.concat(given(rules.cast(FINDINGS)), given(gaps.cast(FINDINGS))))
    return checked.select("filename", found.alias("found")).select("filename", F.inline_outer("found")).filter(F.col("part").isNotNull())


def findings_text(checked: DataFrame) -> DataFrame:
    """Flagged invoices' findings as one text each, the input of an external narrator."""
    issues = F.transform("structural_issues", lambda i: F.concat(F.lit("* "), i["severity"], F.lit(": "), i["message"]))
    gaps = F.transform(F.filter("mismatches", lambda m: ~m["within_tolerance"]), lambda m: F.concat(
        F.lit("* "), m["field"], F.lit(": printed "), m["document_value"].cast(M.MONEY).cast("string"),
        F.lit(", recalculated "), m["recalculated_value"].cast(M.MONEY).cast("string")))
    return checked.filter(F.col("status") == "flagged").select(
        "filename", F.array_join(F.concat(issues, gaps), "\n").alias("findings"))
