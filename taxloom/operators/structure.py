"""Structural rules. Each rule yields an array of issue structs; rules are concatenated in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taxloom import constants as C
from taxloom.functions.dates import iso_date

ISSUE = "struct<rule_id:string,field:string,severity:string,message:string>"
ISSUES = f"array<{ISSUE}>"


def issue(rule: str, field: str | None, severity: str, message) -> Column:
    text = message if isinstance(message, Column) else F.lit(message)
    return F.struct(F.lit(rule).alias("rule_id"), F.lit(field).cast("string").alias("field"),
                    F.lit(severity).alias("severity"), text.alias("message"))


def when_issue(condition: Column, *args) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), issue(*args))


def collect(*items: Column) -> Column:
    """The issues that fired, in the order given."""
    return F.filter(F.array(*items), lambda x: x.isNotNull()).cast(ISSUES)


def blank(column: Column) -> Column:
    return F.coalesce(column == "", F.lit(True))


def required_fields(taxpayer_type: Column) -> Column:
    missing = [
        when_issue(blank(F.col(f).cast("string")), "missing_required_field", f, "error", f"{f} is not given.")
        for f in ("seller_id", "buyer_id", "vat_number", "issue_date")
    ]
    label = F.when(taxpayer_type == "company", "commercial registration number").otherwise("personal identity number")
    identity = when_issue(blank(F.col("identity_number")), "missing_identity_field", "identity_number", "error",
                          F.concat(F.lit("No "), label, F.lit(" for a "), taxpayer_type, F.lit(" taxpayer.")))
    return collect(*missing, identity)


def vat_number_format(number: Column, rule: str = "invalid_vat_number_format", field: str = "vat_number",
                      who: str = "") -> Column:
    digits = number.rlike(rf"^[0-9]{{{C.VAT_NUMBER_LENGTH}}}$")
    edges = number.rlike(r"^3.*3$")
    given = ~blank(number)
    return collect(
        when_issue(given & ~digits, rule, field, "error",
                   F.concat(F.lit(f"{who}VAT number needs {C.VAT_NUMBER_LENGTH} digits: "), number)),
        when_issue(given & digits & ~edges, rule, field, "error",
                   F.concat(F.lit(f"{who}VAT number must begin and end with 3: "), number)),
    )


def date_rules(issue_date: Column, supply_date: Column, as_of: Column) -> Column:
    return collect(
        when_issue(issue_date > as_of, "future_issue_date", "issue_date", "error",
                   F.concat(F.lit("Issue date lies ahead: "), issue_date.cast("string"))),
        when_issue(supply_date > issue_date, "supply_date_after_issue_date", "supply_date", "warning",
                   F.concat(F.lit("Supplied after it was issued: "), supply_date.cast("string"))),
    )


def same_party(seller: Column, buyer: Column) -> Column:
    return collect(when_issue(~blank(seller) & ~blank(buyer) & (seller == buyer),
                              "seller_equals_buyer", "buyer_id", "error", "Seller and buyer are the same."))


def validate_documents(documents: DataFrame, as_of) -> DataFrame:
    """All rules over ``seller_id, buyer_id, vat_number, issue_date, supply_date, identity_number, taxpayer_type``."""
    day = F.lit(as_of).cast("date")
    issues = F.concat(
        required_fields(F.col("taxpayer_type")),
        vat_number_format(F.col("vat_number")),
        date_rules(F.col("issue_date"), F.col("supply_date"), day),
        same_party(F.col("seller_id"), F.col("buyer_id")),
    )
    return documents.withColumn("issues", issues)


def extracted_essentials() -> Column:
    """What an invoice read from a file must carry."""
    return collect(
        when_issue(blank(F.col("seller.vat_number")), "missing_seller_vat_number", "seller.vat_number", "error",
                   "The seller's VAT number was not found."),
        when_issue(blank(F.col("issue_date")), "missing_issue_date", "issue_date", "error",
                   "The issue date was not found."),
        when_issue(blank(F.col("buyer.name")) & blank(F.col("buyer.vat_number")), "missing_buyer_identity", "buyer",
                   "warning", "The buyer was not identified."),
    )


def extracted_issues(as_of) -> Column:
    """Rules for extracted invoices: essentials, both number formats, date, same party."""
    day = F.lit(as_of).cast("date")
    return F.concat(
        extracted_essentials(),
        vat_number_format(F.col("seller.vat_number"), who="Seller: "),
        vat_number_format(F.col("buyer.vat_number"), "invalid_buyer_vat_number_format", "buyer.vat_number", "Buyer: "),
        date_rules(iso_date(F.col("issue_date")), F.lit(None).cast("date"), day),
        same_party(F.col("seller.vat_number"), F.col("buyer.vat_number")),
    )
