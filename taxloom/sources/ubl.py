"""UBL 2.1 invoice XML: one file per invoice, read by Spark's XML source with a fixed schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from taxloom import constants as C
from taxloom.functions.text import strip

_T = "struct<_VALUE:string>"
_PARTY = (f"struct<Party:struct<PartyLegalEntity:array<struct<RegistrationName:{_T}>>,"
          f"PartyTaxScheme:array<struct<CompanyID:{_T}>>>>")
SCHEMA = (
    f"IssueDate {_T}, AccountingSupplierParty {_PARTY}, AccountingCustomerParty {_PARTY}, "
    f"InvoiceLine array<struct<ID:{_T},LineExtensionAmount:{_T},TaxTotal:array<struct<TaxAmount:{_T}>>,"
    f"Item:struct<Name:{_T},ClassifiedTaxCategory:array<struct<ID:{_T}>>>>>, "
    f"LegalMonetaryTotal struct<TaxExclusiveAmount:{_T},TaxInclusiveAmount:{_T}>, "
    f"TaxTotal array<struct<TaxAmount:{_T}>>, _corrupt_record string"
)


def _text(c: Column) -> Column:
    return F.nullif(strip(c["_VALUE"]), F.lit(""))


def _number(c: Column) -> Column:
    return _text(c).try_cast("decimal(24,6)")


def _party(name: str) -> Column:
    party = F.col(name)["Party"]
    return F.struct(
        _text(F.get(party["PartyLegalEntity"], 0)["RegistrationName"]).alias("name"),
        _text(F.get(party["PartyTaxScheme"], 0)["CompanyID"]).alias("vat_number"))


def read_ubl(spark: SparkSession, paths) -> DataFrame:
    """Extracted invoices of the form the invoice check takes; unreadable files carry an error."""
    raw = (
        spark.read.format("xml").option("rowTag", "Invoice").option("ignoreNamespace", "true")
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(SCHEMA).load(paths)
        .select("*", F.regexp_extract(F.col("_metadata.file_path"), r"[^/]*$", 0).alias("filename")))
    code = lambda li: _text(F.get(li["Item"]["ClassifiedTaxCategory"], 0)["ID"])
    lines = F.transform("InvoiceLine", lambda li: F.struct(
        F.coalesce(_text(li["ID"]), F.lit("")).alias("line_id"), _text(li["Item"]["Name"]).alias("description"),
        _number(li["LineExtensionAmount"]).alias("taxable_base"),
        F.when(code(li).isin(*C.UBL_CATEGORY_CODES), code(li)).alias("tax_category_code"),
        _number(F.get(li["TaxTotal"], 0)["TaxAmount"]).alias("vat_amount")))
    invoices = raw.select(
        "filename", F.lit("ubl_xml").alias("format"), _party("AccountingSupplierParty").alias("seller"),
        _party("AccountingCustomerParty").alias("buyer"), _text(F.col("IssueDate")).alias("issue_date"),
        lines.alias("line_items"),
        F.struct(_number(F.col("LegalMonetaryTotal")["TaxExclusiveAmount"]).alias("tax_exclusive_amount"),
                 _number(F.get("TaxTotal", 0)["TaxAmount"]).alias("tax_amount"),
                 _number(F.col("LegalMonetaryTotal")["TaxInclusiveAmount"]).alias("tax_inclusive_amount")).alias("totals"),
        F.when(F.col("_corrupt_record").isNotNull(), "The file is not readable XML.").alias("extraction_error"))
    # A file without an Invoice element yields no row at all; it must still be reported.
    files = spark.read.format("binaryFile").load(paths).select(
        F.regexp_extract("path", r"[^/]*$", 0).alias("filename"))
    silent = files.join(invoices.select("filename"), "filename", "left_anti")
    missing = silent.withColumn("extraction_error", F.lit("The file holds no invoice."))
    return invoices.unionByName(missing, allowMissingColumns=True)
