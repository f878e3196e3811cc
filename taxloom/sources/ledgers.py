"""Reconciliation rows from table rows or from invoice lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taxloom.functions.dates import ledger_date
from taxloom.functions.money import AMOUNT, parse_absolute, row_amount
from taxloom.functions.text import strip
from taxloom.sources.columns import LEDGER_FIELDS, cell_at, place_of
from taxloom.sources.numbering import with_running_totals
from taxloom.sources.registers import usable_ledger_tables


def first_usable_table(meta: DataFrame) -> DataFrame:
    """Per document (``document_id, table_index``) the first table with amounts; others are ignored."""
    usable = usable_ledger_tables(meta)
    first = usable.groupBy("document_id").agg(F.min("table_index").alias("table_index"))
    return usable.join(first, ["document_id", "table_index"], "left_semi")


def unusable_documents(meta: DataFrame) -> DataFrame:
    """Documents none of whose tables has amounts, with the reason."""
    key = "document_id" if "document_id" in meta.columns else "source_id"
    return meta.select(key).distinct().join(usable_ledger_tables(meta).select(key).distinct(), key, "left_anti").withColumn(
        "reason", F.lit("no table with an amount, debit or credit column"))


def rows_from_tables(rows: DataFrame, meta: DataFrame, side: str) -> DataFrame:
    """Rows of the usable tables; a row without a readable amount is dropped, its index stays used.

    A side made of several files is numbered through in source order (``source_order``, else the source's name), so ids and
    ordinals are unique over the side. What has no usable table is named by ``unusable_documents``.
    """
    tables = first_usable_table(meta) if "document_id" in meta.columns else usable_ledger_tables(meta)
    order = F.col("source_order") if "source_order" in meta.columns else F.col("source_id")
    sizes = rows.groupBy("source_id").agg((F.max("row_index") + 1).alias("rows")).join(tables, "source_id")
    numbered = with_running_totals(sizes.withColumn("_order", order), ["_order", "source_id"], offset=F.col("rows"))
    tables = numbered.select("source_id", "columns", "offset",
                             *[place_of(F.col(f"columns.{f}")).alias(f"place_{f}") for f in LEDGER_FIELDS])
    text = lambda v: F.when(v != "", strip(v))
    read = rows.join(tables, "source_id").select(  # cell texts once, as plain columns
        "source_id", (F.col("row_index") + F.col("offset")).alias("number"), F.col("cells").alias("raw"),
        *[cell_at(F.col(f"columns.{f}"), F.col(f"place_{f}")).alias(f"_{f}") for f in LEDGER_FIELDS])
    amount = row_amount(parse_absolute(F.col("_debit")), parse_absolute(F.col("_credit")), parse_absolute(F.col("_amount")))
    return read.select(
        F.concat_ws("_", F.lit(side), F.col("number").cast("string")).alias("row_id"),
        F.col("number").cast("bigint").alias("ordinal"), F.lit(side).alias("source"),
        F.nullif(text(F.col("_reference")), F.lit("nan")).alias("reference"),
        ledger_date(F.col("_date")).alias("date"), amount.cast(AMOUNT).alias("amount"),
        text(F.col("_description")).alias("description"), "source_id", "raw",
    ).filter(F.col("amount").isNotNull())


def column_mapping(meta: DataFrame) -> DataFrame:
    """The resolved column names per usable table, for a person to check."""
    return usable_ledger_tables(meta).select("source_id", "columns.*")


def rows_from_invoices(documents: DataFrame, side: str) -> DataFrame:
    """Rows from line items (``filename, issue_date, line_items``): id, issue date, absolute base.

    The lines of several files are numbered through in the order of the file names. The ids of the first file are its line ids;
    those of later files start with the file's number, so that equal line ids of two invoices stay apart.
    """
    files = with_running_totals(documents.groupBy("filename").agg(F.greatest(F.max(F.size("line_items")), F.lit(0)).alias("lines")),
                                ["filename"], file_number=F.lit(1), offset=F.col("lines")).drop("lines")
    lines = documents.select("filename", "issue_date", F.posexplode("line_items").alias("pos", "li")).join(files, "filename")
    line_id = F.col("li.line_id")
    own = F.coalesce(line_id, F.col("pos").cast("string"))
    named = F.when(F.col("file_number") == 0, own).otherwise(F.concat_ws(":", F.col("file_number").cast("string"), own))
    return lines.select(
        F.concat_ws("_", F.lit(side), named).alias("row_id"),
        (F.col("pos") + F.col("offset")).cast("bigint").alias("ordinal"), F.lit(side).alias("source"),
        F.nullif(line_id, F.lit("")).alias("reference"), ledger_date(F.col("issue_date")).alias("date"),
        parse_absolute(F.col("li.taxable_base").cast("string")).alias("amount"),
        F.col("li.description").alias("description"), F.col("filename").alias("source_id"),
    ).filter(F.col("amount").isNotNull())


def dispatch(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(with tables, with line items only, neither) by ``n_tables`` and ``line_items``."""
    tables = F.coalesce(F.col("n_tables"), F.lit(0)) > 0
    lines = F.coalesce(F.size("line_items"), F.lit(0)) > 0
    rejected = documents.filter(~tables & ~lines).withColumn("reason", F.lit("neither a table nor line items"))
    return documents.filter(tables), documents.filter(~tables & lines), rejected
