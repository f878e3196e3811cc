"""Test views: the data model of this package laid over the TPC-H-like test tables.

Each view is a plain projection or join of whole tables; every changed value is a rule on a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from taxloom.functions.money import AMOUNT
from taxloom.operators import match


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cents(column: str):
    return F.col(column).cast("decimal(18,2)")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Invoice lines from lineitem: category by return flag, a manual flag on discounted odd parts."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("invoice_id"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"),
        cents("l_extendedprice").alias("taxable_base"),
        F.when(F.col("l_returnflag") == "A", "standard").when(F.col("l_returnflag") == "N", "zero_rated")
        .otherwise("exempt").alias("tax_category"),
        F.when((F.col("l_partkey") % 97) == 0, "reverse_charge_import_of_services").alias("flag"),
    )


def printed_totals(totals: DataFrame) -> DataFrame:
    """Printed figures: the recalculated ones, off by an amount that depends on the invoice number."""
    k = F.col("invoice_id")
    err = (F.when(k % 10 == 1, F.lit("0.01")).when(k % 10 == 2, F.lit("0.10")).when(k % 10 == 3, F.lit("-0.02"))
           .otherwise(F.lit("0.00"))).cast("decimal(18,2)")
    return totals.select(
        "invoice_id", F.when(k % 11 != 0, (F.col("total_vat") + err).cast(AMOUNT)).alias("total_vat"),
        F.when(k % 13 != 0, (F.col("grand_total") + err).cast(AMOUNT)).alias("grand_total"))


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted invoices: orders as headers, their lineitems as lines, parties from customers."""
    o, li = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    code = (F.when((F.col("l_partkey") % 10) == 0, F.lit(None).cast("string"))
            .when(F.col("l_returnflag") == "A", "S").when(F.col("l_returnflag") == "N", "Z").otherwise("E"))
    item = F.struct(
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"),
        cents("l_extendedprice").cast(AMOUNT).alias("taxable_base"), code.alias("tax_category_code"),
        F.lit(None).cast(AMOUNT).alias("vat_amount"))
    per_order = li.groupBy("l_orderkey").agg(
        F.collect_list(item).alias("line_items"),
        F.sum(F.round(cents("l_extendedprice") * F.when(
            (code.isNull() & ~F.coalesce(_suggested().isin("exempt", "zero_rated"), F.lit(False))) | (code == "S"), F.lit("0.15")).otherwise(
            F.lit("0.00")).cast("decimal(3,2)"), 2)).alias("vat"),
        F.sum(cents("l_extendedprice")).alias("base"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    seller = F.when(k % 17 == 0, F.lit(None)).when(k % 19 == 0, F.lit("12345")).otherwise(
        F.concat(F.lit("3"), F.lpad((k % 1000).cast("string"), 13, "0"), F.lit("3")))
    buyer = F.when(c % 5 == 0, F.lit(None)).when(c % 23 == 0, F.lit("923456789012345")).otherwise(
        F.concat(F.lit("3"), F.lpad((c % 1000).cast("string"), 13, "0"), F.lit("3")))
    err = (F.when(k % 10 == 1, F.lit("0.01")).when(k % 10 == 2, F.lit("0.10")).otherwise(F.lit("0.00"))).cast("decimal(18,2)")
    return o.join(per_order, o.o_orderkey == per_order.l_orderkey, "left").select(
        F.concat(F.lit("inv_"), k.cast("string")).alias("filename"),
        F.struct(F.lit("Seller Co").alias("name"), seller.cast("string").alias("vat_number")).alias("seller"),
        F.struct(F.when(c % 7 != 0, F.concat(F.lit("Customer "), c.cast("string"))).alias("name"),
                 buyer.cast("string").alias("vat_number")).alias("buyer"),
        F.when(k % 29 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("issue_date"),
        F.coalesce("line_items", F.array().cast(per_order.schema["line_items"].dataType)).alias("line_items"),
        F.struct(
            F.col("base").cast(AMOUNT).alias("tax_exclusive_amount"),
            F.when(k % 31 != 0, F.col("vat") + err).cast(AMOUNT).alias("tax_amount"),
            F.when(k % 31 != 0, F.col("base") + F.col("vat") + err).cast(AMOUNT).alias("tax_inclusive_amount"),
        ).alias("totals"),
    )


def _suggested():
    """What is suggested for a part: one of the categories, something that is none, or nothing."""
    turn = F.floor(F.col("l_partkey") / 20) % 4
    return F.when((F.col("l_partkey") % 20) == 0, F.when(turn == 0, "exempt").when(turn == 1, "zero_rated").when(turn == 2, "standard").otherwise("luxury"))


def suggestions(spark: SparkSession, sf: str) -> DataFrame:
    """A suggested category for every second part without a code."""
    li = table(spark, sf, "lineitem")
    return li.filter((F.col("l_partkey") % 20) == 0).select(
        F.concat(F.lit("inv_"), F.col("l_orderkey").cast("string")).alias("filename"),
        F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey").alias("line_id"),
        _suggested().alias("tax_category"), F.lit(0.9).alias("confidence"))


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Flat documents for the structural rules, one per order."""
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return o.select(
        k.alias("document_id"),
        F.when(k % 50 != 0, F.concat(F.lit("P"), (k % 1500).cast("string"))).alias("seller_id"),
        F.when(k % 51 != 0, F.concat(F.lit("P"), c.cast("string"))).alias("buyer_id"),
        F.when(k % 7 == 0, F.lit("31234")).when(k % 11 == 0, F.lit("912345678901234")).when(k % 13 != 0, F.concat(
            F.lit("3"), F.lpad((k % 1000).cast("string"), 13, "0"), F.lit("3"))).alias("vat_number"),
        F.when(k % 17 != 0, F.to_date("o_orderdate")).alias("issue_date"),
        F.when(k % 3 == 0, F.date_add(F.to_date("o_orderdate"), (k % 5).cast("int") - 2)).alias("supply_date"),
        F.when(k % 19 != 0, F.lit("7001")).alias("identity_number"),
        F.when(k % 2 == 0, "company").otherwise("individual").alias("taxpayer_type"),
    )


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Side a: one ledger row per order, and a second equal one for some."""
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    copies = F.when(k % 20 == 11, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    o = o.withColumn("part", F.explode(copies))
    return o.select(
        F.concat_ws("_", F.lit("a"), k, "part").alias("row_id"), (k * 2 + F.col("part")).alias("ordinal"),
        F.lit("a").alias("source"),
        F.when((k % 20).isin(7, 11), F.lit(None).cast("string"))
        .when(k % 40 == 8, F.concat(F.lit("DUP-X-"), (k % 400).cast("string")))
        .otherwise(F.concat(F.lit("INV-A-"), k.cast("string"))).alias("reference"),
        F.to_date("o_orderdate").alias("date"), cents("o_totalprice").cast(AMOUNT).alias("amount"),
        F.concat(F.lit("Lot "), _word(k)).alias("description"))


def _word(k):
    """A subject word shared by three neighbouring orders."""
    return F.translate(F.lpad(F.floor(k / 3).cast("string"), 8, "0"), "0123456789", "abcdefghij")


def statement(spark: SparkSession, sf: str) -> DataFrame:
    """Side b: the ledger seen by the other party, disturbed by rules on the order number.

    Reference written differently or missing, tax included, a few days later, split in two or three
    parts, paid in two unlabelled instalments weeks later, or absent.
    """
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    amount = cents("o_totalprice")
    day = F.to_date("o_orderdate")
    kind = k % 20
    part1 = F.round(amount * F.lit("0.40").cast("decimal(3,2)"), 2).cast("decimal(18,2)")
    part2 = F.round(amount * F.lit("0.35").cast("decimal(3,2)"), 2).cast("decimal(18,2)")
    whole = F.array(F.struct(F.lit(0).alias("part"), amount.alias("amount")))
    two = F.array(F.struct(F.lit(1).alias("part"), part1.alias("amount")),
                  F.struct(F.lit(2).alias("part"), (amount - part1).cast("decimal(18,2)").alias("amount")))
    three = F.array(F.struct(F.lit(1).alias("part"), part1.alias("amount")),
                    F.struct(F.lit(2).alias("part"), part2.alias("amount")),
                    F.struct(F.lit(3).alias("part"), (amount - part1 - part2).cast("decimal(18,2)").alias("amount")))
    taxed = F.array(F.struct(F.lit(0).alias("part"), F.round(
        amount * F.lit("1.15").cast("decimal(3,2)"), 2).cast("decimal(18,2)").alias("amount")))
    near = F.array(F.struct(F.lit(0).alias("part"), (amount + F.lit("0.01").cast("decimal(18,2)")).cast(
        "decimal(18,2)").alias("amount")))
    twice = F.array(F.struct(F.lit(0).alias("part"), amount.alias("amount")),
                    F.struct(F.lit(1).alias("part"), amount.alias("amount")))
    parts = (F.when(kind == 1, taxed).when(kind == 2, two).when(kind == 3, three).when(kind == 5, near)
             .when(kind == 9, twice).when(kind == 4, two).otherwise(whole))
    return (
        o.filter((kind != 4) | (k % 40 == 24)).select(k.alias("k"), kind.alias("kind"), day.alias("day"), F.inline(parts))
        .select(
            F.concat_ws("_", F.lit("b"), "k", "part").alias("row_id"),
            (F.col("k") * 4 + F.col("part")).alias("ordinal"), F.lit("b").alias("source"),
            F.when(F.col("kind").isin(2, 3, 4, 5, 6, 7, 9, 11), F.lit(None).cast("string"))
            .when(F.col("k") % 40 == 8, F.concat(F.lit("dup x "), (F.col("k") % 400).cast("string")))
            .otherwise(F.concat(F.lit("inv a "), F.col("k").cast("string"))).alias("reference"),
            F.date_add("day", F.when(F.col("kind").isin(2, 3), F.col("part")).when(
                F.col("kind") == 4, F.col("part") * 20).when(F.col("kind") == 5, F.lit(2))
                       .when(F.col("kind") == 6, F.lit(1)).otherwise(F.lit(0))).alias("date"),
            F.col("amount").cast(AMOUNT).alias("amount"),
            F.when(F.col("kind") != 4, F.concat(F.lit("Lot "), _word(F.col("k")))).alias("description")))


def _picked(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Items with the smallest candidate id of their choice."""
    return match.join_choices(items, candidates.groupBy("choice_id").agg(F.min("candidate.row_id").alias("pick")))


def decisions(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """A review: by the row number, a third confirmed, a third dismissed, the rest left open. Ambiguous items
    pick the smallest candidate id, so contested ones claim the same row twice."""
    n = F.coalesce(F.floor(F.col("row_a.ordinal") / 2), F.floor(F.col("row_b.ordinal") / 4))
    decision = F.when(n % 3 == 0, "confirmed").when(n % 3 == 1, "dismissed")
    return _picked(items, candidates).select(
        "item_id", decision.alias("decision"), F.lit(None).cast("string").alias("explanation"),
        F.when(decision == "confirmed", F.col("pick")).alias("selected_candidate_id"))


def accept_all(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """A review that accepts every proposal and leaves rows without a counterpart open."""
    return _picked(items, candidates).select(
        "item_id", F.when(F.col("kind") != "unmatched", "confirmed").alias("decision"),
        F.lit(None).cast("string").alias("explanation"), F.col("pick").alias("selected_candidate_id"))


SALES_HEAD = ["Invoice No", "Date", "Customer", "Tax Category", "Amount (SAR)", "Output VAT (SAR)"]
STATED_HEAD = ["Purchase Ref", "Date", "Vendor", "Expense Type", "Amount (SAR)", "Input VAT (SAR)", "Reclaimable?"]
GUESSED_HEAD = ["Purchase Ref", "Date", "Vendor", "Category", "Particulars", "Amount (SAR)", "Input VAT (SAR)"]
EXPENSES = ["Office supplies", "Client entertainment", "Vehicle repair", "Hotel stay", "Consulting", "Diesel fuel",
            "Staff catering", "Software", "Motor parts", "Printing"]


def register_meta(spark: SparkSession) -> DataFrame:
    """Three registers: sales by order, purchases stating reclaimability, purchases that do not."""
    return spark.createDataFrame([
        ("sales", 1, "sales.csv", SALES_HEAD, ["Demo Trading — sales register", "VAT No 310000000000003"]),
        ("stated", 2, "stated.csv", STATED_HEAD, ["Demo Trading — purchase register"]),
        ("guessed", 3, "supplier_bills.csv", GUESSED_HEAD, []),
    ], "source_id string, source_order int, filename string, column_names array<string>, preamble array<string>")


def _cells(head, values):
    return F.array(*[F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in zip(head, values)])


def register_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of the three registers with one total row each; some VAT amounts and one total are off."""
    o, li, p = (table(spark, sf, t) for t in ("orders", "lineitem", "part"))
    k, base = F.col("o_orderkey"), cents("o_totalprice")
    rate = F.when(k % 4 == 0, F.lit("0.00")).otherwise(F.lit("0.15")).cast("decimal(3,2)")
    off = F.when(k % 100 == 1, F.lit("7.00")).otherwise(F.lit("0.00")).cast("decimal(18,2)")
    sales = o.select(k.alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_custkey").alias("party"),
                     F.when(k % 4 == 0, "Zero-rated (export)").when(k % 9 == 0, F.lit(None)).otherwise("Standard 15%").alias("cat"),
                     base.alias("base"), (F.round(base * rate, 2) + off).cast("decimal(18,2)").alias("vat"))
    sales_rows = sales.select(F.lit("sales").alias("source_id"), F.col("k").alias("row_index"), _cells(
        SALES_HEAD, [F.concat(F.lit("S-"), "k"), F.col("d"), F.concat(F.lit("Customer "), "party"), F.col("cat"), F.col("base"), F.col("vat")]).alias("cells"))
    expense = F.element_at(F.array(*[F.lit(e) for e in EXPENSES]), (F.col("p_size") % 10 + 1).cast("int"))
    b = cents("l_extendedprice")
    lk = F.col("l_orderkey")
    loff = F.when(F.col("l_partkey") % 100 == 3, F.lit("5.00")).otherwise(F.lit("0.00")).cast("decimal(18,2)")
    bought = li.join(p, li.l_partkey == p.p_partkey).select(
        (lk * 8 + F.col("l_linenumber")).alias("row_index"), F.date_format("l_shipdate", "dd/MM/yyyy").alias("d"),
        F.concat(F.lit("Vendor "), "l_suppkey").alias("party"), expense.alias("expense"), b.alias("base"),
        (F.round(b * F.lit("0.15").cast("decimal(3,2)"), 2) + loff).cast("decimal(18,2)").alias("vat"), "l_linestatus",
        F.when(lk % 3 == 0, "Yes").when(lk % 3 == 1, "N").otherwise("").alias("stated"))
    ref = F.concat(F.lit("P-"), F.col("row_index").cast("string"))
    stated = bought.filter(F.col("l_linestatus") == "F").select(F.lit("stated").alias("source_id"), "row_index", _cells(
        STATED_HEAD, [ref, F.col("d"), F.col("party"), F.col("expense"), F.col("base"), F.col("vat"), F.col("stated")]).alias("cells"))
    guessed = bought.filter(F.col("l_linestatus") == "O").select(F.lit("guessed").alias("source_id"), "row_index", _cells(
        GUESSED_HEAD, [ref, F.col("d"), F.col("party"), F.col("expense"), F.lit("monthly bill"), F.col("base"), F.col("vat")]).alias("cells"))
    none = F.lit(None)

    def total(rows, source, head, at, error):
        """The printed total row of a register, off by ``error``."""
        v = [none] * len(head)
        v[0], v[at] = F.lit("TOTAL"), (F.sum("vat") + F.lit(error).cast("decimal(18,2)"))
        return rows.agg(_cells(head, v).alias("cells")).select(F.lit(source).alias("source_id"), F.lit(-1).cast("bigint").alias("row_index"), "cells")

    totals = total(sales, "sales", SALES_HEAD, 5, "0.00").unionByName(
        total(bought.filter("l_linestatus = 'F'"), "stated", STATED_HEAD, 5, "12.50")).unionByName(
        total(bought.filter("l_linestatus = 'O'"), "guessed", GUESSED_HEAD, 6, "0.01"))
    return sales_rows.unionByName(stated).unionByName(guessed).unionByName(totals)


def default_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("stated", "standard")], "source_id string, rate_key string")


def points(spark: SparkSession, sf: str) -> DataFrame:
    """Searchable points: a vector each, text and language from the document of the same id, references to
    the next articles, every seventh one a pointer to a reference table."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    v = F.col("vec_id")
    pointer = v % 7 == 0
    article = lambda n: (n % 50).cast("string")
    refs = F.array(
        F.struct(F.lit("article").alias("type"), article(v + 1).alias("article_number"), F.lit(None).cast("string").alias("table_ref")),
        F.struct(F.lit("table").alias("type"), F.lit(None).cast("string").alias("article_number"),
                 F.concat(F.lit("t"), (v % 25).cast("string")).alias("table_ref")))
    return e.join(d, e.vec_id == d.doc_id).select(
        F.lpad(v.cast("string"), 8, "0").alias("id"), F.col("lang").alias("language"), "embedding",
        F.when(pointer, "table_pointer").otherwise("prose").alias("content_kind"), F.col("source").alias("document_type"),
        F.lit("current").alias("version_label"), F.lit("KSA").alias("jurisdiction"), (v % 10 != 0).alias("is_current"),
        F.lit("site").alias("source_site"), F.concat(F.lit("u"), v.cast("string")).alias("source_url"),
        F.when(pointer, F.concat(F.lit("t"), (v % 25).cast("string"))).alias("table_ref"),
        F.when(~pointer, article(v)).alias("article_number"), F.lit(0).alias("part_index"),
        F.when(~pointer & (v % 3 == 0), refs).otherwise(F.array().cast(
            "array<struct<type:string,article_number:string,table_ref:string>>")).alias("references"),
        F.col("text"))


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector as a query, each asked in its own or the neighbouring language."""
    e, d = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    lang = F.when(F.col("vec_id") % 5 == 0, "ar").otherwise(F.col("lang"))
    return e.join(d, e.vec_id == d.doc_id).select(
        F.lpad(F.col("vec_id").cast("string"), 8, "0").alias("query_id"), lang.alias("language"), "embedding", "text")


def nation_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Reference tables: one per nation, its suppliers as rows."""
    s = table(spark, sf, "supplier")
    return s.select(
        F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("table_ref"), F.col("s_suppkey").alias("row_index"),
        F.array(F.struct(F.lit("supplier").alias("name"), F.col("s_name").alias("value")),
                F.struct(F.lit("0").alias("name"), cents("s_acctbal").cast("string").alias("value")),
                F.struct(F.lit("blank").alias("name"), F.lit(" ").alias("value"))).alias("cells"))


def table_meta(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    return n.select(F.concat(F.lit("t"), F.col("n_nationkey").cast("string")).alias("table_ref"), F.col("n_name").alias("document_type"),
                    F.lit("en").alias("language"), F.array(F.lit("supplier"), F.lit("0"), F.lit("blank")).alias("column_names"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("thread_id"), F.col("turn").alias("seq"), "role", F.col("text").alias("content"))


def notes(spark: SparkSession, sf: str) -> DataFrame:
    """Filing notes: one per order, by its customer's clerk."""
    return table(spark, sf, "orders").select(
        F.concat(F.lit("u"), (F.col("o_custkey") % 20).cast("string")).alias("user_id"),
        F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("customer_name"),
        F.lower("o_orderstatus").alias("status"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("notes"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=F.col("o_orderkey").cast("decimal(18,6)"))).alias("created_at"))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as regulation text: "Article n:" before every line."""
    numbered = F.transform(F.split("text", "\n"), lambda line, i: F.concat(F.lit("Article "), (i + 1).cast("string"), F.lit(": "), line))
    return table(spark, sf, "documents").select(
        F.col("doc_id"), F.col("source").alias("document_type"), F.lit("en").alias("language"), F.array_join(numbered, "\n").alias("text"))


def memory_updates(spark: SparkSession, sf: str) -> DataFrame:
    """Memory updates from events: user, kind of event as customer, properties as context."""
    return table(spark, sf, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), F.col("event_type").alias("customer_name"),
        F.col("props").alias("customer_context"), F.concat(F.lit("issue "), F.col("event_id").cast("string")).alias("issue_summary"),
        F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Stored batches: one per event, kept 24 hours."""
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf, "events").select(
        F.concat(F.lit("b"), F.col("event_id").cast("string")).alias("batch_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), F.col("event_type").alias("kind"),
        F.when(F.col("event_id") % 2 == 0, "ready").otherwise("awaiting_review").alias("status"), F.col("props").alias("data"),
        ts.alias("created_at"), (ts + F.expr("interval 24 hours")).alias("expires_at"))
