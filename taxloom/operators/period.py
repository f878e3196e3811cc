"""Period VAT return from sales and purchase registers.

``rows(source_id, row_index, cells)``, ``meta`` as described by ``sources.registers.describe_sources``.
One row of input becomes one row of ``lines``; everything else is aggregation per source, with partial
sums on the map side, so a register holding most of the rows costs no more than many small ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from taxloom import constants as C
from taxloom.functions import money as M
from taxloom.functions.labels import label
from taxloom.functions.text import strip
from taxloom.session import settle
from taxloom.sources.columns import REGISTER_FIELDS, cell_at, place_of
from taxloom.sources.numbering import with_running_totals

VAT = "decimal(38,6)"


@dataclass
class PeriodReturn:
    """lines: one per register row with VAT (sales and purchases). issues: source_id, issue, detail.
    headline: one row of figures."""

    lines: DataFrame
    issues: DataFrame
    headline: DataFrame

    @property
    def purchases(self) -> DataFrame:
        return self.lines.filter(F.col("role") == "purchases")

    @property
    def review_items(self) -> DataFrame:
        return self.purchases.filter("needs_review")


def is_total_row(cells: Column) -> Column:
    """Any cell mentions a total; a vendor so named makes its row a total row too."""
    return F.lower(F.array_join(cells["value"], "\n")).contains("total")


def row_label(cells: Column, description: Column) -> Column:
    filled = F.filter(cells, lambda c: c["value"].isNotNull() & (c["value"] != ""))
    return F.coalesce(F.nullif(description, F.lit("")), F.get(filled, 0)["value"], F.lit("row"))


def _first_hit(text: Column, keywords) -> Column:
    return F.coalesce(*[F.when(text.contains(k), F.lit(k)) for k in keywords])


def stated_text(stated: Column) -> Column:
    return F.lower(strip(F.coalesce(stated, F.lit(""))))


def subject_text(description: Column, category: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(category, F.lit(""))))


def reclaimability(said: Column, subject: Column, raw: Column) -> Column:
    """struct(reclaimable, reason_code, keyword, needs_review) of a purchase.

    A stated yes or no wins; then blocked words, then words that need a person's decision. ``said`` and
    ``subject`` (see above) are read many times, so callers pass them as computed columns.
    """
    first = F.regexp_replace(F.substring_index(F.regexp_replace(said, r"(?U)\s+", " "), " ", 1), r"[.,;:]+$", "")
    blocked, unclear = _first_hit(subject, C.BLOCKED_KEYWORDS), _first_hit(subject, C.AMBIGUOUS_KEYWORDS)

    def verdict(ok: bool, code: str, word: Column | None, review: bool) -> Column:
        return F.struct(F.lit(ok).alias("reclaimable"), F.lit(code).alias("reason_code"),
                        (F.lit(None).cast("string") if word is None else word).alias("keyword"),
                        F.lit(review).alias("needs_review"))

    return (
        F.when((said != "") & first.isin(*C.STATED_YES), verdict(True, "stated", raw, False))
        .when((said != "") & (first.isin(*C.STATED_NO) | said.contains("n/a") | said.contains("exempt")),
              verdict(False, "stated", raw, False))
        .when(blocked.isNotNull(), verdict(False, "blocked", blocked, False))
        .when(unclear.isNotNull(), verdict(True, "unclear", unclear, True))
        .otherwise(verdict(True, "default", None, False)))


def expected_vat(amount: Column, own_rate: Column, default: Column) -> Column:
    """The VAT amounts that would be right, distinct and sorted: by the row's own rate, or by the
    source's default rate and zero."""
    of = lambda rate: M.round_currency(amount * rate)
    return F.when(amount.isNull(), F.lit(None)).when(own_rate.isNotNull(), F.array(of(own_rate))).otherwise(
        F.sort_array(F.array_distinct(F.array(of(default), of(M.dec("0.00").cast("decimal(5,4)"))))))


def select_sources(meta: DataFrame, mapping: DataFrame | None = None, default_rates: DataFrame | None = None) -> DataFrame:
    """Sources taking part: role by the confirmed mapping, else by the guess; plus the default rate."""
    if mapping is not None:
        meta = meta.join(mapping.select("source_id", F.col("role").alias("mapped")), "source_id", "left")
    else:
        meta = meta.withColumn("mapped", F.lit(None).cast("string"))
    if default_rates is not None:
        meta = meta.join(default_rates.select("source_id", "rate_key"), "source_id", "left")
    else:
        meta = meta.withColumn("rate_key", F.lit(None).cast("string"))
    return meta.withColumns({
        "role": F.coalesce("mapped", "guessed_role"),
        "default_rate": M.default_rate(F.col("rate_key")),
        "unanswered": M.rate_of(F.col("rate_key")).isNull(),
    }).filter(F.col("role").isin("sales", "purchases"))


def register_lines(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Rows of taking-part sources with a VAT column: values read, total rows marked."""
    # One row per source: stored, so that its true size decides how it is joined. A few sources fill too few partitions for Spark
    # to broadcast them later on, and a join by source would read each register in one task.
    used = settle(sources.filter(F.col("columns.vat").isNotNull()).select(
        "source_id", "source_order", "role", "columns", "default_rate", "unanswered",
        *[place_of(F.col(f"columns.{f}")).alias(f"place_{f}") for f in REGISTER_FIELDS]), "used")
    c = lambda field: cell_at(F.col(f"columns.{field}"), F.col(f"place_{field}"))
    said = F.lower(F.array_join(F.col("cells")["value"], " "))
    read = rows.join(used, "source_id").select(
        "source_id", "source_order", "row_index", "role", "default_rate", "unanswered",
        F.col("columns.amount").isNotNull().alias("has_amount"), is_total_row(F.col("cells")).alias("is_total"),
        said.contains("reclaimable").alias("says_reclaimable"), c("vat").alias("vat"), c("amount").alias("base"),
        c("category").alias("category"), c("description").alias("description"), c("reclaimable").alias("stated"),
        row_label(F.col("cells"), c("description")).alias("label"))
    return read.withColumns({"vat_amount": M.parse_signed(F.col("vat")), "amount": M.parse_signed(F.col("base"))}).drop("vat", "base")


def usable_categories(lines: DataFrame) -> DataFrame:
    """Per source, whether its category column holds rates at all: source_id, usable."""
    return lines.groupBy("source_id").agg(
        F.coalesce(F.bool_or(~F.col("is_total") & M.category_rate(F.col("category")).isNotNull()), F.lit(False)).alias("usable"))


def _checked(lines: DataFrame) -> DataFrame:
    own = F.when(F.col("usable"), M.category_rate(F.col("category")))
    # One row per source: stored, so that its true size decides how it is joined.
    with_rate = lines.join(settle(usable_categories(lines), "usable"), "source_id").withColumns({
        "own_rate": own, "said": stated_text(F.col("stated")), "subject": subject_text(F.col("description"), F.col("category"))})
    has_amount = F.col("has_amount") & F.col("amount").isNotNull()
    expected = F.when(has_amount, expected_vat(F.col("amount"), F.col("own_rate"), F.col("default_rate")))
    verdict = reclaimability(F.col("said"), F.col("subject"), F.col("stated"))
    data = with_rate.filter(~F.col("is_total") & F.col("vat_amount").isNotNull())
    return data.select(
        "source_id", "source_order", "row_index", "role", "vat_amount", "amount", "category", "own_rate",
        "label", expected.alias("expected"),
        (has_amount & F.col("own_rate").isNull() & F.col("unanswered")).alias("default_used"),
        F.when(F.col("role") == "purchases", verdict).alias("verdict"),
        F.concat_ws("_", F.lit("pr"), "source_id", F.col("row_index").cast("string")).alias("item_id"),
    ).withColumn("vat_mismatch", F.coalesce(
        # One or two expected amounts; the second, if any, is the last.
        (F.abs(F.get("expected", 0) - F.col("vat_amount")) > M.dec(C.REGISTER_TOLERANCE))
        & (F.abs(F.get("expected", F.size("expected") - 1) - F.col("vat_amount")) > M.dec(C.REGISTER_TOLERANCE)), F.lit(False)))


def _headline(lines: DataFrame) -> DataFrame:
    vat = F.col("vat_amount")
    sales, purchases = F.col("role") == "sales", F.col("role") == "purchases"
    total = lambda cond: F.coalesce(F.sum(F.when(cond, vat)), F.lit(0)).cast(VAT)
    counted = purchases & F.col("reclaimable") & ~F.col("needs_review")
    figures = lines.agg(
        total(sales).alias("output_vat"), total(purchases).alias("input_vat_total"),
        total(counted).alias("reclaimable_input_vat"), F.count_if(sales).alias("sales_row_count"),
        F.count_if(purchases).alias("purchase_row_count"),
        F.count_if(purchases & F.col("needs_review")).alias("pending_count"))
    return figures.withColumn("net_position", (F.col("output_vat") - F.col("reclaimable_input_vat")).cast(VAT)).withColumn(
        "status", F.when(F.col("pending_count") > 0, "awaiting_review").otherwise("ready"))


def _total_issues(all_lines: DataFrame, checked: DataFrame) -> DataFrame:
    """Declared totals against the sums of their rows; a total that says so is compared with the
    reclaimable sum."""
    counted = F.col("reclaimable") & ~F.col("needs_review")
    sums = checked.groupBy("source_id").agg(
        F.sum("vat_amount").cast(VAT).alias("row_sum"),
        F.coalesce(F.sum(F.when(counted, F.col("vat_amount"))), F.lit(0)).cast(VAT).alias("reclaimable_sum"))
    totals = all_lines.filter(F.col("is_total") & F.col("vat_amount").isNotNull()).withColumn(
        "of_reclaimable", (F.col("role") == "purchases") & F.col("says_reclaimable")).join(sums, "source_id", "left")
    zero = F.lit(0).cast(VAT)
    computed = F.when(F.col("of_reclaimable"), F.coalesce("reclaimable_sum", zero)).otherwise(F.coalesce("row_sum", zero))
    return totals.withColumn("computed", computed).filter(
        F.abs(F.col("vat_amount") - F.col("computed")) > M.dec(C.REGISTER_TOLERANCE)).select(
        "source_id", "row_index", F.when(F.col("of_reclaimable"), "reclaimable_total_differs").otherwise("total_differs").alias("issue"),
        F.concat(F.lit("stated "), F.col("vat_amount").cast(M.MONEY).cast("string"), F.lit(", rows give "),
                 F.col("computed").cast(M.MONEY).cast("string")).alias("detail"))


def period_return(rows: DataFrame, meta: DataFrame, mapping: DataFrame | None = None,
                  default_rates: DataFrame | None = None) -> PeriodReturn:
    """Headline, lines with reclaimability, and consistency issues of the confirmed sources."""
    # Stored once: source rows so that joins see their true (small) size, lines so that cells are read once.
    sources = settle(select_sources(meta, mapping, default_rates), "sources")
    all_lines = settle(register_lines(rows, sources), "register_lines")
    checked = _checked(all_lines).select("*", "verdict.*").drop("verdict")

    none = F.lit(None).cast("bigint")
    skipped = sources.filter(F.col("columns.vat").isNull()).select(
        "source_id", none.alias("row_index"), F.lit("no_vat_column").alias("issue"),
        F.lit("left out: no VAT column").alias("detail"))
    wrong = checked.filter("vat_mismatch").select(
        "source_id", "row_index", F.lit("row_vat_differs").alias("issue"),
        F.concat(F.col("label"), F.lit(": expected "), F.array_join(F.transform("expected", lambda e: e.cast("string")), " or "),
                 F.lit(", shown "), F.col("vat_amount").cast(M.MONEY).cast("string")).alias("detail"))
    assumed = checked.groupBy("source_id").agg(F.bool_or("default_used").alias("used")).filter("used").select(
        "source_id", none.alias("row_index"), F.lit("default_rate_assumed").alias("issue"),
        F.lit("rows without a rate of their own were checked at the standard rate").alias("detail"))
    issues = skipped.unionByName(wrong).unionByName(assumed).unionByName(_total_issues(all_lines, checked))
    return PeriodReturn(checked, issues, _headline(checked))


def apply_decisions(lines: DataFrame, decisions: DataFrame) -> PeriodReturn:
    """Settles purchases under review by ``decisions(item_id, reclaimable)``; undecided means not
    reclaimable."""
    pending = lines.filter(F.coalesce("needs_review", F.lit(False)))
    rest = lines.filter(~F.coalesce("needs_review", F.lit(False)))
    decided = pending.join(decisions.select("item_id", F.col("reclaimable").alias("decision")), "item_id", "left")
    settled = decided.withColumns({"reclaimable": F.coalesce("decision", F.lit(False)), "needs_review": F.lit(False)})
    out = rest.unionByName(settled.select(*rest.columns))
    return PeriodReturn(out, lines.sparkSession.createDataFrame([], "source_id string, row_index bigint, issue string, detail string"),
                        _headline(out))


def excluded_purchases(lines: DataFrame) -> DataFrame:
    return lines.filter((F.col("role") == "purchases") & ~F.col("reclaimable"))


def headline_rows(headline: DataFrame, lang: str = "en") -> DataFrame:
    keys = ("output_vat", "input_vat_total", "reclaimable_input_vat", "net_position")
    pairs = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("key"), F.col(k).cast(VAT).alias("value"))
                      for i, k in enumerate(keys)])
    return headline.select(F.inline(pairs)).withColumn("label", label(F.col("key"), lang))


def number_in_order(rows: DataFrame, name: str, block: int = 100_000) -> DataFrame:
    """Display numbers 0, 1, 2, … over (source_order, row_index), without a global window over rows.

    Rows are numbered inside blocks of at most ``block`` row indexes; the per-block counts, one row per block, are added up
    by ranges of blocks.
    """
    blocked = rows.withColumn("_block", F.floor(F.col("row_index") / block))
    counts = blocked.groupBy("source_order", "_block").agg(F.count(F.lit(1)).alias("_n"))
    offsets = with_running_totals(counts, ["source_order", "_block"], _offset=F.col("_n")).drop("_n")
    inside = Window.partitionBy("source_order", "_block").orderBy("row_index")
    return blocked.withColumn("_i", F.row_number().over(inside) - 1).join(offsets, ["source_order", "_block"]).withColumn(
        name, F.col("_i") + F.col("_offset")).drop("_block", "_i", "_offset")


def filing_note(headline: DataFrame, user_id: str, customer: str, period: str) -> DataFrame:
    """The note kept when a return's report is made."""
    money = lambda c: F.col(c).cast(M.MONEY).cast("string")
    return headline.filter(F.col("status") == "ready").select(
        F.lit(user_id).alias("user_id"), F.lit(customer).alias("customer_name"), F.lit("ready").alias("status"),
        F.concat(F.lit(f"Return for {period}: VAT on sales "), money("output_vat"), F.lit(", to reclaim "),
                 money("reclaimable_input_vat"), F.lit(", net "), money("net_position")).alias("notes"),
        F.current_timestamp().alias("created_at"))
