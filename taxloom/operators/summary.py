"""Control totals, counts and the exception report of a reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taxloom.functions import money as M
from taxloom.functions.labels import label
from taxloom.operators.match import join_choices
from taxloom.operators.review import confirmed


def control_totals(matched: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: matched amount per side, and grand total per side over distinct rows."""
    pairs = matched.select(F.explode(F.array("row_a", "row_b")).alias("row"))
    direct = items.select(F.explode(F.concat(F.array("row_a", "row_b"), "group")).alias("row"))
    listed = candidates.join(items.filter(F.col("kind") == "ambiguous").select("choice_id").distinct(),
                             "choice_id", "left_semi").select(F.col("candidate").alias("row"))
    rows = pairs.unionByName(direct).unionByName(listed).filter(F.col("row").isNotNull())
    distinct = rows.groupBy("row.row_id").agg(F.max("row.source").alias("source"), F.max("row.amount").alias("amount"))
    grand = distinct.agg(*[
        F.coalesce(F.sum(F.when(F.col("source") == s, F.coalesce("amount", F.lit(0)))), F.lit(0)).cast(M.AMOUNT)
        .alias(f"grand_total_{s}") for s in ("a", "b")])
    hit = matched.agg(*[
        F.coalesce(F.sum(f"row_{s}.amount"), F.lit(0)).cast(M.AMOUNT).alias(f"matched_amount_{s}") for s in ("a", "b")],
        F.count(F.lit(1)).alias("matched_count"))
    one = F.lit(1).alias("one")
    return hit.select("*", one).join(grand.select("*", one), "one").drop("one")


def item_counts(items: DataFrame) -> DataFrame:
    kind = F.col("kind")
    return items.agg(
        F.count_if(kind == "amount_mismatch").alias("mismatch_count"),
        F.count_if(kind == "group_match").alias("group_match_count"),
        F.count_if(kind == "sum_match").alias("sum_match_count"),
        F.count_if(~kind.isin("amount_mismatch", "group_match", "sum_match")).alias("other_exception_count"),
        F.count_if(confirmed()).alias("confirmed"),
        F.count_if(F.coalesce(F.col("decision") == "dismissed", F.lit(False))).alias("dismissed"),
        F.count_if(~F.coalesce(F.col("decision").isin("confirmed", "dismissed"), F.lit(False))).alias("unresolved"),
    )


def reconciliation_summary(matched: DataFrame, items: DataFrame, candidates: DataFrame) -> DataFrame:
    """Totals, counts and the share reconciled per side (null where a side is empty)."""
    one = F.lit(1).alias("one")
    both = control_totals(matched, items, candidates).select("*", one).join(item_counts(items).select("*", one), "one")
    pct = lambda s: F.try_divide(F.col(f"matched_amount_{s}") * 100, F.col(f"grand_total_{s}")).cast("decimal(18,6)")
    return both.drop("one").withColumns({"pct_a": pct("a"), "pct_b": pct("b")})


def row_text(row: Column) -> Column:
    """``reference: description``, a dash for a missing reference."""
    ref = F.coalesce(F.nullif(row["reference"], F.lit("")), F.lit("-"))
    desc = F.nullif(row["description"], F.lit(""))
    return F.when(desc.isNotNull(), F.concat(ref, F.lit(": "), desc)).otherwise(ref)


def group_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, row_text), "; ")


def group_total(rows: Column) -> Column:
    return F.aggregate(rows, F.lit(0).cast(M.AMOUNT),
                       lambda acc, r: (acc + F.coalesce(r["amount"], F.lit(0))).cast(M.AMOUNT))


def candidate_text(candidates: DataFrame) -> DataFrame:
    """Per choice: the texts of all its candidates in input order, and the first one's amount.

    A choice is a list that many items may share; its text is made once and joined to them by ``choice_id``.
    """
    listed = candidates.groupBy("choice_id").agg(
        F.min_by("candidate.amount", "candidate.ordinal").alias("candidate_amount"),
        F.array_sort(F.collect_list(F.struct("candidate.ordinal", row_text(F.col("candidate")).alias("t")))).alias("l"))
    return listed.select("choice_id", "candidate_amount", F.array_join(F.transform("l", lambda x: x["t"]), "; ").alias("candidates"))


def exception_rows(items: DataFrame, candidates: DataFrame, lang: str = "en") -> DataFrame:
    """The nine report columns per item (plus its id)."""
    i = join_choices(items, candidate_text(candidates))
    kind, a, b = F.col("kind"), F.col("row_a"), F.col("row_b")
    grouped = kind.isin("group_match", "sum_match")
    single_is_b = grouped & b["row_id"].isNotNull()
    text, total = group_text(F.col("group")), group_total(F.col("group"))
    ambiguous = kind == "ambiguous"
    amount_a = F.when(single_is_b, total).otherwise(a["amount"])
    amount_b = (F.when(single_is_b, b["amount"]).when(grouped, total).when(ambiguous, F.col("candidate_amount"))
                .otherwise(b["amount"]))
    vat_hint = (kind == "amount_mismatch") & F.col("possible_vat_gap")
    name = (
        F.when(vat_hint, F.concat(label(F.lit("vat_gap"), lang), F.lit(": "), M.format_amount(a["amount"]), F.lit(" / "),
                                  M.format_amount(b["amount"])))
        .when(ambiguous & (F.col("n_candidates") == 1),
              F.concat(label(kind, lang), F.lit(" ("), label(F.lit("contested"), lang), F.lit(")")))
        .otherwise(label(kind, lang)))
    blank = F.lit("")
    return i.select(
        "item_id", name.alias("exception_type"),
        F.coalesce(F.when(single_is_b, b["reference"]).when(a["row_id"].isNotNull(), a["reference"])
                   .otherwise(b["reference"]), blank).alias("reference"),
        F.coalesce(F.when(single_is_b, text).otherwise(a["description"]), blank).alias("side_a"),
        M.format_amount(amount_a).alias("amount_a"),
        F.coalesce(F.when(single_is_b, b["description"]).when(grouped, text).when(ambiguous, F.col("candidates"))
                   .otherwise(b["description"]), blank).alias("side_b"),
        M.format_amount(amount_b).alias("amount_b"),
        M.format_difference(amount_a, amount_b).alias("difference"),
        label(F.coalesce("decision", F.lit("unresolved")), lang).alias("status"),
        F.coalesce("explanation", blank).alias("explanation"),
    )


def exception_findings(items: DataFrame, candidates: DataFrame) -> DataFrame:
    """One line of text per item, the input of an external narrator, with a sort key."""
    rows = exception_rows(items, candidates)
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    return rows.select("item_id", F.concat_ws(
        " | ", F.concat(F.lit("* "), F.col("exception_type")),
        F.concat(F.lit("ours "), dash("side_a"), F.lit(" "), dash("amount_a")),
        F.concat(F.lit("theirs "), dash("side_b"), F.lit(" "), dash("amount_b")),
        F.col("status"), dash("explanation")).alias("finding"))
