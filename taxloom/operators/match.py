"""Reconciliation passes 1 to 3.

Rows on either side: ``row_id, ordinal, source, reference, date, amount, description``. ``row_id`` is
unique over both sides, ``ordinal`` within a side (input order).

Nothing here emits the pairs of a hot key: passes 1 and 2 need keys that occur once, which partial
aggregation finds, and pass 3 works on counted (amount, date) cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taxloom import constants as C
from taxloom.functions.money import AMOUNT, grid_key, is_vat_gap, dec
from taxloom.functions.refs import normalized_reference
from taxloom.operators import ranges as R

ROW_FIELDS = ["row_id", "ordinal", "source", "reference", "date", "amount", "description"]
ROW = ("struct<row_id:string,ordinal:bigint,source:string,reference:string,date:date,"
       "amount:decimal(24,6),description:string>")
ITEM_COLUMNS = ["item_id", "kind", "row_a", "row_b", "n_candidates", "choice_id", "group", "possible_vat_gap",
                "decision", "explanation", "selected_candidate_id"]


def as_struct(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + f).alias(f) for f in ROW_FIELDS]).cast(ROW)


def null_row() -> Column:
    return F.lit(None).cast(ROW)


def make_items(df: DataFrame, **columns: Column) -> DataFrame:
    """A frame of review items; columns not given are empty."""
    defaults = {
        "row_a": null_row(), "row_b": null_row(), "n_candidates": F.lit(0).cast("bigint"),
        "choice_id": F.lit(None).cast("string"), "group": F.array().cast(f"array<{ROW}>"),
        "possible_vat_gap": F.lit(False), "decision": F.lit(None).cast("string"),
        "explanation": F.lit(None).cast("string"), "selected_candidate_id": F.lit(None).cast("string"),
    }
    return df.select(*[columns.get(c, defaults.get(c)).alias(c) for c in ITEM_COLUMNS])


# --- passes 1 and 2 ------------------------------------------------------------------------------


def rows_with_unique_key(rows: DataFrame, key: Column) -> DataFrame:
    """(key, row) for keys that occur exactly once; a hot key is combined on the map side."""
    keyed = rows.select(key.alias("key"), as_struct().alias("row")).filter(F.col("key").isNotNull())
    return keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row")).filter(
        F.col("n") == 1).drop("n")


def match_unique(rows_a: DataFrame, rows_b: DataFrame, key: Column, match_type: str,
                 key_b: Column | None = None) -> DataFrame:
    """Pairs whose key, given by the caller, occurs once on each side: row_a, row_b, match_type."""
    a = rows_with_unique_key(rows_a, key).withColumnRenamed("row", "row_a")
    b = rows_with_unique_key(rows_b, key if key_b is None else key_b).withColumnRenamed("row", "row_b")
    return a.join(b, "key").select("row_a", "row_b", F.lit(match_type).alias("match_type"))


def match_reference(rows_a: DataFrame, rows_b: DataFrame, tolerance=C.AMOUNT_TOLERANCE) -> DataFrame:
    """Pass 1: pairs by reference, with ``agrees`` (amounts within tolerance) and the VAT-gap hint."""
    pairs = match_unique(rows_a, rows_b, normalized_reference(F.col("reference")), "reference")
    a, b = F.col("row_a.amount"), F.col("row_b.amount")
    return pairs.withColumn("agrees", F.abs(a - b) <= dec(tolerance)).withColumn(
        "possible_vat_gap", ~F.col("agrees") & is_vat_gap(a, b))


def match_amount(rows_a: DataFrame, rows_b: DataFrame, tolerance=C.AMOUNT_TOLERANCE) -> DataFrame:
    """Pass 2: pairs by amount on the tolerance grid."""
    return match_unique(rows_a, rows_b, grid_key(F.col("amount"), tolerance), "amount_unique")


def mismatch_items(pairs: DataFrame) -> DataFrame:
    wrong = pairs.filter(~F.col("agrees"))
    return make_items(
        wrong, item_id=F.concat(F.lit("review_amount_mismatch_"), F.col("row_a.row_id")), kind=F.lit("amount_mismatch"),
        row_a=F.col("row_a"), row_b=F.col("row_b"), possible_vat_gap=F.col("possible_vat_gap"))


def leftovers(rows: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    """Rows of one side that no pair has claimed."""
    return rows.join(pairs.select(F.col(f"row_{side}.row_id").alias("row_id")), "row_id", "left_anti").select(*ROW_FIELDS)


# --- pass 3 ------------------------------------------------------------------------------------------


def _cells(rows: DataFrame, side: str) -> DataFrame:
    """Rows counted by exact amount and date; undated rows never take part."""
    return (
        rows.filter(F.col("date").isNotNull() & F.col("amount").isNotNull())
        .groupBy(R.units(F.col("amount")).alias(f"{side}_units"), R.day_number(F.col("date")).alias(f"{side}_day"))
        .agg(F.count(F.lit(1)).alias(f"{side}_n"), F.min("ordinal").alias(f"{side}_ordinal"))
    )


def near_cells(rows_a: DataFrame, rows_b: DataFrame, tolerance=C.AMOUNT_TOLERANCE,
               days: int = C.DATE_PROXIMITY_DAYS) -> DataFrame:
    """Pairs of cells within tolerance and days of each other (bucketed on both)."""
    if days < 0:
        raise ValueError("days must be >= 0")
    tol = R.tolerance_units(tolerance)
    aw, dw = 2 * tol + 1, 2 * days + 1
    a, b = _cells(rows_a, "a"), _cells(rows_b, "b")
    a = a.withColumn("ab", F.explode(R.bucket_range(F.col("a_units") - tol, F.col("a_units") + tol, aw))).withColumn(
        "db", F.explode(R.bucket_range(F.col("a_day") - days, F.col("a_day") + days, dw)))
    b = b.withColumn("ab", R.bucket(F.col("b_units"), aw)).withColumn("db", R.bucket(F.col("b_day"), dw))
    near = (F.abs(F.col("a_units") - F.col("b_units")) <= tol) & (F.abs(F.col("a_day") - F.col("b_day")) <= days)
    return a.join(b, ["ab", "db"]).filter(near).drop("ab", "db")


def _with_cell(rows: DataFrame, side: str) -> DataFrame:
    return rows.withColumn(f"{side}_units", R.units(F.col("amount"))).withColumn(
        f"{side}_day", R.day_number(F.col("date")))


def contention(cells: DataFrame) -> DataFrame:
    """Per b-cell, how many a-rows want each of its rows."""
    return cells.groupBy("b_units", "b_day").agg(F.sum("a_n").alias("n_wanting"))


def fuzzy_statistics(cells: DataFrame) -> DataFrame:
    """Per a-cell: number of candidates, and the sole candidate and its contention where there is one."""
    return cells.join(contention(cells), ["b_units", "b_day"]).groupBy("a_units", "a_day").agg(
        F.sum("b_n").alias("n_candidates"), F.max("n_wanting").alias("n_wanting"),
        F.max("b_ordinal").alias("candidate_ordinal"))


def choice_key() -> Column:
    return F.concat_ws("@", F.col("a_units").cast("string"), F.col("a_day").cast("string"))


def classify_fuzzy(rows_a: DataFrame, rows_b: DataFrame, cells: DataFrame) -> DataFrame:
    """Pass 3 items: one per a-row (fuzzy_match, ambiguous or unmatched) and one per b-row nobody wants."""
    stats = fuzzy_statistics(cells)
    a = _with_cell(rows_a, "a").join(stats, ["a_units", "a_day"], "left").withColumn(
        "n_candidates", F.coalesce("n_candidates", F.lit(0)).cast("bigint"))
    sole = (F.col("n_candidates") == 1) & (F.col("n_wanting") == 1)
    a = a.withColumn("kind", F.when(F.col("n_candidates") == 0, "unmatched").when(sole, "fuzzy_match").otherwise("ambiguous"))
    item_id = F.concat(F.lit("review_"), F.col("row_id"))
    b_side = rows_b.select(F.col("ordinal").alias("candidate_ordinal"), as_struct().alias("found_b"))
    paired = a.filter(F.col("kind") == "fuzzy_match").join(b_side, "candidate_ordinal")
    fuzzy = make_items(paired, item_id=item_id, kind=F.col("kind"), row_a=as_struct(), row_b=F.col("found_b"),
                       n_candidates=F.col("n_candidates"))
    rest = make_items(a.filter(F.col("kind") != "fuzzy_match"), item_id=item_id, kind=F.col("kind"), row_a=as_struct(),
                      n_candidates=F.col("n_candidates"),
                      choice_id=F.when(F.col("kind") == "ambiguous", choice_key()))
    lonely_b = _with_cell(rows_b, "b").join(cells.select("b_units", "b_day").distinct(), ["b_units", "b_day"], "left_anti")
    unmatched_b = make_items(lonely_b, item_id=item_id, kind=F.lit("unmatched"), row_b=as_struct())
    return fuzzy.unionByName(rest).unionByName(unmatched_b)


def choices(rows_b: DataFrame, cells: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates of ambiguous items, factored: (choice_id, candidate row).

    Items of equal amount and date share one choice, so this stays linear in the b-rows even where a
    third of both sides is the same transaction.
    """
    wanted = items.filter(F.col("kind") == "ambiguous").select("choice_id").distinct()
    shared = cells.withColumn("choice_id", choice_key()).join(wanted, "choice_id", "left_semi")
    b = _with_cell(rows_b, "b").select("b_units", "b_day", as_struct().alias("candidate"))
    return shared.select("choice_id", "b_units", "b_day").join(b, ["b_units", "b_day"]).select("choice_id", "candidate")


def join_choices(items: DataFrame, per_choice: DataFrame) -> DataFrame:
    """``items`` left-joined with one row per ``choice_id``. Most items have no choice; they go around the join, where their null
    keys would all meet in one task."""
    named = items.filter(F.col("choice_id").isNotNull()).join(per_choice, "choice_id", "left")
    return named.unionByName(items.filter(F.col("choice_id").isNull()), allowMissingColumns=True)


def fuzzy_candidates(rows_a: DataFrame, rows_b: DataFrame, tolerance=C.AMOUNT_TOLERANCE,
                     days: int = C.DATE_PROXIMITY_DAYS) -> DataFrame:
    """Candidate counts of every a-row that has any: row_id, n_candidates, n_wanting (most contested)."""
    stats = fuzzy_statistics(near_cells(rows_a, rows_b, tolerance, days))
    return _with_cell(rows_a, "a").join(stats, ["a_units", "a_day"]).select("row_id", "n_candidates", "n_wanting")
