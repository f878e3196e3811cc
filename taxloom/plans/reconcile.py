"""The reconciliation jobs: passes 1 to 4, the second look at leftovers, and the report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from taxloom import constants as C
from taxloom.operators import groups, match, ranges, review, summary
from taxloom.session import settle


@dataclass
class Reconciliation:
    """matched: row_a, row_b, match_type. items: see ``match.ITEM_COLUMNS``.
    candidates: (choice_id, candidate) for ambiguous items; an item's ``choice_id`` names its list."""

    matched: DataFrame
    items: DataFrame
    candidates: DataFrame
    params: dict = field(default_factory=dict)

    def params_frame(self) -> DataFrame:
        spark = self.matched.sparkSession
        return spark.createDataFrame([(self.params["days"], str(self.params["tolerance"]))],
                                     "days int, tolerance string")


def _checked(days: int, tolerance) -> None:
    if days < 0:
        raise ValueError("days must be >= 0")
    ranges.tolerance_units(tolerance)


def simple_passes(rows_a: DataFrame, rows_b: DataFrame, days: int = C.DATE_PROXIMITY_DAYS,
                  tolerance=C.AMOUNT_TOLERANCE) -> Reconciliation:
    """Passes 1 to 3. Each pass settles what it claimed, so later ones start from a stored table."""
    _checked(days, tolerance)
    rows_a, rows_b = rows_a.select(*match.ROW_FIELDS), rows_b.select(*match.ROW_FIELDS)
    by_ref = settle(match.match_reference(rows_a, rows_b, tolerance), "by_reference")
    left_a, left_b = (settle(match.leftovers(r, by_ref, s), "left") for r, s in ((rows_a, "a"), (rows_b, "b")))
    by_amount = settle(match.match_amount(left_a, left_b, tolerance), "by_amount")
    left_a, left_b = (settle(match.leftovers(r, by_amount, s), "left") for r, s in ((left_a, "a"), (left_b, "b")))
    cells = settle(match.near_cells(left_a, left_b, tolerance, days), "cells")
    fuzzy = match.classify_fuzzy(left_a, left_b, cells)
    matched = by_ref.filter("agrees").select("row_a", "row_b", "match_type").unionByName(by_amount)
    items = settle(match.mismatch_items(by_ref).unionByName(fuzzy), "items")
    candidates = settle(match.choices(left_b, cells, items), "candidates")
    return Reconciliation(matched, items, candidates, {"days": days, "tolerance": tolerance})


def unmatched_pools(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    loose = items.filter(F.col("kind") == "unmatched")
    return tuple(loose.filter(F.col(f"row_{s}").isNotNull()).select(f"row_{s}.*") for s in ("a", "b"))


def reconcile(rows_a: DataFrame, rows_b: DataFrame, days: int = C.DATE_PROXIMITY_DAYS,
              tolerance=C.AMOUNT_TOLERANCE) -> Reconciliation:
    """All four automatic passes."""
    first = simple_passes(rows_a, rows_b, days, tolerance)
    pool_a, pool_b = unmatched_pools(first.items)
    grouped = settle(groups.group_matches(pool_a, pool_b, tolerance, days), "groups")
    taken = grouped.select(F.explode(F.concat(
        F.array("row_a.row_id", "row_b.row_id"), F.transform("group", lambda g: g["row_id"]))).alias("row_id")).filter(
        F.col("row_id").isNotNull())
    loose = F.col("kind") == "unmatched"
    still = first.items.filter(loose).withColumn(
        "row_id", F.coalesce(F.col("row_a.row_id"), F.col("row_b.row_id"))).join(taken, "row_id", "left_anti").select(
        *match.ITEM_COLUMNS)
    items = first.items.filter(~loose).unionByName(still).unionByName(grouped)
    return Reconciliation(first.matched, items, first.candidates, first.params)


def reconcile_leftovers(matched: DataFrame, items: DataFrame, candidates: DataFrame, tolerance=C.AMOUNT_TOLERANCE,
                        max_days: int = C.SUM_MATCH_MAX_DAYS) -> DataFrame:
    """Pass 5 over the rows a finished review left open: the new items alone (see ``second_round``)."""
    _checked(max_days, tolerance)
    pool_a, pool_b = review.leftover_pool(matched, items, candidates)
    return groups.leftover_sums(settle(pool_a, "pool"), settle(pool_b, "pool"), tolerance, max_days)


def second_round(reviewed: Reconciliation, max_days: int = C.SUM_MATCH_MAX_DAYS) -> Reconciliation:
    """The state after a finished first review: stale items are gone, the sums found among leftovers stand beside the reviewed
    items and wait for decisions, and rows that a new item takes are no longer listed as unmatched. Decide with ``review.apply_decisions`` and
    check with ``review.confirm`` as in the first round."""
    kept = settle(review.drop_stale_unmatched(reviewed.matched, reviewed.items), "kept")
    found = settle(reconcile_leftovers(reviewed.matched, kept, reviewed.candidates, reviewed.params.get("tolerance", C.AMOUNT_TOLERANCE), max_days), "sums")
    taken = found.select(F.explode(F.concat(F.array("row_a.row_id", "row_b.row_id"), F.transform("group", lambda g: g["row_id"]))).alias("row_id")).filter(
        F.col("row_id").isNotNull()).distinct()
    loose = F.col("kind") == "unmatched"
    still = kept.filter(loose).withColumn("row_id", F.coalesce(F.col("row_a.row_id"), F.col("row_b.row_id"))).join(
        taken, "row_id", "left_anti").select(*kept.columns)
    return Reconciliation(reviewed.matched, kept.filter(~loose).unionByName(still).unionByName(found.select(*kept.columns)), reviewed.candidates, reviewed.params)


def reconciliation_report(result: Reconciliation, lang: str = "en") -> dict[str, DataFrame]:
    """The report's datasets: summary, matched pairs, exceptions, and all candidates."""
    return {
        "summary": summary.reconciliation_summary(result.matched, result.items, result.candidates),
        "matched": result.matched,
        "exceptions": summary.exception_rows(result.items, result.candidates, lang),
        "candidates": result.candidates,
    }
