"""Passes 1 to 3 and review on the small cases of the fixtures."""

import pytest
from pyspark.sql import functions as F

from taxloom import session
from taxloom.operators import match, review, summary
from taxloom.plans import reconcile
from tests.helpers import kinds, row, rows


def passes(spark, a, b, **kw):
    return reconcile.simple_passes(rows(spark, a), rows(spark, b), **kw)


def test_all_outcomes_in_one_run(spark):
    a = [row("a0", 100, " inv-1 "), row("a1", 4200, "R2"), row("a2", 1000, "R3"),   # reference, mismatch, VAT gap
         row("a3", 77),                                                              # unique amount
         row("a4", 60, day=10),                                                      # one near, one far
         row("a5", 61, day=10), row("a6", 61, day=11),                               # two for one
         row("a7", 62, day=10),                                                      # two candidates
         row("a8", 64), row("a9", 64, day=40)]                                       # undated; its twin is dated
    b = [row("b0", 100, "INV 1"), row("b1", 4750, "r2"), row("b2", 1150, "r3"), row("b3", 77),
         row("b4", 60, day=11), row("b40", 60, day=25), row("b5", 61, day=12), row("b7", 62, day=9), row("b70", 62, day=12),
         row("b8", 64, day=41)]
    r = passes(spark, a, b)
    assert sorted((p.row_a.row_id, p.match_type) for p in r.matched.collect()) == [("a0", "reference"), ("a3", "amount_unique")]
    got = {i.item_id: (i.kind, i.n_candidates, i.possible_vat_gap) for i in r.items.collect()}
    assert got == {
        "review_amount_mismatch_a1": ("amount_mismatch", 0, False), "review_amount_mismatch_a2": ("amount_mismatch", 0, True),
        "review_a4": ("fuzzy_match", 1, False), "review_b40": ("unmatched", 0, False),
        "review_a5": ("ambiguous", 1, False), "review_a6": ("ambiguous", 1, False), "review_a7": ("ambiguous", 2, False),
        "review_a8": ("unmatched", 0, False), "review_a9": ("fuzzy_match", 1, False)}
    listed = r.items.join(r.candidates, "choice_id").select("item_id", "candidate.row_id").collect()
    assert sorted(map(tuple, listed)) == [("review_a5", "b5"), ("review_a6", "b5"), ("review_a7", "b7"), ("review_a7", "b70")]


def test_tolerance_and_days_are_parameters(spark):
    a, b = [row("a0", "500.00", day=0)], [row("b0", "500.50", day=0)]
    assert kinds(passes(spark, a, b).items) == ["unmatched", "unmatched"]
    assert kinds(passes(spark, a, b, tolerance="0.60").items) == ["fuzzy_match"]
    with pytest.raises(ValueError):
        passes(spark, a, b, days=-1)


def test_grid_keys(spark):
    keys = spark.createDataFrame([("100.004",), ("100.006",), ("100.005",), ("100.015",)], "v string").select(
        match.grid_key(F.col("v").cast("decimal(24,6)"), "0.01").cast("bigint")).collect()
    assert [k[0] for k in keys] == [10000, 10001, 10000, 10002]


def test_vat_gap_band(spark):
    ratios = spark.createDataFrame([("114.4",), ("114.5",), ("115.5",), ("115.6",)], "v string").select(
        match.is_vat_gap(F.lit(100).cast("decimal(24,6)"), F.col("v").cast("decimal(24,6)"))).collect()
    assert [r[0] for r in ratios] == [False, True, True, False]


def test_review_of_contested_items(spark):
    a = [row("a0", 50, day=0), row("a1", 50, day=1), row("a2", 9, day=0)]
    r = passes(spark, a, [row("b0", 50, day=0)])
    both = spark.createDataFrame([(i, "confirmed", None, "b0") for i in ("review_a0", "review_a1")],
                                 "item_id string, decision string, explanation string, selected_candidate_id string")
    _, bad = review.confirm(r.matched, review.apply_decisions(r.items, both), r.candidates)
    assert {(v.item_id, v.violation) for v in bad.collect()} == {("review_a0", "double_claim"), ("review_a1", "double_claim")}
    picks = spark.createDataFrame([("b0", "review_a1", False, None)],
                                  "candidate_id string, picked_item_id string, unsure boolean, explanation string")
    items = review.apply_group_decisions(r.items, r.candidates, picks)
    assert {i.item_id: i.decision for i in items.collect()} == {"review_a0": "dismissed", "review_a1": "confirmed", "review_a2": None}
    kept, bad = review.confirm(r.matched, items, r.candidates)
    assert bad.count() == 0 and kept.count() == 3
    pool_a, pool_b = review.leftover_pool(r.matched, items, r.candidates)
    assert sorted(x.row_id for x in pool_a.collect()) == ["a0", "a2"] and pool_b.count() == 0


def test_a_choice_is_listed_whole(spark):
    a = [row("a0", 50, day=0), row("a1", 50, day=0)]
    r = passes(spark, a, [row(f"b{i}", 50, day=0, ref=f"R{i}x{i}") for i in range(200)])
    cells = {e.item_id: e.side_b for e in summary.exception_rows(r.items, r.candidates).collect() if e.side_b}
    assert len(cells) == 2 and all(len(c.split("; ")) == 200 for c in cells.values())


def test_the_last_decision_counts(spark):
    a = [row("a0", 50, day=0), row("a1", 50, day=1)]
    r = passes(spark, a, [row("b0", 50, day=0)])
    twice = spark.createDataFrame([("review_a0", "confirmed", None, "b0", 1), ("review_a0", "dismissed", None, None, 2)],
                                  "item_id string, decision string, explanation string, selected_candidate_id string, decided_at int")
    items = review.apply_decisions(r.items, twice)
    assert {i.item_id: i.decision for i in items.collect()} == {"review_a0": "dismissed", "review_a1": None}


def test_second_round(spark):
    """Leftovers that add up join the reviewed items; their rows are no longer loose; the second review sees both."""
    a = [row("a0", 3000, day=0), row("a1", 3000, day=20), row("a2", 4000, day=40), row("a3", 7, day=1)]
    r = reconcile.reconcile(rows(spark, a), rows(spark, [row("b0", 10000, day=42)]))
    after = reconcile.second_round(r)
    assert kinds(after.items) == ["sum_match", "unmatched"]
    kept, bad = review.confirm(after.matched, after.items, after.candidates)
    assert kept.count() == 2 and bad.count() == 0


def test_scratch_leaves_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    with session.scratch(spark):
        assert session.settle(spark.range(3), "x").count() == 3 and list(tmp_path.iterdir())
    assert not list(tmp_path.iterdir())
