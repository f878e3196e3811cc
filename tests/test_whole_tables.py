"""What grows with a table is read once and never dealt by a key that few rows tell apart."""

import re

from pyspark.sql import functions as F

from taxloom.operators import invoices, match, period, summary
from taxloom.plans import lens, queries
from taxloom.session import settle
from taxloom.sources import registers, stores
from tests.helpers import ROWS


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_a_register_is_not_dealt_by_its_source(spark, sf):
    meta = registers.describe_sources(lens.register_meta(spark))
    lines = period.register_lines(lens.register_rows(spark, sf), period.select_sources(meta))
    assert "BroadcastHashJoin" in _plan(lines) and not re.search(r"hashpartitioning\(source_id#\d+, \d+\)", _plan(lines))


def test_lines_of_a_file_are_not_dealt_by_the_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Title\nNo,Note\n' + "".join(f'{i},"one\n""two"",{i}"\n' for i in range(50)))
    rows, _ = registers.read_registers(spark, str(tmp_path))
    assert not re.search(r"hashpartitioning\(source_id#\d+, \d+\)", _plan(rows))
    found = rows.orderBy("row_index").select("row_index", F.transform("cells", lambda c: c["value"]).alias("v")).collect()
    assert [(r.row_index, r.v) for r in found] == [(i, [str(i), f'one\n"two",{i}']) for i in range(50)]


def test_a_record_over_several_splits(spark):
    """Splits that begin inside quotes, one without any line outside them, and quotes that never close."""
    closed = [(0, 0, 'a,"b'), (0, 1, 'c"'), (0, 2, 'd,"e'), (10, 3, "f"), (10, 4, '""g""'), (20, 5, 'h"'), (20, 6, "i,j")]
    lost = [(0, 0, "a,b"), (0, 1, 'c,"d'), (10, 2, "e"), (10, 3, "f")]
    lines = spark.createDataFrame([(s, *x) for s, group in (("closed", closed), ("lost", lost)) for x in group],
                                  "source_id string, split bigint, position bigint, line string")
    found = sorted(tuple(r) for r in registers.join_records(lines).collect())
    assert found == [("closed", 0, 0, 'a,"b\nc"'), ("closed", 0, 2, 'd,"e\nf\n""g""\nh"'), ("closed", 20, 6, "i,j"),
                     ("lost", 0, 0, "a,b"), ("lost", 0, 1, 'c,"d'), ("lost", 10, 2, "e"), ("lost", 10, 3, "f")]


def test_findings_are_listed_from_one_check(spark, sf):
    plan = _plan(queries.QUERIES["issue_detail"](spark, sf))
    assert plan.count("FileScan") == 3  # headers, lines, suggestions


def test_suggestions_fill_only_lines_without_a_code(spark):
    one = spark.sql("""select 'x' filename, array(named_struct('line_id', l, 'description', 'd', 'taxable_base', b, 'tax_category_code', c)) line_items
                       from values ('1', 10.0, null), ('2', 10.0, 'S'), ('3', 10.0, 'what'), (null, 10.0, null), ('4', 10.0, null) t(l, b, c)""")
    whole = one.groupBy("filename").agg(F.flatten(F.collect_list("line_items")).alias("line_items"))
    said = spark.createDataFrame([("x", "1", "exempt"), ("x", "1", "zero_rated"), ("x", "2", "exempt"), ("x", "3", "exempt"), ("x", None, "exempt"),
                                  (None, "4", "exempt"), ("x", "4", "luxury")], "filename string, line_id string, tax_category string")
    found = {r.line_id: r.tax_category for r in invoices.category_resolution(whole, said).collect()}
    assert found == {"1": "zero_rated", "2": "standard", "3": "exempt", None: "standard", "4": "standard"}


def test_findings_in_the_order_of_their_lists(spark):
    checked = spark.sql(f"""select * from values
        ('a', 'flagged', array(named_struct('rule_id', 'r1', 'field', 'f', 'severity', 'error', 'message', 'm1'),
                               named_struct('rule_id', 'r2', 'field', 'f', 'severity', 'warning', 'message', 'm2')),
         cast(array(named_struct('field', 'total_vat', 'document_value', 1.5, 'recalculated_value', 2, 'within_tolerance', false)) as array<{invoices.MISMATCH}>)),
        ('b', 'clean', array(named_struct('rule_id', 'r3', 'field', 'f', 'severity', 'warning', 'message', 'm3')), null),
        ('c', 'flagged', array(named_struct('rule_id', 'r4', 'field', 'f', 'severity', 'error', 'message', 'm4')), null)
        t(filename, status, structural_issues, mismatches)""")
    found = [tuple(r) for r in invoices.issue_detail(checked).orderBy("filename", "part", "pos").collect()]
    assert found == [("a", "issue", 0, "error", "r1", "m1"), ("a", "issue", 1, "warning", "r2", "m2"),
                     ("a", "mismatch", 0, "error", "total_vat", "printed 1.50, recalculated 2.00"), ("c", "issue", 0, "error", "r4", "m4")]


def test_items_without_a_choice_go_around_the_join(spark):
    rows = spark.createDataFrame([("a1", 0, "a", None, None, 1, None), ("a2", 2, "a", None, None, 1, None), ("a3", 6, "a", None, None, 1, None)],
                                 ROWS.replace("decimal(24,6)", "int"))
    choice = F.when(F.col("row_id") == "a1", "c1").when(F.col("row_id") == "a3", "c2")
    items = settle(match.make_items(rows, item_id=F.col("row_id"), kind=F.lit("ambiguous"), row_a=match.as_struct(), choice_id=choice))
    candidates = spark.sql(
        f"select c choice_id, cast(named_struct('row_id', i, 'ordinal', o, 'source', 'b', 'reference', null, 'date', null, 'amount', 1, 'description', null) as {match.ROW}) candidate "
        "from values ('c1', 'b2', 2), ('c1', 'b1', 1) t(c, i, o)")
    for made in (lens.decisions(items, candidates), lens.accept_all(items, candidates), summary.exception_rows(items, candidates)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        joined = plan[plan.index("Join LeftOuter"):]
        left = joined[:joined.index("Aggregate")]  # the items; below them comes what there is per choice
        assert "isnotnull(choice_id" in left
        assert sorted(r.item_id for r in made.collect()) == ["a1", "a2", "a3"]
    picked = {r.item_id: r.selected_candidate_id for r in lens.accept_all(items, candidates).collect()}
    assert picked == {"a1": "b1", "a2": None, "a3": None}


def test_a_batch_is_made_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(k):
        seen.add(1)
        return f"v{k}"

    batch = spark.range(40).select(F.col("id"), named("id").alias("name"))
    stores.merge_snapshot(batch, str(tmp_path / "t"), 1, ["id"], lambda old, fresh: fresh.filter("name != ''"), 4)
    assert seen.value == 40
    assert not batch.storageLevel.useMemory
    assert stores.latest_snapshot(spark, str(tmp_path / "t"))[0].count() == 40
