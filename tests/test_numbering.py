"""Numbers that run over a whole table."""

from pyspark.sql import functions as F

from taxloom.operators import period
from taxloom.sources import ledgers
from taxloom.sources.numbering import with_running_totals


def test_running_totals_equal_a_plain_loop(spark):
    data = [(f"f{i * 7919 % 1000:04d}", i % 5 if i % 11 else None) for i in range(1000)]
    got = with_running_totals(spark.createDataFrame(data, "name string, n int"), ["name"], place=F.lit(1), before=F.col("n"))
    total, want = 0, []
    for place, (name, n) in enumerate(sorted(data)):
        want.append((name, n, place, total))
        total += n or 0
    assert sorted(map(tuple, got.collect())) == want


def test_running_totals_of_few_rows(spark):
    empty = spark.createDataFrame([], "k int, v int")
    assert with_running_totals(empty, ["k"], t=F.col("v")).collect() == []
    one = spark.createDataFrame([(None, 3), (1, 4)], "k int, v int")
    assert sorted(r.t for r in with_running_totals(one, ["k"], t=F.col("v")).collect()) == [0, 3]


def test_lines_of_ten_thousand_invoices_are_numbered_through(spark):
    line = F.struct(F.lit("L").alias("line_id"), F.lit("x").alias("description"), F.lit("1").alias("taxable_base"))
    docs = spark.range(10_000).select(F.format_string("i%05d", "id").alias("filename"), F.lit("2026-01-01").alias("issue_date"),
                                      F.array_repeat(line, F.lit(1) + (F.col("id") % 2).cast("int")).alias("line_items"))
    rows = ledgers.rows_from_invoices(docs, "a")
    ordinals = [r.ordinal for r in rows.orderBy("source_id", "ordinal").select("ordinal").collect()]
    assert ordinals == list(range(15_000))
    assert rows.select("row_id").distinct().count() == 10_000  # equal line ids of one invoice stay equal


def test_display_numbers_over_many_blocks(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("source_order"), (F.col("id") * 37).alias("row_index"))
    got = [(r.source_order, r.row_index) for r in period.number_in_order(rows, "n", block=100).orderBy("n").collect()]
    assert got == sorted((i % 3, i * 37) for i in range(500))
