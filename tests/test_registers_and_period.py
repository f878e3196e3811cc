"""Register files, column resolution and the period return."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from taxloom.functions import dates, money
from taxloom.operators import period
from taxloom.sources import columns, ledgers, registers

SALES = """Demo Trading — Output VAT register,,,,,
Period Q1 VAT No 310000000000003,,,,,

Invoice No,Date,Customer,Tax Category,Amount (SAR),Output VAT (SAR)
S-1,2024-01-05,Alpha,Standard 15%,"1,000.00",150.00
S-2,2024-01-06,Beta,Zero-rated (Export),500,0
TOTAL,,,,1500,{total}
"""
PURCHASES = """Purchase Ref,Date,Vendor,Expense Type,Amount (SAR),Input VAT (SAR),Reclaimable?
P-1,2024-01-05,V1,Office supplies,200,30,Y
P-2,2024-01-05,V2,Client entertainment,800,120,
P-3,2024-01-05,V3,Vehicle repair,3000,450,
TOTAL,,,,4000,600,
TOTAL reclaimable,,,,,30,
"""


def load(spark, folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text)
    rows, meta = registers.read_registers(spark, str(folder))
    return rows, registers.describe_sources(meta)


def test_period_return(spark, tmp_path):
    rows, meta = load(spark, tmp_path, sales=SALES.format(total="151.00"), bills=PURCHASES)
    sales = meta.filter("filename = 'sales.csv'").first()
    assert (sales.guessed_role, sales.business_name, sales.vat_number) == ("sales", "Demo Trading", "310000000000003")
    rates = meta.filter("guessed_role = 'purchases'").select("source_id", F.lit("standard").alias("rate_key"))
    p = period.period_return(rows, meta, None, rates)
    h = p.headline.first()
    assert (h.output_vat, h.input_vat_total, h.reclaimable_input_vat, h.net_position) == (150, 600, 30, 120)
    assert (h.status, h.pending_count) == ("awaiting_review", 1)
    assert [i.issue for i in p.issues.collect()] == ["total_differs"]
    yes = p.review_items.select("item_id", F.lit(True).alias("reclaimable"))
    done = period.apply_decisions(p.lines, yes).headline.first()
    assert (done.reclaimable_input_vat, done.net_position, done.status) == (480, -330, "ready")
    undecided = period.apply_decisions(p.lines, yes.limit(0)).headline.first()
    assert undecided.reclaimable_input_vat == 30
    numbers = period.number_in_order(p.purchases, "n").orderBy("n").select("n", "row_index").collect()
    assert [tuple(x) for x in numbers] == [(0, 0), (1, 1), (2, 2)]


def test_rows_without_a_rate(spark, tmp_path):
    text = "Ref,Customer,Amount,VAT\n1,A,1000,160\n2,B,1000,0\n3,C,600,90\n"
    rows, meta = load(spark, tmp_path, sales_book=text)
    issues = {i.issue for i in period.period_return(rows, meta).issues.collect()}
    assert issues == {"row_vat_differs", "default_rate_assumed"}
    no_vat = spark.createDataFrame([(meta.first().source_id, "ignore")], "source_id string, role string")
    assert period.period_return(rows, meta, no_vat).headline.first().sales_row_count == 0


def test_column_resolution(spark):
    cases = [["Doc No.", "Posting Date", "Address", "Cr", "Narration"], ["Total ", "AMOUNT", "Ref"], ["Amount", "amount.", "the ref no x"], [], None]
    got = columns.with_ledger_columns(spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, column_names array<string>")).orderBy("i").collect()
    assert got[0]["columns"].asDict() == {
        "reference": "Doc No.", "date": "Posting Date", "amount": None, "debit": None, "credit": "Cr", "description": "Narration"}
    assert got[1]["columns"]["amount"] == "AMOUNT"  # the first synonym counts, not the first header
    assert got[2]["columns"]["amount"] == "amount." and got[2]["columns"]["reference"] == "the ref no x"  # of equal headers the last
    assert set(got[3]["columns"].asDict().values()) == set(got[4]["columns"].asDict().values()) == {None}
    one = spark.createDataFrame([(["VAT Amount", "Net Amount (SAR)", "Vendor"],)], "column_names array<string>")
    found = columns.with_register_columns(one).first()["columns"]
    assert found["amount"] == "VAT Amount" and found["description"] == "Vendor"


def test_several_files_on_one_side(spark, tmp_path):
    for name in ("p.csv", "q.csv"):
        (tmp_path / name).write_text("Doc No,Posting Date,Debit,Credit\nA1,05/06/2026,0,12.50\nA2,2026-06-05,1,\n")
    (tmp_path / "r.csv").write_text("Name,City\nx,y\n")
    rows, meta = registers.read_registers(spark, str(tmp_path))
    got = ledgers.rows_from_tables(rows, meta, "a").collect()
    assert sorted((r.row_id, r.ordinal) for r in got) == [("a_0", 0), ("a_1", 1), ("a_2", 2), ("a_3", 3)]
    assert [r.source_id[-5:] for r in ledgers.unusable_documents(meta).collect()] == ["r.csv"]
    line = [("L1", "x", "10", "S", None), (None, "y", "5", "S", None)]
    docs = spark.createDataFrame([("i2", "2026-01-02", line), ("i1", "2026-01-01", line)],
                                 "filename string, issue_date string, line_items array<struct<line_id string, description string, taxable_base string, "
                                 "tax_category_code string, vat_amount string>>")
    got = sorted((r.ordinal, r.row_id) for r in ledgers.rows_from_invoices(docs, "b").collect())
    assert got == [(0, "b_L1"), (1, "b_1"), (2, "b_1:L1"), (3, "b_1:1")]


def test_ledger_rows_from_file(spark, tmp_path):
    (tmp_path / "gl.csv").write_text("Title\nDoc No,Posting Date,Debit,Credit\nA1,05/06/2026,0,SAR 12.50\nA2,2026-06-05,n/a,\nA3,2026-06-05,-7,\n")
    rows, meta = registers.read_registers(spark, str(tmp_path))
    got = {r.reference: (r.row_id, r.amount, r.date) for r in ledgers.rows_from_tables(rows, meta, "b").collect()}
    june = dt.date(2026, 6, 5)
    assert got == {"A1": ("b_0", Decimal("12.5"), june), "A3": ("b_2", Decimal(7), june)}


def test_parsing(spark):
    v = spark.createDataFrame([("SAR 1,234.56",), ("(500)",), ("12-34",), ("n/a",), ("1.234,56",)], "v string").select(
        money.parse_signed(F.col("v"))).collect()
    assert [x[0] for x in v] == [Decimal("1234.56"), Decimal(500), None, None, Decimal("1.23456")]
    day = dt.date(2024, 2, 3)
    texts = {"2024-02-03T10:00": day, "03/02/2024": day, "2/13/2024": dt.date(2024, 2, 13), "3 Feb 2024": day, "soon": None, "3-Feb-2024": day,
             "03/02/24": day, "3.2.24": day, "3-feb-24": day, "03/02/2024 14:30": day, "3 FEB 2024 9:05 am": day, "February 3, 2024": day, "Feb 3 2024": day,
             "03-02-2024 00:00:00": day, "31/31/24": None, "": None}
    d = spark.createDataFrame([(t,) for t in texts], "v string").select("v", dates.ledger_date(F.col("v")).alias("d")).collect()
    assert {r.v: r.d for r in d} == texts


def test_cells_beyond_the_header_are_kept(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Ref,Amount\nA,1,extra,more\nB\n")
    rows, _ = registers.read_registers(spark, str(tmp_path))
    got = [[(c["name"], c["value"]) for c in r.cells] for r in rows.orderBy("row_index").collect()]
    assert got == [[("Ref", "A"), ("Amount", "1"), ("Unnamed: 2", "extra"), ("Unnamed: 3", "more")], [("Ref", "B"), ("Amount", None)]]


def test_records_run_over_lines_and_splits(spark, tmp_path):
    """Files with line breaks, doubled quotes and commas inside quotes, cut into splits of a few bytes, against csv.reader."""
    import csv
    import io
    import random

    rng = random.Random(3)
    files, parts = {}, ["a", "b c", "", "1,5", 'say "x"', "two\nlines", "three\n\n\"l\"\nlines,", '""', "é" * 30, "\n", "x\ny"]
    for i in range(5):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator="\n", quoting=rng.choice([csv.QUOTE_MINIMAL, csv.QUOTE_ALL]))
        writer.writerow(["Ref", "Note", "Amount"])
        writer.writerows([f"r{k}", rng.choice(parts), rng.choice(parts + [str(k)])] for k in range(60))
        files[f"f{i}"] = out.getvalue()
    files["plain"] = "Ref,Note\nr1,5\" pipe\nr2,it\"s,3\n"
    files["open"] = 'Ref,Note\nr1,"two\nlines"\nr2,"never closed\nr3,x\nr4,y\n'
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    try:
        rows, meta = registers.read_registers(spark, str(tmp_path))
        got = {}
        for r in rows.join(meta.select("source_id", "filename"), "source_id").collect():
            got.setdefault(r["filename"][:-4], []).append((r["row_index"], [c["value"] for c in r["cells"]]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in files.items():
        expected = [x for x in list(csv.reader(io.StringIO(text)))[1:] if any(x)]
        if name == "open":
            expected = [["r1", "two\nlines"], ["r2", "never closed"], ["r3", "x"], ["r4", "y"]]
        values = [[v or "" for v in x] for _, x in sorted(got[name])]
        width = max(map(len, values))
        assert values == [x + [""] * (max(width if len(x) > 2 and name != "plain" else len(x), 2) - len(x)) for x in expected], name
