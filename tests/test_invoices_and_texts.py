"""UBL files, the invoice check, chunking, ids and markup."""

import uuid
from decimal import Decimal

from pyspark.sql import functions as F

from taxloom.functions import ids, text
from taxloom.operators import chunks, html, invoices, vat
from taxloom.sources import ubl

XML = """<?xml version="1.0"?><Invoice xmlns="urn:x" xmlns:cac="c" xmlns:cbc="b"><cbc:IssueDate>2024-02-01</cbc:IssueDate>
<cac:AccountingSupplierParty><cac:Party><cac:PartyTaxScheme><cbc:CompanyID>{seller}</cbc:CompanyID></cac:PartyTaxScheme>
<cac:PartyLegalEntity><cbc:RegistrationName>Acme</cbc:RegistrationName></cac:PartyLegalEntity></cac:Party></cac:AccountingSupplierParty>
<cac:AccountingCustomerParty><cac:Party><cac:PartyLegalEntity><cbc:RegistrationName>Buyer</cbc:RegistrationName></cac:PartyLegalEntity></cac:Party></cac:AccountingCustomerParty>
<cac:TaxTotal><cbc:TaxAmount currencyID="SAR">{tax}</cbc:TaxAmount></cac:TaxTotal><cac:TaxTotal><cbc:TaxAmount>9</cbc:TaxAmount></cac:TaxTotal>
<cac:LegalMonetaryTotal><cbc:TaxInclusiveAmount currencyID="SAR">{total}</cbc:TaxInclusiveAmount></cac:LegalMonetaryTotal>
<cac:InvoiceLine><cbc:ID>1</cbc:ID><cbc:LineExtensionAmount currencyID="SAR">100.00</cbc:LineExtensionAmount><cac:Item><cbc:Name>Thing</cbc:Name>
<cac:ClassifiedTaxCategory><cbc:ID>{code}</cbc:ID></cac:ClassifiedTaxCategory></cac:Item></cac:InvoiceLine></Invoice>"""


def test_invoice_files(spark, tmp_path):
    good = dict(seller="310000000000003", tax="15.00", total="115.00", code="S")
    cases = {"good": good, "rounding": good | {"tax": "15.02", "total": "115.02"}, "wrong": good | {"tax": "15.10", "total": "115.10"},
             "number": good | {"seller": "12345"}, "suggested": good | {"code": "Q", "tax": "0", "total": "100"}}
    for name, values in cases.items():
        (tmp_path / f"{name}.xml").write_text(XML.format(**values))
    (tmp_path / "broken.xml").write_text("<Invoice><a>")
    (tmp_path / "other.xml").write_text("<Other>1</Other>")
    read = ubl.read_ubl(spark, str(tmp_path))
    hints = spark.createDataFrame([("suggested.xml", "1", "exempt")], "filename string, line_id string, tax_category string")
    got = {r.filename.split(".")[0]: r for r in invoices.check_invoices(read, "2025-01-01", hints).collect()}
    assert {n: r.status for n, r in got.items()} == {
        "good": "clean", "rounding": "clean", "wrong": "flagged", "number": "flagged", "suggested": "clean", "broken": "flagged", "other": "flagged"}
    assert [m.within_tolerance for m in got["rounding"].mismatches] == [True, True]
    assert [i.rule_id for i in got["broken"].structural_issues] == ["extraction_failed"]
    future = invoices.check_invoices(read.filter("filename = 'good.xml'"), "2023-01-01").first()
    assert [i.rule_id for i in future.structural_issues] == ["future_issue_date"]


def test_line_rounding(spark):
    data = [(1, "a", "x", Decimal("10.03"), "standard")] * 3 + [(2, "b", "x", Decimal("-500"), "standard")]
    lines = spark.createDataFrame(data, "invoice_id int, line_id string, description string, taxable_base decimal(24,6), tax_category string")
    got = {r.invoice_id: (r.total_vat, r.grand_total) for r in vat.invoice_totals(lines).collect()}
    assert got == {1: (Decimal("4.50"), Decimal("34.59")), 2: (Decimal("-75"), Decimal("-575"))}


def chunk(spark, body, lang="en", n=500):
    df = spark.createDataFrame([("Reg", lang, body)], "document_type string, language string, text string")
    return [(c.article_number, c.part_index, c.text, [r.article_number for r in c.references]) for c in chunks.chunk_documents(df, n).collect()]


def test_english_articles(spark):
    body = ("# COVER\nx\n# CHAPTER ONE\n## SCOPE OF TAX\nsee Article 5 and article forty-three\n## small note\nmore\n"
            "## ARTICLE TWELVE\ntwelve\n## NEXT TITLE\nArticle (15) : inline")
    assert [(c[0], c[3]) for c in chunk(spark, body)] == [("1", ["5", "43", "12"]), ("12", []), ("13", ["15"]), ("15", [])]


def test_arabic_and_fallback(spark):
    assert [c[:3] for c in chunk(spark, "مقدمة المادة ١: نص المادة 2: آخر", "ar")] == [
        ("1", 0, "Reg، المادة 1: نص"), ("2", 0, "Reg، المادة 2: آخر")]
    assert [c[0] for c in chunk(spark, "pre\n# One\na\n# Two\nb")] == ["fallback-1", "fallback-2"]
    assert [c[2] for c in chunk(spark, "a b c\n\nd e\n\nf g h", n=5)] == ["Reg, Section 1: a b c\n\nd e", "Reg, Section 2: f g h"]
    assert [c[1:3] for c in chunk(spark, "# Article 1\n" + "w " * 7, n=5)] == [
        (0, "Reg, Article 1: (part 1/2) w w w w w"), (1, "Reg, Article 1: (part 2/2) w w")]


def test_ids_markup_names(spark):
    one = spark.range(1)
    for value in ("a:b", "نظام:1"):
        assert one.select(ids.stable_id(F.lit(value))).first()[0] == str(uuid.uuid5(ids.NAMESPACE, value))
    tex = r"\[ VAT = \frac{15}{100} \times \text{Price} \]"
    assert one.select(text.strip_latex(F.lit(tex))).first()[0] == "VAT = (15/100) x Price"
    said = one.select(*[text.stated_name(F.lit(t)) for t in ("my name is Sara Ali please", "call me a b c d", "اسمي سارة.", "hello")]).first()
    assert tuple(said) == ("Sara Ali", None, "سارة", None)
    pages = [(1, "u", '<h2>T</h2><p>a <b>b</b></p><a class="skip">x<i>y</i></a><table><tr><td>1</td><td>2</td></tr></table>'),
             (2, "u", '<a class="x skip">x<br>y<a>n</a>m</a><p>b</p>'), (3, "u", "<style>p{}</style>q<script>var t='<p>';</script> &amp;lt; &#233;&#x20AC; 1 < 2"),
             (4, None, None), (5, "u", ""), (5, "u", ""), (6, "u", '<div class="skip">never closed <p>z'), (7, "u", "<p>one\n two</p>\n\n<p class='skipper'>three")]
    got = html.html_text(spark.createDataFrame(pages, "page_id long, url string, html string"), "skip").collect()
    assert sorted((r.page_id, r.text) for r in got if r.page_id != 4) == [
        (1, "T \na b \n | 1 | 2"), (2, "b"), (3, "q &lt; é€ 1 < 2"), (5, ""), (5, ""), (6, ""), (7, "one\n two \nthree")]
    assert [r.text for r in got if r.page_id == 4] == [None]


def test_html_references_are_all_decoded(spark):
    from html import entities, unescape

    texts = ["caf&eacute; &uuml;&szlig;&laquo;&ntilde;&raquo; &amp;eacute; &amp;lt; &lt;", "&notit; &copy2024 &eacute &nosuch; &nosuch & &; a&b&#", "&#233;&#xE9 &#0;&#128;&#x80;&#xD800;&#1114112;&#99999999999;&#00065;&#x1;&#xFFFE;&#x1F600;",
             "&#x00000041;&#120000000;&CounterClockwiseContourIntegral;&NotEqualTilde;", "".join(f"&{k}." for k in entities.html5), "", "plain"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", html.decoded(F.col("t")).alias("t")).collect()
    assert {r["i"]: r["t"] for r in got} == {i: unescape(t) for i, t in enumerate(texts)}
