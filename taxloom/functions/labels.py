"""Report labels in English and Arabic, as a small table joined by key (wording is this package's)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_LABELS = [
    ("reference", "Same reference", "نفس المرجع"),
    ("amount_unique", "Only equal amount", "المبلغ المساوي الوحيد"),
    ("amount_mismatch", "Amounts differ", "اختلاف في المبلغ"),
    ("vat_gap", "Amounts differ by about the VAT rate", "الفرق يقارب نسبة الضريبة"),
    ("fuzzy_match", "Likely pair", "زوج مرجح"),
    ("ambiguous", "More than one reading", "أكثر من تفسير"),
    ("contested", "Candidate wanted by several rows", "مرشح مطلوب من عدة قيود"),
    ("unmatched", "No counterpart", "بلا مقابل"),
    ("group_match", "Several rows add up, with a link", "مجموعة قيود مترابطة"),
    ("sum_match", "Several rows add up, no link", "مجموعة قيود بالمبلغ فقط"),
    ("confirmed", "Accepted", "مقبول"),
    ("dismissed", "Rejected", "مستبعد"),
    ("unresolved", "Open", "قيد البت"),
    ("clean", "In order", "سليمة"),
    ("flagged", "Needs attention", "تحتاج مراجعة"),
    ("output_vat", "VAT on sales", "ضريبة المبيعات"),
    ("input_vat_total", "VAT on purchases", "ضريبة المشتريات"),
    ("reclaimable_input_vat", "VAT to reclaim", "ضريبة قابلة للخصم"),
    ("net_position", "Net VAT (owed when positive)", "صافي الضريبة (مستحق إن كان موجبا)"),
]


def label_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_LABELS, "key string, en string, ar string")


def label(key: Column, lang: str = "en") -> Column:
    """The label for a key, or the key itself."""
    column = 2 if lang == "ar" else 1
    expr = None
    for row in _LABELS:
        expr = (F.when if expr is None else expr.when)(key == row[0], row[column])
    return expr.otherwise(key)
