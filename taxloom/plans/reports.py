"""Report datasets and their sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame

from taxloom.operators import invoices, period


def invoice_report(checked: DataFrame) -> dict[str, DataFrame]:
    """A row per invoice, and the findings of flagged ones."""
    return {"summary": invoices.invoice_summary(checked), "issue_detail": invoices.issue_detail(checked)}


def filing_report(result: period.PeriodReturn, lang: str = "en") -> dict[str, DataFrame]:
    return {"headline": period.headline_rows(result.headline, lang)}


def workpapers(result: period.PeriodReturn, issues: DataFrame, lang: str = "en") -> dict[str, DataFrame]:
    """Headline, purchases left out with their reasons, and the consistency issues."""
    return {
        "headline": period.headline_rows(result.headline, lang),
        "excluded_purchases": period.excluded_purchases(result.lines).select(
            "source_id", "row_index", "label", "vat_amount", "reason_code", "keyword"),
        "issues": issues,
    }


def write_report(datasets: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Writes each dataset under ``folder``; nested columns need parquet or json."""
    for name, df in datasets.items():
        df.write.mode("overwrite").format(fmt).option("header", "true").save(f"{folder}/{name}")
