"""Reference numbers and description words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from taxloom import constants as C


def normalized_reference(ref: Column) -> Column:
    """Lower-case letters and digits of any script; nothing left gives null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(ref)), r"[^\p{L}\p{N}]", ""), F.lit(""))


def reference_prefix(ref: Column) -> Column:
    """Leading ASCII letters and one optional dash, if digits follow; else null."""
    t = F.trim(ref)
    return F.when(t.rlike(r"^[A-Za-z]*-?[0-9]"), F.upper(F.regexp_extract(t, r"^([A-Za-z]*-?)[0-9]+", 1)))


def description_tokens(text: Column) -> Column:
    """Distinct ASCII words of four letters or more that name the subject, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]{4,}"), F.lit(0))
    stop = F.array(*[F.lit(w) for w in C.DESCRIPTION_STOP_WORDS])
    return F.coalesce(F.sort_array(F.array_except(words, stop)), F.array().cast("array<string>"))
