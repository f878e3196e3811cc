"""Text expressions: language, intent, names, markup, slugs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from taxloom import constants as C


def strip(text: Column) -> Column:
    """Trim any Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    t = strip(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def language(text: Column) -> Column:
    return F.when(text.rlike(r"[\u0600-\u06FF]"), "ar").otherwise("en")


def needs_translation(text: Column, target: Column) -> Column:
    return F.coalesce((text != "") & (language(text) != target), F.lit(False))


def intent(text: Column) -> Column:
    t = F.lower(text)
    return (
        F.when(t.rlike(CALCULATOR_WORDS), "calculator")
        .when(t.rlike(r"(?U)\b(" + "|".join(PRODUCT_WORDS) + r")\b"), "product_info")
        .otherwise("general")
    )


# Words that ask for a calculation, and phrases that ask about the product itself. Deployments add their product's name.
CALCULATOR_WORDS = r"(?U)\b(zatca|vat|calculate|calculator|compliance|tax)\b"
PRODUCT_WORDS = ["feature", "features", "what is", "how to use", "tell me about", "help me with"]


def strip_latex(text: Column) -> Column:
    """Plain text from simple LaTeX maths: delimiters go, fractions and signs are written out."""
    # What is replaced by what, in this order.
    rules = [
        (r"\\\[|\\\]", ""), (r"\\\(|\\\)", ""), (r"\$\$|\$", ""),
        (r"\\text\{([^{}]*)\}", "$1"), (r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "($1/$2)"),
        (r"\\times", "x"), (r"\\div", "/"), (r"\\cdot", "x"), (r"\\left|\\right", ""), (r" {2,}", " "),
    ]
    out = text
    for pattern, replacement in rules:
        out = F.regexp_replace(out, F.lit(pattern), F.lit(replacement))
    return F.array_join(F.transform(F.split(out, "\n"), strip), "\n")


# How people state their name.
NAME_PATTERNS = [
    r"(?iU)\bmy name is\s+([A-Za-z][\w' -]{0,40}?)(?:[.,!?]|\s+and\b|$)",
    r"(?iU)\bcall me\s+([A-Za-z][\w' -]{0,40}?)(?:[.,!?]|\s+and\b|$)",
    r"(?U)اسمي\s+([\u0600-\u06FF][\u0600-\u06FF\s]{0,40}?)(?:[.,!؟]|$)",
]


def stated_name(text: Column) -> Column:
    """A name given as "my name is …", "call me …" or the Arabic "my name"; three words at most."""
    patterns = NAME_PATTERNS
    tail = F.array(*[F.lit(w) for w in C.NAME_TRAILING_WORDS])

    def clean(pattern: str) -> Column:
        raw = F.regexp_replace(strip(F.regexp_extract(text, pattern, 1)), r"^['\"]+|['\"]+$", "")
        parts = words(raw)
        # Length of the name once closing courtesy words are taken off its end.
        kept = F.aggregate(
            F.transform(parts, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), F.lit(0),
            lambda n, p: F.when(F.array_contains(tail, F.regexp_replace(F.lower(p["w"]), r"^[.,!?]+|[.,!?]+$", "")), n)
            .otherwise(p["i"] + 1),
        )
        return F.when(kept.between(1, 3), F.array_join(F.slice(parts, 1, F.greatest(kept, F.lit(1))), " "))

    return F.coalesce(*[clean(p) for p in patterns])


def safe_file_name(text: Column) -> Column:
    return F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_")


def other_jurisdiction(text: Column) -> Column:
    """The first listed country whose name occurs anywhere in the lowered text."""
    t = F.lower(text)
    expr = None
    for keyword, country in C.OTHER_JURISDICTIONS:
        expr = F.when(t.contains(keyword), country) if expr is None else expr.when(t.contains(keyword), country)
    return expr


def western_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩", "0123456789")


def vat_number_in(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?U)\b3[0-9]{13}3\b", 0), F.lit(""))
