"""HTML pages to block text, as expressions: a new line at every block, a bar at every cell, single spaces elsewhere."""

from __future__ import annotations

import html as markup
from html import entities

from pyspark.sql import Column, DataFrame, Window, functions as F

from taxloom import constants as C

SEPARATOR = "\x1f"
# The form of references, names that need no semicolon, and numbers that do not stand for themselves.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"
OLD_NAMES = {k: v for k, v in entities.html5.items() if not k.endswith(";")}
ODD_NUMBERS = {str(n): markup.unescape(f"&#{n};") for n in (
    *range(0x20), *range(0x7F, 0xA0), *range(0xFDD0, 0xFDF0), *(plane + n for plane in range(0, 0x110000, 0x10000) for n in (0xFFFE, 0xFFFF)))}

TOKENS = r"(?s)<!--.*?(?:-->|\z)|</?[A-Za-z][^>]*>|<|[^<]+"


def _table(values: dict[str, str]) -> Column:
    """A fixed table as a map that the optimizer folds into one literal; no key and no value holds the separator."""
    return F.map_from_arrays(*[F.split(F.lit(SEPARATOR.join(x)), SEPARATOR) for x in (values.keys(), values.values())])


def decoded(text: Column) -> Column:
    """All character references of HTML5 as characters, in one pass, by the rules of ``html.unescape``: the semicolon may be missing after a
    number and after the names of old, which may also begin a longer word; other names stay as they are."""
    refs = F.regexp_extract_all(text, F.lit(REFERENCE), 0)

    def named(ref: Column) -> Column:
        name = F.substring(ref, 2, F.length(ref))
        old = F.regexp_extract(name, f"^(?:{'|'.join(sorted(OLD_NAMES, key=len, reverse=True))})", 0)
        begun = F.when(old != "", F.concat(F.try_element_at(_table(OLD_NAMES), old), F.substring(name, F.length(old) + 1, F.length(name))))
        return F.coalesce(F.try_element_at(_table(entities.html5), name), begun, ref)

    def numbered(ref: Column) -> Column:
        digits = F.regexp_extract(ref, "^&#[xX]?0*([0-9A-Fa-f]*);?$", 1)
        short = F.substring(digits, 1, 9)  # nine digits are beyond the last character in either notation
        number = F.coalesce(F.when(ref.rlike("^&#[xX]"), F.conv(short, 16, 10)).otherwise(F.conv(short, 10, 10)).cast("bigint"), F.lit(0))
        good = (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF) & (F.length(digits) < 9)
        plain = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(_table(ODD_NUMBERS), number.cast("string")), F.when(good, plain).otherwise(F.lit("\ufffd")))

    values = F.transform(refs, lambda ref: F.when(ref.startswith("&#"), numbered(ref)).otherwise(named(ref)))
    pieces = F.zip_with(F.split(text, REFERENCE), values, lambda t, value: F.concat(t, F.coalesce(value, F.lit(""))))
    return F.when(F.size(refs) > 0, F.array_join(pieces, "")).otherwise(text)


def block_text(html: Column) -> Column:
    """The text of markup whose unwanted elements are gone."""
    text = F.regexp_replace(html, r"(?s)<!--.*?(-->|\z)", "")
    for tag in C.HTML_SILENT_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?(</{tag}\s*>|\z)", "")
    text = F.regexp_replace(text, r"\s*(</?[A-Za-z!][^>]*>)\s*", "$1")
    text = F.regexp_replace(text, rf"(?i)<({'|'.join(C.HTML_BLOCK_TAGS)})(?=[\s/>])[^>]*>", "\n")
    text = F.regexp_replace(text, rf"(?i)<({'|'.join(C.HTML_CELL_TAGS)})(?=[\s/>])[^>]*>", " | ")
    text = decoded(F.regexp_replace(text, r"</?[A-Za-z!][^>]*>", " "))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n\s*\n+", "\n"), r"^\s+|\s+$", "")


def without_class(pages: DataFrame, skip_class: str) -> DataFrame:
    """The pages (``page_id, html``) without the elements of a class, whatever stands inside them.

    Tags become rows. Opening tags of one name and their ends are numbered by depth per name, so the end of an element is the next tag of
    its name and depth; void tags have no depth. What lies before the furthest end seen so far of a skipped element is dropped.
    """
    pages = pages.withColumn("__key", F.xxhash64("page_id", "html"))
    parts = pages.select("__key", "html").distinct().select("__key", F.posexplode(F.regexp_extract_all("html", F.lit(TOKENS), 0)).alias("pos", "token"))
    name = F.lower(F.regexp_extract("token", "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    step = F.when((F.col("name") == "") | F.col("name").isin(*C.HTML_VOID_TAGS), 0).when(F.col("token").startswith("</"), -1).otherwise(1)
    running = Window.partitionBy("__key", "name").orderBy("pos")
    tags = parts.withColumn("name", name).withColumn("step", step).where("step <> 0").withColumn("level", F.sum("step").over(running))
    tags = tags.withColumn("level", F.when(F.col("step") < 0, F.col("level") + 1).otherwise(F.col("level")))
    follows = F.lead("pos").over(Window.partitionBy("__key", "name", "level").orderBy("pos"))
    wanted = rf"(?i)\sclass\s*=\s*([\"']?)(?:[^\"'>]*\s)?{skip_class}(?:\s[^\"'>]*)?\1(?=[\s/>])"
    skipped = tags.withColumn("stop", F.coalesce(follows, F.lit(2**31 - 1))).where((F.col("step") > 0) & F.col("token").rlike(wanted)).select("__key", "pos", "stop")
    upto = Window.partitionBy("__key").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    kept = parts.join(skipped, ["__key", "pos"], "left").withColumn("hidden", F.coalesce(F.max("stop").over(upto) >= F.col("pos"), F.lit(False)))
    text = kept.where(~F.col("hidden")).groupBy("__key").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("__html"))
    return pages.join(text, "__key", "left").withColumn("html", F.when(F.col("html").isNotNull(), F.coalesce("__html", F.lit("")))).drop("__key", "__html")


def html_text(pages: DataFrame, skip_class: str | None = None) -> DataFrame:
    """``page_id, url, html`` to ``page_id, url, text``; a null page has a null text."""
    own = pages.select("page_id", "url", "html")
    return (without_class(own, skip_class) if skip_class else own).select("page_id", "url", block_text(F.col("html")).alias("text"))
