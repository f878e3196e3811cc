"""Regulation text to article chunks, and the references between them.

All of it is expressions on the document row: a document's markers are found by one regular
expression, a fold over the (short) marker list numbers them, and bodies are cut by position. No shuffle
and no Python on the way; a long document is a long row, never a group.

Documents: ``document_type, language, text`` and whatever else is to be kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from taxloom import constants as C
from taxloom.functions.text import strip, western_digits, words

# The marker patterns.
ARABIC_MARKER = r"(?U)المادة\s+([0-9٠-٩]+)\s*:"
ARABIC_MENTION = r"(?U)المادة\s+([0-9٠-٩]+)"
HEADING = r"^#{1,6}[ \t]*"
COLON_TAG = r"\barticle\s*\(?([a-z-]+|[0-9]+)\)?\s*:"
ENGLISH_MARKER = rf"(?mid)(?:{HEADING}.*$)|(?:{COLON_TAG})"
ARTICLE_TAG = r"(?i)\barticle\s*\(?([a-z-]+|[0-9]+)\)?"
ENGLISH_MENTION = r"(?i)Articles?\s*\(?([A-Za-z-]+|[0-9]+)\)?"
CHAPTER = r"(?i)^(chapter|part)\b"

ARTICLES = "array<struct<article_number:string,body:string>>"


def _word_map() -> Column:
    """Number words to numbers. Compounds are resolved from their two halves."""
    pairs = [(w, i + 1) for i, w in enumerate(C.ONES)] + [(w, 20 + 10 * i) for i, w in enumerate(C.TENS)]
    return F.map_from_arrays(F.array(*[F.lit(w) for w, _ in pairs]), F.array(*[F.lit(n) for _, n in pairs]))


def article_number(token: Column) -> Column:
    """Digits or an English number word up to ninety-nine as canonical digits; anything else is null."""
    t = F.lower(token)
    one, tens = F.array(*[F.lit(w) for w in C.ONES]), F.array(*[F.lit(w) for w in C.TENS])
    parts = F.split(t, "[- ]", 2)
    head, tail = F.get(parts, 0), F.get(parts, 1)
    of = lambda w: F.try_element_at(_word_map(), w)
    compound = F.when(F.array_contains(tens, head) & F.array_contains(one, tail), of(head) + of(tail))
    return F.when(token.rlike(r"^[0-9]+$"), F.regexp_replace(token, r"^0+(?=[0-9])", "")).otherwise(
        F.coalesce(of(t), compound).cast("string"))


def looks_like_title(text: Column) -> Column:
    """At least 70 % of the letters are capitals (entities such as &amp; do not count)."""
    plain = F.regexp_replace(text, r"&(?:[A-Za-z]+|#[0-9]+|#x[0-9A-Fa-f]+);", "")
    letters = F.length(F.regexp_replace(plain, "[^A-Za-z]", ""))
    capitals = F.length(F.regexp_replace(plain, "[^A-Z]", ""))
    return (letters > 0) & (capitals >= letters * 0.7)


def arabic_articles(text: Column) -> Column:
    """Bodies between "article N:" markers; text before the first marker is dropped."""
    numbers = F.regexp_extract_all(text, F.lit(ARABIC_MARKER), F.lit(1))
    bodies = F.slice(F.split(text, ARABIC_MARKER), 2, 1_000_000_000)
    return F.zip_with(numbers, bodies, lambda n, b: F.struct(
        western_digits(n).alias("article_number"), strip(F.regexp_replace(strip(b), r"^[:\-،  ]+", "")).alias("body"))).cast(ARTICLES)


def english_articles(text: Column) -> Column:
    """Bodies between article boundaries.

    Boundaries are tagged headings, all-capital headings once a chapter or tag has been seen, and inline
    "Article N:" tags. An untagged boundary takes the previous number plus one. A body runs to the end of
    the next boundary's marker.
    """
    found = F.regexp_extract_all(text, F.lit(ENGLISH_MARKER), F.lit(0))
    between = F.split(text, ENGLISH_MARKER)
    # Three small steps, so that no pattern is evaluated twice for a marker.
    titled = F.filter(F.zip_with(found, between, lambda m, gap: F.struct(
        m.startswith("#").alias("heading"), strip(F.regexp_replace(m, HEADING, "")).alias("title"),
        (F.length(gap) + F.length(m)).alias("stop"))), lambda x: x["heading"].isNotNull())
    tokens = F.transform(titled, lambda x: F.struct(
        x["heading"].alias("heading"), x["title"].alias("title"), x["stop"].alias("stop"),
        F.regexp_extract(x["title"], ARTICLE_TAG, 1).alias("token")))
    numbers = F.transform(tokens, lambda x: F.struct(
        x["heading"].alias("heading"), x["title"].alias("title"), x["stop"].alias("stop"),
        F.when(x["token"] != "", article_number(x["token"])).alias("number")))
    markers = F.transform(numbers, lambda x: F.struct(
        F.when(x["number"].isNotNull(), "tag").when(~x["heading"] | (x["title"] == ""), "none")
        .when(x["title"].rlike(CHAPTER), "chapter").when(looks_like_title(x["title"]), "title").otherwise("none").alias("kind"),
        x["number"].alias("number"), x["stop"].alias("stop")))

    state = "struct<started:boolean,next:int,at:int,marks:array<struct<number:string,start:int>>>"
    zero = F.struct(F.lit(False).alias("started"), F.lit(1).alias("next"), F.lit(0).alias("at"),
                    F.array().cast("array<struct<number:string,start:int>>").alias("marks")).cast(state)

    def step(acc: Column, m: Column) -> Column:
        at = acc["at"] + m["stop"]
        started = acc["started"] | m["kind"].isin("tag", "chapter")
        number = F.when(m["kind"] == "tag", m["number"]).when(
            started & (m["kind"] == "title"), acc["next"].cast("string"))
        mark = F.struct(number.alias("number"), at.alias("start"))
        return F.struct(
            started.alias("started"),
            F.when(number.isNotNull(), number.try_cast("int") + 1).otherwise(acc["next"]).alias("next"), at.alias("at"),
            F.when(number.isNotNull(), F.array_append(acc["marks"], mark)).otherwise(acc["marks"]).alias("marks")).cast(state)

    marks = F.aggregate(markers, zero, step, lambda acc: acc["marks"])

    def body(mark: Column, i: Column, all_marks: Column) -> Column:
        stop = F.coalesce(F.get(all_marks, i + 1)["start"], F.length(text))
        return F.struct(mark["number"].alias("article_number"),
                        strip(F.substring(text, mark["start"] + 1, stop - mark["start"])).alias("body"))

    # Bound once to a one-element array so that the fold is not evaluated per article.
    return F.flatten(F.transform(F.array(marks), lambda ms: F.transform(ms, lambda m, i: body(m, i, ms)))).cast(ARTICLES)


def _sections_by_heading(text: Column) -> Column:
    pieces = F.split(text, r"(?m)(?=^#)")
    return F.filter(F.transform(F.filter(pieces, lambda p: p.startswith("#")), strip), lambda s: s != "")


def _sections_by_paragraph(text: Column, max_words: int) -> Column:
    """Paragraphs packed greedily: a new section starts where the word budget would be exceeded."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    state = "struct<done:array<string>,now:array<string>,used:int>"
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("done"), empty.alias("now"), F.lit(0).alias("used")).cast(state)

    def step(acc: Column, p: Column) -> Column:
        n = F.size(words(p))
        full = (F.size(acc["now"]) > 0) & (acc["used"] + n > max_words)
        return F.struct(
            F.when(full, F.array_append(acc["done"], F.array_join(acc["now"], "\n\n"))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.array_append(acc["now"], p)).alias("now"),
            F.when(full, n).otherwise(acc["used"] + n).alias("used")).cast(state)

    return F.aggregate(paragraphs, zero, step, lambda acc: F.when(
        F.size(acc["now"]) > 0, F.array_append(acc["done"], F.array_join(acc["now"], "\n\n"))).otherwise(acc["done"]))


def fallback_sections(text: Column, max_words: int = C.MAX_ARTICLE_WORDS) -> Column:
    """Sections of a text without articles: by headings if it has any, else packed paragraphs."""
    sections = F.when(text.rlike(r"(?m)^#"), _sections_by_heading(text)).otherwise(_sections_by_paragraph(text, max_words))
    return F.transform(sections, lambda s, i: F.struct(
        F.concat(F.lit("fallback-"), (i + 1).cast("string")).alias("article_number"), s.alias("body"))).cast(ARTICLES)


def context_header(document_type: Column, number: Column, language: Column) -> Column:
    section = F.regexp_extract(number, r"^fallback-([0-9]+)$", 1)
    plain = section == ""
    return F.when(language == "ar", F.concat(document_type, F.when(plain, F.lit("، المادة ")).otherwise("، القسم "),
                                             F.when(plain, number).otherwise(section), F.lit(":"))).otherwise(
        F.concat(document_type, F.when(plain, F.lit(", Article ")).otherwise(", Section "),
                 F.when(plain, number).otherwise(section), F.lit(":")))


def split_long(body: Column, body_words: Column, max_words: int) -> Column:
    """Pieces of at most ``max_words`` words; a body within the limit stays as it is."""
    n = F.ceil(F.size(body_words) / max_words).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
                      lambda i: F.array_join(F.slice(body_words, i * max_words + 1, F.lit(max_words)), " "))
    return F.when(F.size(body_words) <= max_words, F.array(body)).otherwise(cut)


def articles_of(text: Column, language: Column) -> Column:
    return F.when(language == "ar", arabic_articles(text)).otherwise(english_articles(text))


def references_in(text: Column, own: Column, language: Column) -> Column:
    """Distinct articles mentioned, in order of first mention, without the chunk's own number."""
    arabic = F.transform(F.regexp_extract_all(text, F.lit(ARABIC_MENTION), F.lit(1)), western_digits)
    english = F.transform(F.regexp_extract_all(text, F.lit(ENGLISH_MENTION), F.lit(1)), article_number)
    numbers = F.when(language == "ar", arabic).otherwise(english)
    kept = F.array_distinct(F.filter(numbers, lambda n: n.isNotNull() & (n != own)))
    return F.transform(kept, lambda n: F.struct(
        F.lit("article").alias("type"), n.alias("article_number"), F.lit(None).cast("string").alias("table_ref")))


def chunk_documents(documents: DataFrame, max_words: int = C.MAX_ARTICLE_WORDS) -> DataFrame:
    """One row per chunk: article_number, part_index, text, word_count, references."""
    keep = [c for c in documents.columns if c != "text"]
    lang = F.col("language")
    with_text = documents.filter(F.coalesce(F.col("text") != "", F.lit(False)))
    found = with_text.withColumn("articles", articles_of(F.col("text"), lang))
    whole = F.when(F.size("articles") > 0, F.col("articles")).otherwise(fallback_sections(F.col("text"), max_words))
    # The outer explode keeps Spark from evaluating the whole array a second time in an inferred filter.
    sections = found.select(*keep, F.posexplode_outer(whole).alias("section_index", "article")).filter(F.col("article").isNotNull())
    worded = sections.select(*keep, "section_index", "article.*", words(F.col("article.body")).alias("w"))
    parts = worded.select(*keep, "section_index", "article_number", split_long(F.col("body"), F.col("w"), max_words).alias("pieces"),
                          F.size("w").alias("n_words"))
    pieces = parts.select(*keep, "section_index", "article_number", "n_words", F.size("pieces").alias("n"),
                          F.posexplode_outer("pieces").alias("part_index", "piece"))
    suffix = F.when(F.col("n") > 1, F.format_string(" (part %d/%d)", F.col("part_index") + 1, F.col("n"))).otherwise("")
    header = context_header(F.col("document_type"), F.col("article_number"), lang)
    chunks = pieces.select(
        *keep, "section_index", "article_number", "part_index",
        F.concat(header, suffix, F.lit(" "), F.col("piece")).alias("text"), F.least(F.col("n_words") - F.col("part_index") * max_words, F.lit(max_words)).alias("word_count"))
    return chunks.withColumn("references", references_in(F.col("text"), F.col("article_number"), lang))
