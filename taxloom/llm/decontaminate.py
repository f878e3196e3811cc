"""Benchmark decontamination with a positional inverted index. DataFrame functions only.

1. Every benchmark item is cut into windows of 13 words (a shorter item is one window); equal windows are kept once.
2. The number of documents that hold each benchmark word is counted. A window's *anchors* are its rarest words.
3. The index stores postings (word, document, positions) of the documents for anchor words, as a table in the shared folder.
4. A posting of an anchor at offset o in a window says "the window may start at position - o". Starts that all anchors of the window agree
   on are its candidates: an intersection of offset-adjusted posting lists that begins with the rarest words.
5. Exact phrase matches are the candidates whose words all agree; proximity matches are windows whose anchors lie close together in any order.

Rows are told apart by ``doc_id`` and a hash of the text, so equal ids with different texts are judged alone; repeated rows are judged alike.
Null or empty texts have no words: no window, no match. Null item ids count as the empty string. Empty tables give no matches. Other
columns are kept by ``mark_hits``, except ``n_words, n_hit, items, contaminated``, which it replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from taxloom.llm.names import unused
from taxloom.llm.sizes import if_small
from taxloom.session import settle

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 13
ANCHORS = 2
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Runs of digits, letters (A-Z lower-cased) and all characters beyond ASCII."""
    whole = F.coalesce(text, F.lit(""))
    # lower() is quick but also changes letters beyond ASCII, so it serves only texts without them.
    low = F.when(F.octet_length(whole) == F.length(whole), F.lower(whole)).otherwise(F.translate(whole, UPPER, LOWER))
    return F.array_remove(F.split(low, NOT_WORD), "")


def windows_of(benchmark: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """One row per distinct window: ``window_id, words, phrase, items`` (item ids as strings)."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("w"))
    n = F.size("w")
    starts = F.when(n >= size, F.sequence(F.lit(0), n - size)).when(n > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    cut = items.withColumn("n", n).where("n > 0").select("item", "w", F.explode(starts).alias("start"))
    cut = cut.select("item", F.slice("w", F.col("start") + 1, F.lit(size)).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(
        F.sha2(F.array_join("words", " "), 256).alias("window_id"), "words", F.array_join("words", " ").alias("phrase"), "items")


def document_frequencies(words: DataFrame, terms: DataFrame) -> DataFrame:
    """For each of the ``terms`` the number of documents that hold it; ``words`` has an array ``w``."""
    held = words.select(F.explode(F.array_distinct("w")).alias("term"))
    found = held.join(if_small(terms), "term").groupBy("term").agg(F.count("*").alias("df"))
    return found


def anchors_of(windows: DataFrame, frequencies: DataFrame, anchors: int = ANCHORS) -> DataFrame:
    """``term, window_id, offset, needed``: the rarest distinct words of each window whose words all occur in the documents."""
    terms = windows.select("window_id", F.size(F.array_distinct("words")).alias("distinct"), F.posexplode("words").alias("offset", "term"))
    first = terms.groupBy("window_id", "distinct", "term").agg(F.min("offset").alias("offset"))
    known = first.join(frequencies, "term")
    by_rarity = Window.partitionBy("window_id").orderBy("df", "term")
    ranked = known.withColumns({"rank": F.row_number().over(by_rarity), "there": F.count("*").over(Window.partitionBy("window_id"))})
    return ranked.where((F.col("there") == F.col("distinct")) & (F.col("rank") <= anchors)).select(
        "term", "window_id", "offset", F.least(F.col("distinct"), F.lit(anchors)).alias("needed"))


def build_index(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings ``term, doc_id, text_hash, position`` of the documents for the given terms."""
    words = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    return words.select("doc_id", "text_hash", F.posexplode("w").alias("position", "term")).join(if_small(terms), "term").select(
        "term", "doc_id", "text_hash", "position")


def candidates_of(index: DataFrame, anchors: DataFrame) -> DataFrame:
    """Starts on which all anchors of a window agree: ``doc_id, text_hash, window_id, start``."""
    shifted = index.join(if_small(anchors), "term").select("doc_id", "text_hash", "window_id", (F.col("position") - F.col("offset")).alias("start"),
                                                           "offset", "needed").where("start >= 0")
    return shifted.groupBy("doc_id", "text_hash", "window_id", "start").agg(
        F.size(F.collect_set("offset")).alias("agreed"), F.max("needed").alias("needed")).where("agreed = needed").drop("agreed", "needed")


def proximity_of(index: DataFrame, anchors: DataFrame, slack: int) -> DataFrame:
    """Windows whose anchors occur within ``slack`` words of each other, in any order: ``doc_id, text_hash, window_id, first, last``.

    The nearest earlier posting of another anchor of the window is looked up by a running window, so no pairs are formed. With two anchors
    this finds every close pair; with more it is a chain of close anchors.
    """
    here = index.join(if_small(anchors), "term").select("doc_id", "text_hash", "window_id", "position", "offset", "needed")
    order = Window.partitionBy("doc_id", "text_hash", "window_id").orderBy("position")
    run = F.lag("position").over(order)
    grouped = here.withColumn("new", F.coalesce((F.col("position") - run > slack).cast("int"), F.lit(1)))
    grouped = grouped.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("doc_id", "text_hash", "window_id", "chain").agg(
        F.min("position").alias("first"), F.max("position").alias("last"), F.size(F.collect_set("offset")).alias("agreed"),
        F.max("needed").alias("needed")).where("agreed = needed").drop("chain", "agreed", "needed")


def indexed(documents: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The windows, their anchors and the stored index of the documents for the anchor words."""
    windows = settle(windows_of(benchmark), "windows")
    terms = settle(windows.select(F.explode("words").alias("term")).distinct(), "terms")
    counted = settle(document_frequencies(documents.select(words_of(F.col("text")).alias("w")), terms), "frequencies")
    anchors = settle(anchors_of(windows, counted), "anchors")
    index = settle(build_index(documents, settle(anchors.select("term").distinct(), "anchor-terms")), "index")
    return windows, anchors, index


def mark_hits(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Adds ``n_words, n_hit, items`` (sorted ids of items with a matching window) and ``contaminated`` to every document row."""
    key, own, hashed, hint, w, true_ = unused([*documents.columns, "n_words", "n_hit", "items", "contaminated"], "id", "text", "hash", "hints", "w", "true")
    windows, anchors, index = indexed(documents, benchmark)
    starts = candidates_of(index, anchors).join(if_small(windows), "window_id")
    hints = starts.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", F.size("words").alias("size"), "phrase", "items")).alias(hint))
    hints = settle(hints.select(F.col("doc_id").alias(key), F.col("text_hash").alias(own), hint), "hints")
    df = documents.withColumn(hashed, F.xxhash64("text"))
    df = df.join(if_small(hints), df["doc_id"].eqNullSafe(F.col(key)) & (F.col(hashed) == F.col(own)), "left")
    df = df.withColumn(w, words_of(F.col("text")))
    true = F.filter(hint, lambda c: F.array_join(F.slice(w, c["start"] + 1, c["size"]), " ") == c["phrase"])
    df = df.withColumns({"n_words": F.size(w).cast("long"), true_: F.when(F.col(hint).isNotNull(), F.array_sort(true))})
    covered = F.aggregate(
        true_, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, c: F.struct((a["n"] + F.greatest(F.lit(0), c["start"] + c["size"] - F.greatest(c["start"], a["end"]))).alias("n"),
                              F.greatest(a["end"], c["start"] + c["size"]).alias("end")), lambda a: a["n"])
    items = F.array_sort(F.array_distinct(F.flatten(F.transform(true_, lambda c: c["items"]))))
    df = df.withColumns({"n_hit": F.coalesce(covered, F.lit(0)).cast("long"), "items": F.coalesce(items, F.array().cast("array<string>"))})
    df = df.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
    return df.drop(hashed, key, own, hint, w, true_)
