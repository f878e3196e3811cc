"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Every rule rejects a document whose feature lies above a cutoff. Labelled documents decide the cutoffs: a cutoff is *certified* for a
stratum (a language) when the exact binomial tail shows that it rejects at most a share ``alpha`` of good documents there. Along cutoffs
tried from the mildest to the strictest and fixed beforehand, testing stops at the first that fails, which needs no further correction.

All rules of a stratum share one such sequence (``path_of``): every step tightens one rule, in turn, and is tested with all that is in force by
then, so the whole ``alpha`` bounds what the rules reject together. Every stratum has ``delta`` / strata as its error probability (Bonferroni over
strata), so with a chance of ``1 - delta`` no stratum at all loses more than ``alpha`` of its good documents. Of the certified steps the one that
rejects the most bad and the fewest good documents is used; ties go to the mildest. Every stratum is treated alike, whatever its number of labels: one
that cannot certify the first step (with no false rejection it takes ``least_labels`` good labels), and a language without labels, reject
nothing beyond the base rules.

Null text counts as empty. Null languages form a stratum of their own. Documents without labels, labels without documents and
null labels play no part in choosing; a document with several labels is good only if all say so. Repeated rows are judged alike. Empty
tables give empty results. Other columns of the input are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from taxloom.session import settle

SPACES = r"[\x20\x09-\x0D]+"
#: The share of a stratum's good documents that may be lost, and the chance that any stratum loses more.
ALPHA, DELTA = 0.05, 0.05
#: Feature and its cutoffs, mildest first. Chosen before any data were seen, as the guarantee asks.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_share": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.07, 0.05, 0.03),
    "upper_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3),
    "dup_line_share": (0.95, 0.9, 0.8, 0.7, 0.6, 0.5),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    """The words of a text: runs of anything but space, tab, line feed, vertical tab, form feed and return."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def _kept(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def measure(documents: DataFrame) -> DataFrame:
    """Adds the counts of ``BASE``, the rule features and ``base_failed`` to the documents.

    Words in repeated windows: windows are compared by a 64-bit hash of three word hashes within one document. Sorted with their positions,
    equal neighbours are the repeated ones; the union of their three-word spans is counted in one sweep, so a document costs n log n.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = documents.withColumns({"__t": text, "__w": words_of(F.col("text"))})
    df = df.withColumns({
        "n_words": F.size("__w").cast("long"),
        "word_chars": F.length(F.regexp_replace("__t", SPACES, "")).cast("long"),
        "n_symbols": _kept(F.col("__t"), r"[#*$%&|<>]").cast("long"),
        "__upper": _kept(F.col("__t"), r"[A-Z]+"),
        "__letters": _kept(F.col("__t"), r"[A-Za-z]+"),
        "__lines": F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "__h": F.transform("__w", lambda w: F.xxhash64(w)),
    })
    count = F.size("__h")
    some = F.when(count > 2, count - 2).otherwise(0)
    df = df.withColumns({
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__n_lines": F.size("__lines"),
        "__tri": F.zip_with(
            F.zip_with(F.slice("__h", F.lit(1), some), F.slice("__h", F.lit(2), some), lambda a, b: F.xxhash64(a, b)),
            F.slice("__h", F.lit(3), some), lambda a, b: F.xxhash64(a, b)),
    })
    repeats = F.size(F.array_distinct("__tri")) < F.size("__tri")
    df = df.withColumn("__s", F.when(repeats, F.array_sort(F.transform("__tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    size = F.size("__s")
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.transform(F.slice("__s", F.lit(1), size - 1), lambda s: s["h"]))
    after = F.concat(F.transform(F.slice("__s", F.lit(2), size - 1), lambda s: s["h"]), F.array(F.lit(None).cast("bigint")))
    near = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    places = F.zip_with("__s", near, lambda s, n: F.when((s["h"] == n["a"]) | (s["h"] == n["b"]), s["i"]))
    df = df.withColumn("__p", F.when(F.col("__s").isNotNull(), F.array_sort(F.array_compact(places))))
    covered = F.aggregate(
        "__p", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    share = lambda part, whole: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)
    return df.withColumns({
        "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("__upper", "__letters"),
        "dup_line_share": share("n_dup_lines", "__n_lines"),
    }).drop("__t", "__w", "__upper", "__letters", "__lines", "__h", "__n_lines", "__tri", "__s", "__p")


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """The probability of at most ``k`` hits in ``n`` trials of chance ``p``, summed term by term in logarithms; 1 where k/n >= p.

    (Beyond k/n = p the tail is no evidence for a rate below p, so it needs no sum.)
    """
    q = 1.0 - p
    start = F.struct((n * F.log(F.lit(q))).alias("log"), F.exp(n * F.log(F.lit(q))).alias("sum"))

    def step(a: Column, j: Column) -> Column:
        log = a["log"] + F.log((n - j + 1) / j) + F.log(F.lit(p / q))
        return F.struct(log.alias("log"), (a["sum"] + F.exp(log)).alias("sum"))

    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when((n > 0) & (k < n * p), F.aggregate(terms, start, step, lambda a: F.least(a["sum"], F.lit(1.0)))).otherwise(1.0)


def _labelled(measured: DataFrame, labels: DataFrame, rules: dict[str, tuple[float, ...]]) -> DataFrame:
    """``lang, good`` and the features of the labelled documents that pass the base rules."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        (F.min("quality") == 1).alias("good"))
    return measured.where(~F.col("base_failed")).select("doc_id", "lang", *rules).join(own, "doc_id").select("lang", "good", *rules)


def path_of(rules: dict[str, tuple[float, ...]]) -> list[dict[str, float]]:
    """The cutoffs in force at each step: the rules' first cutoffs come in one after the other, then their second ones, and so on."""
    steps: list[dict[str, float]] = []
    for i in range(max(map(len, rules.values()))):
        for rule, cuts in rules.items():
            if i < len(cuts):
                steps.append({**(steps[-1] if steps else {}), rule: cuts[i]})
    return steps


def least_labels(alpha: float, delta: float) -> int:
    """Good labels that certify a cutoff which rejects none of them."""
    return math.ceil(math.log(delta) / math.log1p(-alpha))


def certify(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
            rules: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """The cutoffs in force, one row per stratum and rule: ``lang, rule, cutoff``.

    ``measured`` needs ``doc_id``, ``lang``, ``base_failed`` and the features; ``labels`` needs ``doc_id`` and ``quality`` (1: good).
    """
    rules = rules or RULES
    steps = path_of(rules)
    # Steps only tighten, so a row is known by the first step that rejects it.
    rejects = [F.coalesce(F.greatest(*[F.col(r) > c for r, c in s.items()], F.lit(False)), F.lit(False)).cast("int") for s in steps]
    held = _labelled(measured, labels, rules).withColumn("step", F.lit(len(steps)) - sum(rejects))
    counts = settle(held.groupBy("lang", "step").agg(F.sum(F.col("good").cast("long")).alias("good"), F.count("*").alias("n")), "labelled")
    strata = counts.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))).distinct().count()
    none = F.lit(0).cast("long")
    every = counts.select("lang").distinct().select("lang", F.explode(F.sequence(F.lit(0), F.lit(len(steps)))).alias("step"), none.alias("good"), none.alias("n"))
    full = counts.unionByName(every).groupBy("lang", "step").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    own = Window.partitionBy("lang")  # one row per step and stratum
    so_far = own.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    tried = full.select("lang", "step", F.sum("good").over(own).alias("all_good"), F.sum("good").over(so_far).alias("hit_good"), F.sum("n").over(so_far).alias("hit"))
    tried = tried.where(F.col("step") < len(steps)).withColumn("fine", (binomial_tail(F.col("hit_good"), F.col("all_good"), alpha) <= delta / max(strata, 1)).cast("int"))
    certified = tried.withColumn("fine", F.min("fine").over(so_far)).where("fine = 1")
    certified = certified.withColumn("gain", F.col("hit") - 2 * F.col("hit_good")).where("gain > 0")
    best = certified.withColumn("r", F.row_number().over(own.orderBy(F.desc("gain"), "step"))).where("r = 1")
    named = F.array(*[F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff")) for r, c in s.items()]) for s in steps])
    return best.select("lang", F.explode(F.element_at(named, F.col("step") + 1)).alias("x")).select("lang", "x.*")


def judge(measured: DataFrame, cutoffs: DataFrame, rules: dict[str, tuple[float, ...]] | None = None) -> DataFrame:
    """Adds ``kept``. ``cutoffs`` has one row per stratum and rule, so it is small beside the documents; Spark broadcasts it by its size."""
    rules = rules or RULES
    wide = cutoffs.groupBy(F.col("lang").alias("__lang")).agg(
        *[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in rules])
    failed = F.col("base_failed")
    for r in rules:
        failed = failed | F.coalesce(F.col(r) > F.col(f"__{r}"), F.lit(False))
    joined = measured.join(wide, F.col("lang").eqNullSafe(F.col("__lang")), "left")
    return joined.withColumn("kept", ~failed).drop("__lang", *[f"__{r}" for r in rules])
