"""URL filters: host and path rules, and logistic regression on hashed character n-grams. DataFrame functions only.

The model is trained from a small labelled URL table (``url``, ``label``: 1 for unwanted) by gradient descent: each step is one job over
the labelled rows that sums gradients per feature. What comes back to the driver is the model alone, ``DIMENSIONS`` numbers, whatever the
size of either table; it enters the scoring plan as a constant, so scoring is a scan without a shuffle.

A null URL, or one without ``://``, has an empty host and path; it is scored like any other. Labelled rows without URL or label are left
out; repeated rows count as often as they occur; an empty labelled table gives a model of zeros, which allows everything. Other columns
are kept; ``host``, ``path``, ``rule``, ``score`` and ``verdict`` replace columns of the same name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DIMENSIONS = 4096
SIZES = (3, 4)
STEPS, RATE, DECAY = 30, 0.5, 1e-5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that make the hosts and paths of the small labelled table, unwanted first, wanted second, and hosts and path forms that say nothing.
UNWANTED = ("cheap-pills", "spam-farm", "free-casino", "win-money", "hot-deals", "replica-watch", "cheap-meds", "easy-loans", "spam-links",
            "pills-online", "link-farm", "bonus-casino", "fast-cash", "adult-cams", "ad-tracker", "click-ads")
WANTED = ("news", "docs", "library", "museum", "weather", "recipes", "garden", "history", "science", "travel", "school", "music", "theatre",
          "research", "market", "another")
UNWANTED_PATHS = (*UNWANTED, "casino", "online-casino/bonus", "poker/jackpot", "slots", "betting-odds", "viagra", "payday-loan", "loans/instant", "xxx", "porn/cams",
                  "escort", "ads/click", "tracker/pixel", "affiliate/click", "doorway", "replica-bags", "weight-loss-pills", "get-rich", "crypto-giveaway", "free-money")
WANTED_PATHS = (*WANTED, "about", "articles", "blog/post", "guide", "reference/manual", "faq", "contact", "events/calendar", "people", "reports/annual", "lessons", "courses/maths",
                "poems", "maps", "archive/letters", "opening-hours", "wiki/birds", "papers", "notes/reading", "exhibitions")
NEUTRAL = ("neutral", "site", "home", "portal", "web", "pages", "forum", "data", "media", "files")
FORMS = ("/%s", "/%s/", "/en/%s/17", "/de/%s.html", "/p/%s/index", "/2024/%s-3", "/%s/page/2", "/x/%s/y")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table. In one half the host tells: every word as a host below each top domain, under the usual prefixes and languages. In
    the other only the path does: every word in every form under hosts that both labels share. Hosts without any path bear both labels alike."""
    each = lambda *values: F.explode(F.array(*map(F.lit, values)))
    words = [(w, 1) for w in UNWANTED] + [(w, 0) for w in WANTED]
    table = spark.createDataFrame(words, "word string, label int")
    for name, values in (("prefix", ("", "www.", "blog.")), ("top", ("com", "org", "net")), ("lang", ("en", "de"))):
        table = table.withColumn(name, each(*values))
    url = F.format_string("https://%s%s.example.%s/%s/%d", "prefix", "word", "top", "lang", F.abs(F.xxhash64("word", "top", "lang")) % 997)
    paths = spark.createDataFrame([(w, 1) for w in UNWANTED_PATHS] + [(w, 0) for w in WANTED_PATHS], "word string, label int").withColumn("form", each(*FORMS))
    # each path under two of the hosts, dealt by a hash that does not know the label
    paths = paths.withColumn("k", each(0, 1)).withColumn("host", F.element_at(F.array(*map(F.lit, NEUTRAL)), (F.pmod(F.xxhash64("form", "k"), F.lit(len(NEUTRAL))) + 1).cast("int")))
    told = F.concat(F.lit("http://"), F.col("host"), F.lit(".example.com"), F.replace("form", F.lit("%s"), F.col("word")))
    return table.select(url.alias("url"), "label").unionByName(paths.select(told.alias("url"), "label"))


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds ``host`` (A-Z lower-cased) and ``path``."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring("url", at + 3, F.length("url"))).otherwise("")
    df = pages.withColumn("__rest", F.coalesce(rest, F.lit(""))).withColumn("__host", F.regexp_extract("__rest", r"^[^/?#]*", 0))
    after = F.substring("__rest", F.length("__host") + 1, F.length("__rest"))
    return df.withColumns({"host": F.translate("__host", UPPER, LOWER), "path": F.regexp_extract(after, r"^[^?#]*", 0)}).drop("__rest", "__host")


def features(host: Column, path: Column) -> Column:
    """The distinct hashed n-grams of ``^host`` and of the path, told apart by a different seed."""

    def grams(text: Column, n: int, seed: int) -> Column:
        spots = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: F.pmod(F.xxhash64(F.lit(seed * 10 + n), F.substring(text, i, F.lit(n))), F.lit(DIMENSIONS)).cast("int"))

    lists = [grams(F.concat(F.lit("^"), host, F.lit("$")), n, 1) for n in SIZES] + [grams(path, n, 2) for n in SIZES]
    return F.array_distinct(F.concat(*lists))


def _constant(weights: list[float]) -> Column:
    """Numbers as one literal array; the optimizer folds it once."""
    return F.split(F.lit(",".join(f"{w:.6g}" for w in weights)), ",").cast("array<double>")


def logit(found: Column, weights: list[float], bias: float) -> Column:
    table = _constant(weights)
    total = F.aggregate(found, F.lit(0.0), lambda a, i: a + F.get(table, i))
    return F.lit(bias) + total / F.sqrt(F.greatest(F.size(found), F.lit(1)).cast("double"))


def train(labelled: DataFrame, steps: int = STEPS) -> tuple[list[float], float]:
    """Weights and bias after ``steps`` full gradient steps, each number scaled by its own gradients so far. Each row's features have length one."""
    rows = with_parts(labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull()).select("url", "label"))
    rows = rows.select(F.col("label").cast("double").alias("label"), features(F.col("host"), F.col("path")).alias("found")).cache()
    weights, bias = [0.0] * DIMENSIONS, 0.0
    squares = [0.0] * (DIMENSIONS + 1)  # of all gradients so far, by which each step is scaled; the bias comes last

    def step(i: int, gradient: float) -> float:
        squares[i] += gradient * gradient
        return RATE * gradient / (math.sqrt(squares[i]) + 1e-12)

    for _ in range(steps):
        error = rows.select("found", (F.col("label") - 1 / (1 + F.exp(-logit(F.col("found"), weights, bias)))).alias("e"))
        parts = error.select("e", F.explode(F.concat(F.array(F.lit(-1)), F.col("found"))).alias("i"),
                             F.sqrt(F.greatest(F.size("found"), F.lit(1)).cast("double")).alias("length"))
        # at most DIMENSIONS + 1 rows, one per feature
        sums = parts.groupBy("i").agg(F.sum(F.when(F.col("i") < 0, F.col("e")).otherwise(F.col("e") / F.col("length"))).alias("g"),
                                      F.count("*").alias("n")).collect()
        count = max((r["n"] for r in sums if r["i"] < 0), default=1)
        for r in sums:
            if r["i"] < 0:
                bias += step(DIMENSIONS, r["g"] / count)
            else:
                weights[r["i"]] += step(r["i"], r["g"] / count - DECAY * weights[r["i"]])
    rows.unpersist()
    return weights, bias


def matching_rule(rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as a struct (size, rule, action), or null. ``rules``: (action, host, path); a list for a plan, some hundreds at most."""
    found = [F.when(((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path),
                    F.struct(F.lit(len(host) + len(path)).alias("size"), F.lit(host + path).alias("rule"), F.lit(action).alias("action")))
             for action, host, path in rules]
    return F.greatest(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("struct<size:int,rule:string,action:string>")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], model: tuple[list[float], float]) -> DataFrame:
    """Adds host, path, the longest fitting rule, the model's score (probability of unwanted) and the verdict."""
    df = with_parts(pages).withColumn("__rule", matching_rule(rules)).withColumn("__found", features(F.col("host"), F.col("path")))
    df = df.withColumn("score", 1 / (1 + F.exp(-logit(F.col("__found"), *model))))
    own = F.when(F.col("score") > 0.5, "block").otherwise("allow")
    return df.withColumns({"rule": F.col("__rule.rule"), "verdict": F.coalesce(F.col("__rule.action"), own)}).drop("__rule", "__found")
