"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is a line of words: its documents one after the other in a random order fixed by a seed and their content. The mix takes the
first ``target`` words of the line repeated as often as needed, so taken words meet the target exactly and the last document may
be taken in part. The taken line is cut into blocks. The tree starts with the number of blocks of each source (exact quotas) and all
output shards; each node deals its blocks to its two halves by a multivariate hypergeometric draw whose seed is the node, down to single
shards. Within a source, blocks are permuted by a bijection and dealt to shards in consecutive ranks: disjoint draws that leave nothing over.
Inside a shard the pieces are shuffled by a hash.

What is gathered per source are numbers only. Running sums over a source's documents use two levels (slices by hash, then documents in a
slice), so no source, however large, is sorted in one task.

Null text has size 0; a document of size 0 is never taken. Null sources are one source, the last. Repeated rows are documents of their own,
and each counts. Sources of size 0 have target 0. An empty table gives an empty mix. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from taxloom.session import settle

SPACES = r"[\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_REPEATS = 3
SEED = 7
#: Words per block at least; larger where a mix would have more than MOST_BLOCKS blocks (a draw counts blocks in 32 bits).
BLOCK_WORDS, MOST_BLOCKS = 1024, 100_000_000
SHARD_WORDS = 4 << 20
#: Documents per slice of a source, about.
SLICE_ROWS = 20_000


def sized(documents: DataFrame) -> DataFrame:
    """``row, doc_id, source, size, place``: one narrow row per document row. ``row`` is fixed once this is stored."""
    size = F.size(F.array_remove(F.split(F.coalesce("text", F.lit("")), SPACES), "")).cast("long")
    return documents.select("doc_id", "source", size.alias("size"), F.xxhash64(F.lit(SEED), "doc_id", "text").alias("place")).withColumn(
        "row", F.monotonically_increasing_id())


def targets_of(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """``source, source_size`` to the same with ``target``. One narrow row per source; the windows run over those rows only.

    Sharing out again what capped sources cannot take ends where every open source gets the same level times its weight. In the order of
    cap / weight the capped sources come first, so the level follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "utf-8"))
    pick = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    df = sources.withColumns({"weight": pick.cast("double"), "cap": most * F.col("source_size").cast("double")})
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumns({"total": F.sum("source_size").over(whole), "before": before,
                         "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    level = (F.col("total") - F.col("before")) / F.col("open")
    df = df.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    shared = F.max(F.when(~F.col("capped"), F.col("level"))).over(whole)
    # The first open source in this order has the level of all open ones; later rows would see open caps among "before".
    first = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"]
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.coalesce(first, shared) * F.col("weight")))
    return df.select("source", "source_size", target.alias("target"))


def on_lines(rows: DataFrame, slices: int) -> DataFrame:
    """Adds ``begin``: the words of the source before the document, in the order of ``place``."""
    df = rows.withColumn("slice", F.shiftrightunsigned(F.col("place"), 33) * slices / F.lit(float(1 << 31)))
    df = df.withColumn("slice", F.col("slice").cast("int"))
    sums = df.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    up = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("__s"), F.col("slice").alias("__slice"), F.coalesce(F.sum("words").over(up), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "slice").orderBy("place", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    df = df.join(sums, df["source"].eqNullSafe(F.col("__s")) & (df["slice"] == F.col("__slice")))
    return df.withColumn("begin", F.col("base") + F.col("inner")).drop("__s", "__slice", "base", "inner", "slice")


def _deal(quotas: np.ndarray, left: int, right: int, seed: list[int]) -> np.ndarray:
    """How many blocks of each source go to the left half: half the blocks in proportion to its shards, drawn without replacement."""
    total = int(quotas.sum())
    share = total * left // (left + right)
    rng = np.random.default_rng(seed)
    out = np.zeros_like(quotas)
    rest = total
    for i, q in enumerate(quotas.tolist()):
        rest -= q
        if share and q:
            out[i] = rng.hypergeometric(q, rest, share) if rest else share
            share -= int(out[i])
    return out


def splitting_tree(quotas: DataFrame, shards: int, seed: int = SEED, parts: int = 16) -> DataFrame:
    """``quotas`` array<long> (one row) to ``shard, quotas`` for every shard. Upper levels run in one task, each subtree in its own."""

    def split(lo: int, hi: int, q: np.ndarray, stop: int) -> Iterator[tuple[int, int, np.ndarray]]:
        stack = [(lo, hi, q)]
        while stack:
            lo, hi, q = stack.pop()
            if hi - lo <= stop:
                yield lo, hi, q
                continue
            mid = (lo + hi) // 2
            left = _deal(q, mid - lo, hi - mid, [seed, lo, hi])
            stack += [(mid, hi, q - left), (lo, mid, left)]

    def grow(stop: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for lo, hi, q in zip(batch["lo"], batch["hi"], batch["quotas"], strict=True):
                    found = list(split(int(lo), int(hi), np.asarray(q, dtype=np.int64), stop))
                    yield pd.DataFrame({"lo": [f[0] for f in found], "hi": [f[1] for f in found], "quotas": [f[2].tolist() for f in found]})

        return run

    schema = "lo long, hi long, quotas array<long>"
    top = quotas.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "quotas")
    nodes = top.mapInPandas(grow(max(1, shards // parts)), schema)
    if shards > parts:
        nodes = nodes.repartition(parts, "lo")
    return nodes.mapInPandas(grow(1), schema).select(F.col("lo").alias("shard"), "quotas")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED,
        shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored rows, the targets per source, and the mix: ``shard, place, row, from_word, to_word``, one row per piece taken.

    Writing the mix means joining the pieces with the texts by ``row``, then ``repartition("shard").sortWithinPartitions("shard", "place")``.
    """
    rows = settle(sized(documents), "sized")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(targets_of(sources, weights, most), "targets")
    facts = rows.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("words"), F.count("*").alias("n")).first()
    block = max(BLOCK_WORDS, -(-facts["words"] // MOST_BLOCKS))
    shards = max(1, -(-facts["words"] // shard_words))
    takes = F.least(F.round("target").cast("long"), most * F.col("source_size"))
    plan = targets.select("source", "source_size", takes.alias("takes"), F.ceil(takes / block).alias("blocks")).where("takes > 0")
    # One number per source, in a fixed order: the root of the tree.
    order = Window.orderBy(F.col("source").isNull(), "source")
    plan = settle(plan.withColumn("number", F.row_number().over(order) - 1), "plan")
    root = plan.agg(F.array_sort(F.collect_list(F.struct("number", "blocks"))).alias("q")).where(F.size("q") > 0).select(
        F.transform("q", lambda x: x["blocks"]).alias("quotas"))
    leaves = splitting_tree(root, shards, seed).select("shard", F.posexplode("quotas").alias("number", "quota"))
    up = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("low", F.coalesce(F.sum("quota").over(up), F.lit(0))).where("quota > 0")
    # rank = (step * block + shift) mod blocks is a bijection, as step is prime and does not divide the number of blocks.
    step = F.when(F.col("blocks") % 1_000_003 != 0, 1_000_003).otherwise(999_983)
    shift = F.pmod(F.xxhash64(F.lit(seed), "number"), F.col("blocks"))
    dealt = leaves.select("number", "shard", F.explode(F.sequence(F.col("low"), F.col("low") + F.col("quota") - 1)).alias("rank"))
    whole = plan.select("number", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")).select(
        "number", "block", F.pmod(F.col("block") * step + shift, F.col("blocks")).alias("rank"))
    # Both sides grow out of small tables, so Spark's estimate of their sizes is far too low: no broadcast here, and the result is stored.
    where = settle(whole.hint("merge").join(dealt.hint("merge"), ["number", "rank"]).select("number", "block", "shard"), "deal")
    lines = on_lines(rows.where("size > 0"), max(1, facts["n"] // SLICE_ROWS))
    named = plan.select(F.col("source").alias("__s"), "number", "source_size", "takes")
    lines = lines.join(named, lines["source"].eqNullSafe(F.col("__s")))
    passes = F.sequence(F.lit(0).cast("long"), ((F.col("takes") - 1) / F.col("source_size")).cast("long"))
    each = lines.withColumn("turn", F.explode(passes)).withColumn("at", F.col("turn") * F.col("source_size") + F.col("begin"))
    each = each.withColumn("stop", F.least(F.col("at") + F.col("size"), F.col("takes"))).where("stop > at")
    cuts = F.sequence(F.expr(f"at div {block}"), F.expr(f"(stop - 1) div {block}"))
    pieces = each.withColumn("block", F.explode(cuts)).withColumns({
        "from_word": F.greatest(F.col("at"), F.col("block") * block) - F.col("at"),
        "to_word": F.least(F.col("stop"), (F.col("block") + 1) * block) - F.col("at")})
    mixed = pieces.join(where, ["number", "block"]).select(
        "shard", F.xxhash64(F.lit(seed), "number", "block", "place", "turn").alias("place"), "row", "from_word", "to_word")
    return rows, targets, mixed


def taken_words(documents: DataFrame, **options) -> DataFrame:
    """Per document row: ``row, doc_id, source, size, source_size, target, taken``."""
    rows, targets, mixed = mix(documents, **options)
    taken = mixed.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    named = targets.select(F.col("source").alias("__s"), "source_size", "target")
    return rows.join(named, rows["source"].eqNullSafe(F.col("__s"))).join(taken, "row", "left").select(
        "row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
