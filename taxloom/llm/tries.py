"""The prefix trie of conversations: one node per distinct beginning, with totals over subtrees by centroid decomposition.

**Nodes.** A turn's value is 128 bits of SHA-256 over role and text. A beginning of ``d`` turns is known by the XOR of ``d`` hashes of (place,
value), two words of 64 bits: XOR of hashes that carry their place tells sequences apart as a hash of the whole sequence would (two different
ones meet with a chance of 2^-128 per pair), but is associative, so that a conversation of any length is cut into blocks and its
beginnings are prefix sums over blocks. Taking a turn's hash off again gives the parent. Turns are put in order by a range partitioning of all
rows and counted per partition, so a conversation that holds a third of all rows is never one task's work.

**Subtree totals.** A node weighs as many units as it has members. The weight of its subtree is the number of turns its members still have to
come, itself included, so it comes from the same aggregation as the members. While a component of the parent-edge forest weighs more than
``limit``, Spark removes its centroid, the deepest node that holds more than half of the weight: the total over the centroid's part of the
component is added to the nodes on the path from the centroid up to the component's top, that weight is taken off them, and the parts below
each child and the part above go on as components. No part weighs more than half, so after ``log2(weight / limit)`` rounds all fit a task,
where the same steps run with numpy on many components at a time, at most about ``4 * limit`` nodes in a group. A node's total is what its
paths brought plus the total of its own part when it was removed. No round passes a total down a long chain node by node.

**Conversations that end at a node** are written as blocks of up to 4,096 ids and their text hashed; a node with several blocks is hashed
block after block from a sorted stream, in memory for one block.

Rows without ``conv_id`` belong to no conversation and are left out. A null role or text is empty; null turns come first; rows of equal turn
are ordered by role, then text; repeated rows are turns of their own. An empty table gives no node, not even a root. Only ``conv_id, turn,
role, text`` are read; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from taxloom.llm.sizes import if_small
from taxloom.session import settle

#: Components up to this weight are taken apart inside tasks.
LIMIT = 8192
#: Turns per block of a long conversation, and ids per block of a node's ends.
TURNS, IDS = 1024, 4096
WORDS = r"[^\x20\x09-\x0D]+"


def ordered_turns(talks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` (conv_id, part, place, x, y, words) in order, and ``parts`` (conv_id, part, first, before, size).

    A turn's ordinal is ``place - first + before + 1``: its place in its partition of the ordered rows and what the partitions before it
    hold of its conversation.
    """
    rows = talks.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    order = ["conv_id", "turn", "role", "text"]
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("digest", digest)
    half = lambda k: F.conv(F.substring("digest", k, 15), 16, 10).cast("long")
    turns = settle(rows.select("conv_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place"),
                               half(1).alias("x"), half(17).alias("y"), F.size(F.regexp_extract_all("text", F.lit(WORDS), F.lit(0))).cast("long").alias("words")), "turns")
    own = Window.partitionBy("conv_id")
    parts = turns.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n")).select(
        "conv_id", "part", "first", F.sum("n").over(own).alias("size"),
        (F.sum("n").over(own.orderBy("part")) - F.col("n")).alias("before"))
    return turns, parts


def rebuilt(talks: DataFrame, shared: int = 20, lead: int = 4) -> DataFrame:
    """(conv_id, depth, length, x, y, words): the first ``h = crc32(id) % lead`` turns of conversation ``id - id % shared``, then the own turns after the first ``h``.

    Depth 0, one row per conversation, stands for no turns. Beginnings are at most ``lead - 1`` rows for each of ``shared`` conversations.
    """
    turns, parts = ordered_turns(talks)
    heads = parts.select("conv_id", "size").distinct()
    base = F.col("conv_id") - F.col("conv_id") % shared
    sizes = heads.where(F.col("conv_id") % shared == 0).select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    told = heads.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string")) % lead}).join(sizes, "base", "left")
    told = told.withColumn("given", F.least("h", F.coalesce("base_size", F.lit(0))))
    told = settle(told.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).alias("length")), "heads")
    placed = turns.join(parts.join(told, "conv_id").drop("size"), ["conv_id", "part"])
    placed = placed.withColumn("ordinal", F.col("place") - F.col("first") + F.col("before") + 1)
    placed = settle(placed.select("conv_id", "ordinal", "h", "given", "length", "x", "y", "words"), "placed")
    columns = ["conv_id", "depth", "length", "x", "y", "words"]
    own = placed.where(F.col("ordinal") > F.col("h")).withColumn("depth", F.col("ordinal") - F.col("h") + F.col("given"))
    lent = placed.where((F.col("ordinal") < lead) & (F.col("conv_id") % shared == 0)).select(F.col("conv_id").alias("base"), F.col("ordinal").alias("depth"), "x", "y", "words")
    lent = told.where("given > 0").join(lent, "base").where(F.col("depth") <= F.col("given"))
    none = told.select("conv_id", F.lit(0).cast("long").alias("depth"), "length", *[F.lit(0).cast("long").alias(c) for c in ("x", "y", "words")])
    return own.select(columns).unionByName(lent.select(columns)).unionByName(none)


def beginnings(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, length, words, a, b, pa, pb): the key of each beginning and of the one that is a turn shorter. The root's key is (0, 0)."""
    item = lambda seed: F.when(F.col("depth") > 0, F.xxhash64(F.lit(seed), "depth", "x", "y")).otherwise(F.lit(0).cast("long"))
    rows = turns.withColumns({"p": item(1), "q": item(2), "block": F.floor(F.col("depth") / TURNS)})
    # what the blocks before hold of a conversation; only long ones have a second block
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.where(F.col("length") >= TURNS).groupBy("conv_id", "block").agg(F.bit_xor("p").alias("p"), F.bit_xor("q").alias("q"))
    blocks = blocks.select("conv_id", "block", F.bit_xor("p").over(before).alias("before_p"), F.bit_xor("q").over(before).alias("before_q")).where("block > 0")
    so_far = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"in_p": F.bit_xor("p").over(so_far), "in_q": F.bit_xor("q").over(so_far)}).join(blocks, ["conv_id", "block"], "left")
    key = lambda c: F.col(f"in_{c}").bitwiseXOR(F.coalesce(f"before_{c}", F.lit(0)))
    rows = rows.withColumns({"a": key("p"), "b": key("q")})
    up = lambda c, own: F.when(F.col("depth") > 0, F.col(c).bitwiseXOR(F.col(own)))
    return rows.select("conv_id", "depth", "length", "words", "a", "b", up("a", "p").alias("pa"), up("b", "q").alias("pb"))


def end_digests(ends: DataFrame) -> DataFrame:
    """(a, b, digest): SHA-256 of the ids of ``ends`` (a, b, conv_id), ascending and joined by commas."""
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    texts = ends.groupBy("a", "b", F.floor(F.col("conv_id") / IDS).alias("block")).agg(F.array_join(ids, ",").alias("ids"))
    texts = settle(texts, "ends")
    counts = settle(texts.groupBy("a", "b").agg(F.count("*").alias("blocks"), F.min("ids").alias("ids")), "end_counts")
    one = counts.where("blocks = 1").select("a", "b", F.sha2("ids", 256).alias("digest"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for a, b, text in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("ids").to_pylist()):
                if (a, b) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(text.encode())
            yield _digests(done)
        yield _digests([(*key, state.hexdigest())] if key else [])

    many = texts.join(if_small(settle(counts.where("blocks > 1").select("a", "b"), "many_blocks")), ["a", "b"], "left_semi")
    many = many.repartition("a", "b").sortWithinPartitions("a", "b", "block").mapInArrow(stream, "a long, b long, digest string")
    return one.unionByName(many)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    a, b, digest = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(digest, pa.string())], names=["a", "b", "digest"])


def _forest_order(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in preorder, and for each place the end of its subtree. ``parent``: index or -1."""
    n = len(parent)
    by_parent = np.argsort(parent, kind="stable")
    start = np.searchsorted(parent[by_parent], np.arange(-1, n + 1))
    order, end, place = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    stack, k = list(by_parent[start[0]:start[1]][::-1]), 0
    while stack:
        v = stack.pop()
        order[k], place[v] = v, k
        k += 1
        stack.extend(by_parent[start[v + 1]:start[v + 2]][::-1])
    size = np.ones(n, dtype=np.int64)
    for v in order[::-1]:
        if parent[v] >= 0:
            size[parent[v]] += size[v]
    end[place] = place + size
    return order, end


def centroid_totals(parent: np.ndarray, weight: np.ndarray, values: np.ndarray, brought: np.ndarray) -> np.ndarray:
    """Subtree totals of a forest by centroid decomposition, all components of a level at a time.

    ``weight``: of each subtree inside its component; ``values``: a row of whole numbers per node; ``brought``: what splits before have added.
    """
    order, end = _forest_order(parent)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    up = np.where(parent[order] >= 0, place[parent[order]], -1)
    weight, values, total = weight[order].copy(), values[order], brought[order].copy()
    # a component is known by the place of its top
    top = np.zeros(len(order), dtype=np.int64)
    for i in range(len(order)):
        top[i] = i if up[i] < 0 else top[up[i]]
    open_ = np.arange(len(order))
    while len(open_):
        comp = top[open_]
        centre = np.full(len(order), -1, dtype=np.int64)
        heavy = open_[2 * weight[open_] > weight[comp]]
        np.maximum.at(centre, top[heavy], heavy)  # heavy nodes are a chain from the top; the deepest comes last in preorder
        c = centre[comp]
        below = (open_ >= c) & (open_ < end[c])
        sums = np.zeros_like(total)
        np.add.at(sums, comp[below], values[open_[below]])
        above = open_[(open_ < c) & (end[open_] > c)]
        total[above] += sums[top[above]]
        weight[above] -= weight[centre[top[above]]]
        found = np.unique(c)
        total[found] += sums[top[found]]
        # the parts below: a node's new top is the last child of the centroid before it in its component
        rest = open_[below & (open_ != c)]
        if len(rest):
            rest = rest[np.argsort(top[rest], kind="stable")]
            child = up[rest] == centre[top[rest]]
            top[rest] = rest[np.maximum.accumulate(np.where(child, np.arange(len(rest)), 0))]
        open_ = open_[open_ != c]
    out = np.empty_like(total)
    out[order] = total
    return out


def _finish(measures: list[str]):
    """Takes apart whole components inside a task."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        keys = pd.MultiIndex.from_arrays([group["a"], group["b"]])
        # a component's top has its parent outside
        inside = (group["a"] != group["ca"]) | (group["b"] != group["cb"])
        parent = np.where(inside, keys.get_indexer(pd.MultiIndex.from_arrays([group["pa"], group["pb"]])), -1)
        total = centroid_totals(parent, group["weight"].to_numpy(np.int64), group[measures].to_numpy(np.int64), group[[f"got_{m}" for m in measures]].to_numpy(np.int64))
        return pd.DataFrame({"a": group["a"], "b": group["b"]} | {m: total[:, k] for k, m in enumerate(measures)})

    return run


def subtree_totals(nodes: DataFrame, paths: DataFrame, measures: list[str], limit: int = LIMIT) -> DataFrame:
    """(a, b, *measures): each measure summed over the node's subtree.

    ``nodes``: a, b, pa, pb, conv_id (a member), depth, weight, measures. ``paths``: conv_id, depth, a, b, pa, pb. Both stored tables.
    """
    root = nodes.where("depth = 0").agg(F.max("weight")).first()[0]
    if root is None:
        return nodes.select("a", "b", *measures)
    zero = F.lit(0).cast("long")
    columns = ["a", "b", "pa", "pb", "conv_id", "depth", "weight", *measures, *[f"got_{m}" for m in measures], "ca", "cb", "top", "whole"]
    level = nodes.select("a", "b", "pa", "pb", "conv_id", "depth", "weight", *measures, *[zero.alias(f"got_{m}") for m in measures],
                         zero.alias("ca"), zero.alias("cb"), zero.alias("top"), F.lit(root).cast("long").alias("whole"))
    done, fitting, largest = [], [], root
    while largest is not None and largest > limit:
        large = level.where(F.col("whole") > limit)
        fitting.append(level.where(F.col("whole") <= limit))
        # the centroid of each component: at most weight / limit rows
        centres = settle(large.where(2 * F.col("weight") > F.col("whole")).groupBy("ca", "cb", "top").agg(F.max(F.struct("depth", "a", "b", "conv_id", "weight")).alias("c"))
                         .select("ca", "cb", "top", *[F.col(f"c.{x}").alias(f"c_{x}") for x in ("depth", "a", "b", "conv_id", "weight")]), "centres")
        rows = large.join(if_small(centres.drop("top")), ["ca", "cb"]).withColumn("block", F.floor(F.col("depth") / TURNS))
        is_child = F.col("pa").eqNullSafe(F.col("c_a")) & F.col("pb").eqNullSafe(F.col("c_b"))
        # which child of the centroid a conversation runs through, once per block of its nodes
        ahead = rows.where(F.col("depth") > F.col("c_depth")).select("ca", "cb", "conv_id", "block", "c_a", "c_b", (F.col("c_depth") + 1).alias("depth")).distinct()
        steps = paths.select("conv_id", "depth", F.col("a").alias("na"), F.col("b").alias("nb"), "pa", "pb")
        through = ahead.join(steps, ["conv_id", "depth"]).where(is_child).select("ca", "cb", "conv_id", "block", "na", "nb")
        children = rows.where(is_child).select(F.col("a").alias("na"), F.col("b").alias("nb"), F.col("weight").alias("n_whole"))
        through = through.join(if_small(settle(children, "children")), ["na", "nb"])
        keys = ["ca", "cb", "conv_id", "block"]
        sided = rows.alias("r").join(through.alias("t"), [F.col(f"r.{k}") == F.col(f"t.{k}") for k in keys] + [F.col("depth") > F.col("c_depth")], "left")
        sided = settle(sided.select("r.*", "t.na", "t.nb", "t.n_whole").drop("block"), "sided")
        is_centre = (F.col("a") == F.col("c_a")) & (F.col("b") == F.col("c_b"))
        below = F.col("na").isNotNull()
        sums = sided.where(is_centre | below).groupBy("ca", "cb").agg(*[F.sum(m).alias(f"sum_{m}") for m in measures])
        sums = settle(centres.join(sums, ["ca", "cb"]), "sums")
        # the nodes from the centroid's parent to the component's top
        route = if_small(sums.select(F.col("c_conv_id").alias("conv_id"), "c_depth", "top", "c_weight", *[f"sum_{m}" for m in measures]))
        climb = paths.select("conv_id", "depth", "a", "b").join(route, "conv_id").where((F.col("depth") >= F.col("top")) & (F.col("depth") < F.col("c_depth")))
        climb = climb.select("a", "b", F.col("c_weight").alias("off"), *[f"sum_{m}" for m in measures])
        centre_rows = sided.where(is_centre).select("ca", "cb", "a", "b", *[f"got_{m}" for m in measures]).join(if_small(sums), ["ca", "cb"])
        done.append(centre_rows.select("a", "b", *[(F.col(f"got_{m}") + F.col(f"sum_{m}")).alias(m) for m in measures]))
        moved = sided.where(~is_centre).join(climb, ["a", "b"], "left").select(
            "a", "b", "pa", "pb", "conv_id", "depth", (F.col("weight") - F.coalesce("off", F.lit(0))).alias("weight"), *measures,
            *[(F.col(f"got_{m}") + F.coalesce(f"sum_{m}", F.lit(0))).alias(f"got_{m}") for m in measures],
            F.coalesce("na", "ca").alias("ca"), F.coalesce("nb", "cb").alias("cb"),
            F.when(below, F.col("c_depth") + 1).otherwise(F.col("top")).alias("top"),
            F.when(below, F.col("n_whole")).otherwise(F.col("whole") - F.col("c_weight")).alias("whole"))
        level = settle(moved.select(columns), "level")
        largest = level.agg(F.max("whole")).first()[0]
    fitting.append(level)
    rest = fitting[0]
    for more in fitting[1:]:
        rest = rest.unionByName(more)
    # groups of about 4 * limit nodes, whole components in each
    weights = rest.where((F.col("a") == F.col("ca")) & (F.col("b") == F.col("cb"))).agg(F.sum("whole")).first()[0] or 0
    buckets = max(1, -(-weights // (4 * limit)))
    schema = "a long, b long, " + ", ".join(f"{m} long" for m in measures)
    # the root's parent is null, which pandas would turn into floats
    rest = rest.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("pa", "pb")})
    out = rest.groupBy(F.pmod(F.xxhash64("ca", "cb"), F.lit(buckets)).alias("bucket")).applyInPandas(_finish(measures), schema)
    for part in done:
        out = out.unionByName(part)
    return out


def conversation_trie(talks: DataFrame, shared: int = 20, lead: int = 4, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = settle(beginnings(rebuilt(talks, shared, lead)), "paths")
    nodes = settle(paths.groupBy("a", "b", "depth").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
        F.min("pa").alias("pa"), F.min("pb").alias("pb"), F.min("words").alias("words")), "nodes")
    children = nodes.where("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("n_children"))
    children = children.select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children")
    nodes = nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = settle(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "tree")
    totals = subtree_totals(nodes, paths, ["n_leaves", "saved_tokens"], limit)
    parents = nodes.where("n_children > 0").select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    told = settle(nodes.select("a", "b", "pa", "pb", "conv_id", "depth", "n_convs", "n_children").join(parents, ["pa", "pb"], "left").drop("pa", "pb"), "told")
    ends = end_digests(paths.where("depth = length").select("a", "b", "conv_id"))
    out = told.join(totals, ["a", "b"]).join(ends, ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
