"""Connected components by repeated contraction, as joins of two-column tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from taxloom.session import settle


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (long) to ``node, root``: one row per node of an edge; nodes joined by a path share a root, one of themselves.

    Each round every node moves to the neighbour, or itself, of the least hash, and edges move with their ends. A star is done in two rounds
    and a path shrinks by a constant share on average. A node with very many edges is combined before the shuffle; the joins that move its
    edges are inner joins, which Spark splits when one key is skewed. Every round is stored, so a lost executor costs one round.
    """
    moves = []
    edges = settle(edges.where("a <> b").select("a", "b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("m"))
        self_ = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
        move = settle(least.select(F.col("a").alias("node"), F.least("m", self_)["v"].alias("root")), "moves")
        moves.append(move)
        first = edges.join(move.select(F.col("node").alias("a"), F.col("root").alias("x")), "a")
        second = first.join(move.select(F.col("node").alias("b"), F.col("root").alias("y")), "b")
        edges = settle(second.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if not moves:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[0]
    for move in moves[1:]:
        later = move.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(later, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return settle(found, "components")
