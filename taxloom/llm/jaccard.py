"""N-gram Jaccard join: documents whose sets of five-word shingles agree to 75 % or more are linked; exact, with pivots and windows.

The distance is 1 - intersection / union, a metric; two documents link at a distance of at most ``REACH`` = 0.25.

1. *Sets.* Equal sets are one class from the start (a 64-bit value of the whole set and its size name it), so copies cost one row each.
2. *Far documents.* In running text nearly all documents lie at distance 1 from each other, where no pivot can tell them apart: every
   window would hold everything. They are cut away first and exactly: a document with a partner shares at least 75 % of its
   shingles with other documents. Shingles are dealt to buckets as packed arrays; what a bucket sees twice is *shared*; a
   document with fewer shared shingles than that is done. A shingle that is repeated inside one task's input is marked there and sent once, so
   a passage that a third of all documents hold does not gather in one bucket.
3. *Pivots.* Two linked documents agree in one of the first ``size - ceil(0.75 size) + 1`` shingles in a common order (rare before
   frequent). Documents with such a key in common are neighbours, and the neighbour of the least hash may be the key's pivot. Every document
   calls the one of least hash among those of its keys; the called ones are the pivots, few for a group of near copies however many keys
   it has. A document measures its distance to the pivots among its keys'; the nearest is its home: Voronoi regions. Distances within
   reach are links.
4. *Windows.* Where a key spans two regions, the documents of the smaller are measured against the other's pivot. A document x can
   have a partner in region P only if d(x, P) <= radius(P) + REACH and d(x, P) <= d(x, home) + 2 REACH (triangle inequality); such boundary
   documents are replicated into P. Pairs already joined by a chain of links are left out, as links only matter by what they connect.
5. *Regions* are joined exactly: every document that is not within reach of the pivot itself, and every replicated one, against all
   members. A large region is cut again by rings of distance around its pivot (a query visits the rings within REACH of its own
   distance) and rings into blocks, so that a task holds at most ``BLOCK`` members and ``BLOCK`` queries. Tasks give only links that join what
   was apart.

Defined cases: null and empty texts, and texts without words, have an empty set and stand alone (component: their own id). A text with
fewer than five words is one shingle. Repeated rows are rows of one class. Null ids take part; a component's id is its smallest id that
is not null. An empty table gives an empty result. Other columns are kept by ``keep_first`` and not read elsewhere.

Names of shingles and sets are 64-bit hashes: two different ones agree with a chance of 2^-64 per pair compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from taxloom.llm.components import components
from taxloom.llm.names import unused
from taxloom.llm.sizes import if_small
from taxloom.llm.words import mixed, shingle_sets, slices
from taxloom.session import settle

#: Link where 100 * intersection >= PERCENT * union.
PERCENT = 75
REACH = 1 - PERCENT / 100
#: Postings that a task packs at once, and postings per bucket.
FLUSH, PER_BUCKET, LEAST_BUCKETS = 1_000_000, 2_000_000, 64
#: A shingle shared by more sets than this is ordered behind the rarer ones.
FREQUENT = 4
BLOCK = 256
RING = 0.125
#: Rounding of distances as doubles; windows are this much wider.
SLACK = 1e-9
_SET = np.uint64(0xA0761D6478BD642F)


def _sets(texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice of texts: from, to, shingles, their number per text, and the value of each whole set (0 for an empty one)."""
    for a, b in slices(texts):
        values, counts = shingle_sets(texts[a:b])
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(mixed(values ^ _SET), out=sums[1:])
        stop = np.cumsum(counts)
        whole = mixed(sums[stop] - sums[stop - counts] + counts.astype(np.uint64) * _SET) >> np.uint64(1)
        yield a, b, values, counts, np.where(counts > 0, np.maximum(whole, np.uint64(1)), np.uint64(0)).astype(np.int64)


def memberships(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, set_id`` per document row; ``set_id`` is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_hash", "n_shingles", "set_id"]
        for batch in batches:
            for a, b, _, counts, whole in _sets([t or b"" for t in batch.column("text").to_pylist()]):
                ids = [batch.column(c).slice(a, b - a) for c in names[:2]]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(counts.astype(np.int64)), pa.array(whole, mask=whole == 0)], names)

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_id long")


_PACKED = "bucket int, marked boolean, sets binary, sizes binary, counts binary, values binary"


def _packed(bucket: np.ndarray, sets: np.ndarray, sizes: np.ndarray, values: np.ndarray, marked: bool) -> Iterator[dict]:
    """Postings as one row per bucket: runs of one set are named once."""
    if not len(values):
        return
    order = np.lexsort((sets, bucket))
    bucket, sets, sizes, values = bucket[order], sets[order], sizes[order], values[order]
    edge = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(edge, [*edge[1:], len(bucket)], strict=True):
        run = a + np.flatnonzero(np.r_[True, sets[a + 1:b] != sets[a:b - 1]])
        yield {"bucket": int(bucket[a]), "marked": marked, "sets": sets[run].tobytes(), "sizes": sizes[run].astype(np.uint32).tobytes(),
               "counts": np.diff(np.append(run, b)).astype(np.uint32).tobytes(), "values": values[a:b].tobytes()}


def _unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    join = lambda name, kind: np.frombuffer(b"".join(rows[name]), dtype=kind)
    counts = join("counts", np.uint32)
    return np.repeat(join("sets", np.int64), counts), np.repeat(join("sizes", np.uint32), counts), join("values", np.uint64)


def _high(values: np.ndarray, buckets: int) -> np.ndarray:
    return (((values >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def shared_shingles(documents: DataFrame, buckets: int) -> DataFrame:
    """``set_id, n, values``: the sets that could have a partner, with those of their shingles that other sets hold too."""

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        salt = np.int64(TaskContext.get().partitionId() % 64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> pd.DataFrame:
            values, counts, whole = map(np.concatenate, zip(*held, strict=True))
            held.clear()
            _, first = np.unique(whole, return_index=True)
            fresh = np.zeros(len(whole), dtype=bool)
            fresh[first] = True
            fresh &= counts > 0
            keep = np.repeat(fresh, counts)
            values, sets, sizes = values[keep], np.repeat(whole, counts)[keep], np.repeat(counts, counts)[keep]
            order = np.argsort(values)
            ranked = values[order]
            same = np.zeros(len(values), dtype=bool)
            same[1:] |= ranked[1:] == ranked[:-1]
            same[:-1] |= ranked[:-1] == ranked[1:]
            again = np.zeros(len(values), dtype=bool)
            again[order] = same
            rows = []
            once = ~again
            markers = np.unique(values[again])
            zero = np.zeros(len(markers), dtype=np.int64)
            sent = np.concatenate([values[once], markers])
            rows += _packed(_high(sent, buckets), np.concatenate([sets[once], zero]), np.concatenate([sizes[once], zero]), sent, False)
            own = (sets[again] + salt) % buckets
            rows += _packed(own, sets[again], sizes[again], values[again], True)
            return pd.DataFrame(rows, columns=["bucket", "marked", "sets", "sizes", "counts", "values"])

        size = 0
        for batch in batches:
            for _, _, values, counts, whole in _sets([t or b"" for t in batch["text"]]):
                held.append((values, counts, whole))
                size += len(values)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        sets, sizes, values = _unpacked(rows[~rows["marked"]])
        order = np.lexsort((sets, values))
        sets, sizes, values = sets[order], sizes[order], values[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (sets[1:] != sets[:-1])
        sets, sizes, values = sets[new], sizes[new], values[new]
        same = np.zeros(len(values), dtype=bool)
        same[1:] |= values[1:] == values[:-1]
        same[:-1] |= values[:-1] == values[1:]
        same &= sets != 0
        known = _unpacked(rows[rows["marked"]])
        sets, sizes, values = (np.concatenate([x[same], y]) for x, y in zip((sets, sizes, values), known, strict=True))
        return pd.DataFrame(list(_packed(sets % buckets, sets, sizes, values, True)), columns=["bucket", "marked", "sets", "sizes", "counts", "values"])

    def gather(rows: pd.DataFrame) -> pd.DataFrame:
        sets, sizes, values = _unpacked(rows)
        values = values.view(np.int64)
        order = np.lexsort((values, sets))
        sets, sizes, values = sets[order], sizes[order], values[order]
        new = np.ones(len(values), dtype=bool)
        new[1:] = (values[1:] != values[:-1]) | (sets[1:] != sets[:-1])
        sets, sizes, values = sets[new], sizes[new], values[new]
        start = np.flatnonzero(np.r_[True, sets[1:] != sets[:-1]]) if len(sets) else np.zeros(0, dtype=np.int64)
        stop = np.append(start[1:], len(sets))
        enough = 100 * (stop - start) >= PERCENT * sizes[start].astype(np.int64)
        start, stop = start[enough], stop[enough]
        lists = pd.Series([values[a:b] for a, b in zip(start, stop, strict=True)], dtype=object)
        return pd.DataFrame({"set_id": sets[start], "n": sizes[start].astype(np.int64), "values": lists})

    texts = documents.select(F.col("text").cast("binary").alias("text"))
    packed = texts.mapInPandas(deal, _PACKED)
    met = packed.groupBy("bucket").applyInPandas(meet, _PACKED)
    return met.groupBy("bucket").applyInPandas(gather, "set_id long, n long, values array<long>")


def keys_of(sets: DataFrame) -> DataFrame:
    """``set_id, key``: the first shingles of each set in the common order, by which linked sets must meet."""
    postings = sets.select("set_id", F.explode("values").alias("value"))
    often = settle(postings.groupBy("value").agg(F.count("*").alias("often")).where(F.col("often") > FREQUENT), "frequent")
    late = postings.join(if_small(often), "value").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("often", "value"))).alias("late"))
    df = sets.join(late, "set_id", "left")
    last = F.transform("late", lambda x: x["value"])
    order = F.when(F.col("late").isNull(), F.col("values")).otherwise(F.concat(F.array_except("values", last), last))
    wanted = F.size("values") - F.expr(f"(n * {PERCENT} + 99) div 100") + 1
    return df.select("set_id", F.explode(F.slice(order, F.lit(1), wanted.cast("int"))).alias("key"))


def rank(x: str) -> Column:
    return F.xxhash64(F.lit("pivot"), x)


def distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``x, p`` to ``x, p, d, linked``. Sets of sizes too far apart to link still get their distance, as windows need it."""
    mine = sets.select(F.col("set_id").alias("x"), F.col("n").alias("nx"), F.col("values").alias("vx"))
    pivot = sets.select(F.col("set_id").alias("p"), F.col("n").alias("np"), F.col("values").alias("vp"))
    # The popular side first: there the pairs are narrow, and Spark can split a pivot with very many of them.
    both = pairs.select("x", "p").join(pivot, "p").join(mine, "x")
    # Shingles that no other set holds are in no intersection, so the shared ones are enough.
    df = both.select("x", "p", "nx", "np", F.size(F.array_intersect("vx", "vp")).cast("long").alias("c"))
    union = F.col("nx") + F.col("np") - F.col("c")
    return df.select("x", "p", (1 - F.col("c") / union).alias("d"), (100 * F.col("c") >= PERCENT * union).alias("linked"))


def _region_links(keys: list[str]):
    """A task's join of one block: members (``query`` false) and queries, rows of one block standing together."""

    def join(rows: pd.DataFrame) -> list[tuple[int, int]]:
        query = rows["query"].to_numpy()
        ids, n, home = (rows[c].to_numpy() for c in ("set_id", "n", "root"))
        lists = rows["values"].tolist()
        members = np.flatnonzero(~query)
        if not len(members) or not query.any():
            return []
        sizes = np.array([len(lists[i]) for i in members])
        flat = np.concatenate([lists[i] for i in members])
        owner = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        parent: dict[int, int] = {}

        def find(a: int) -> int:
            while parent.setdefault(a, a) != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        out = []
        for q in np.flatnonzero(query):
            values = lists[q]
            lo, hi = np.searchsorted(flat, values, "left"), np.searchsorted(flat, values, "right")
            width = hi - lo
            hit = np.repeat(lo, width) + np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
            common = np.bincount(owner[hit], minlength=len(members))
            near = 100 * common >= PERCENT * (n[members] + n[q] - common)
            for m in members[near & (ids[members] != ids[q])]:
                a, b = find(int(home[q])), find(int(home[m]))
                if a != b:
                    parent[a] = b
                    out.append((int(ids[q]), int(ids[m])))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            edge = np.flatnonzero((batch[keys] != batch[keys].shift()).any(axis=1).to_numpy())
            out = [x for a, b in zip(edge[:-1], edge[1:], strict=True) for x in join(batch.iloc[a:b].reset_index(drop=True))]
            rest = batch.iloc[edge[-1]:].reset_index(drop=True) if len(edge) else None
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)
        if rest is not None:
            yield pd.DataFrame(join(rest), columns=["a", "b"], dtype=np.int64)

    return run


def links(sets: DataFrame) -> DataFrame:
    """``a, b``: links between sets, enough to connect everything that is connected. ``sets`` as from ``shared_shingles``, stored."""
    keys = settle(keys_of(sets), "keys")
    pivots = keys.groupBy("key").agg(F.min(F.struct(rank("set_id").alias("r"), F.col("set_id").alias("p"))).alias("m"), F.count("*").alias("c")).where("c > 1")
    met = keys.join(pivots.select("key", F.col("m").alias("m")), "key")
    # Of the pivots of a set's keys the one of the least hash serves; the others are no pivots unless another set calls them.
    called = settle(met.groupBy("set_id").agg(F.min("m").alias("m")).select(F.col("m.p").alias("p")).distinct(), "pivots")
    met = met.select("set_id", F.col("m.p").alias("p")).join(called, "p")
    near = settle(distances(met.where("set_id <> p").select(F.col("set_id").alias("x"), "p").distinct(), sets), "near")
    nearest = near.groupBy("x").agg(F.min(F.struct("d", rank("p").alias("r"), "p")).alias("m")).select("x", F.col("m.p").alias("home"), F.col("m.d").alias("d"))
    homes = called.select(F.col("p").alias("x"), F.col("p").alias("home"), F.lit(0.0).alias("d")).unionByName(
        nearest.join(called, F.col("x") == F.col("p"), "left_anti"))
    first = near.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))
    roots = components(first)
    homes = settle(homes.join(roots.withColumnRenamed("node", "x"), "x", "left").select("x", "home", "d", F.coalesce("root", "x").alias("root")), "homes")
    regions = settle(homes.groupBy("home").agg(F.count("*").alias("size"), F.max("d").alias("radius"), F.min("root").alias("low"), F.max("root").alias("high")), "regions")

    # regions that share a key
    here = keys.join(homes.select(F.col("x").alias("set_id"), "home"), "set_id").select("key", "home").distinct()
    side = lambda s: regions.select(*[F.col(c).alias(c + s) for c in ("home", "size", "radius", "low", "high")])
    meeting = here.select("key", F.col("home").alias("home1")).join(here.select("key", F.col("home").alias("home2")), "key").where(
        "home1 < home2").select("home1", "home2").distinct()
    apart = meeting.join(side("1"), "home1").join(side("2"), "home2").where("not (low1 = high1 and low2 = high2 and low1 = low2)")
    bigger = (F.col("size1") > F.col("size2")) | ((F.col("size1") == F.col("size2")) & (F.col("home1") < F.col("home2")))
    pick = lambda c, large: F.when(bigger if large else ~bigger, F.col(c + "1")).otherwise(F.col(c + "2")).alias(c)
    visits = settle(apart.select(pick("home", False).alias("from"), pick("home", True).alias("p"), pick("radius", True), pick("low", True), pick("high", True)), "visits")
    guests = visits.join(homes.select("x", F.col("home").alias("from"), "root"), "from").where("not (low = high and root = low)")
    guests = settle(guests.select("x", "p", "radius").distinct(), "guests")
    measured = near.select("x", "p", "d", "linked")
    more = settle(distances(guests.join(measured, ["x", "p"], "left_anti"), sets), "more")
    known = guests.join(measured.unionByName(more), ["x", "p"])
    boundary = known.where(F.col("d") <= F.col("radius") + REACH + SLACK).select("x", "p", "d")

    # exact joins inside regions
    outer = homes.join(regions.where("low <> high").select("home"), "home").where(F.col("d") > REACH - SLACK).select("x", F.col("home").alias("p"), "d")
    queries = settle(boundary.unionByName(outer).distinct(), "queries")
    asked = queries.groupBy("p").agg(F.count("*").alias("asked"))
    plan = regions.join(asked, F.col("home") == F.col("p")).select("p", "size", F.ceil(F.col("asked") / BLOCK).alias("chunks"))
    ring = lambda d: F.floor(d / RING).cast("int")
    own = homes.select("x", F.col("home").alias("p"), "d").join(plan, "p")
    own = own.withColumn("ring", F.when(F.col("size") > BLOCK, ring(F.col("d"))).otherwise(-1))
    rings = settle(own.groupBy("p", "ring").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "rings")
    chunk = F.pmod(F.xxhash64(F.lit("chunk"), "x"), F.col("chunks"))
    members = own.join(rings, ["p", "ring"]).select(
        "x", "p", "ring", F.pmod(F.xxhash64(F.lit("block"), "x"), F.col("blocks")).alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("query"))
    visiting = queries.join(plan, "p").withColumn("chunk", chunk)
    wide = visiting.select("x", "p", "d", "chunk", F.when(F.col("size") > BLOCK, F.sequence(
        ring(F.col("d") - REACH - SLACK), ring(F.col("d") + REACH + SLACK))).otherwise(F.array(F.lit(-1))).alias("rings"))
    asking = wide.select("x", "p", "chunk", F.explode("rings").alias("ring")).join(rings, ["p", "ring"]).select(
        "x", "p", "ring", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "chunk", F.lit(True).alias("query"))
    place = ["p", "ring", "block", "chunk"]
    placed = members.unionByName(asking.select(*members.columns)).join(homes.select("x", "root"), "x")
    loaded = placed.join(sets.select(F.col("set_id").alias("x"), "n", "values"), "x").withColumnRenamed("x", "set_id")
    joined = loaded.repartition(*place).sortWithinPartitions(*place).mapInPandas(_region_links(place), "a long, b long")
    second = more.where("linked").select(F.col("x").alias("a"), F.col("p").alias("b"))
    return settle(joined.unionByName(second).unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))), "links")


def join_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, text_hash, n_shingles, root, component_id`` per document row. ``root`` names the component of a row that is not alone."""
    rows = settle(memberships(documents), "memberships")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("n")).first()["n"]
    buckets = max(LEAST_BUCKETS, -(-total // PER_BUCKET))
    sets = settle(shared_shingles(documents, int(buckets)), "sets")
    roots = components(links(sets))
    classes = rows.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    # classes of one row that link with nothing need no row of their own
    joined = classes.join(roots, F.col("set_id") == F.col("node"), "left").where("copies > 1 or root is not null")
    joined = settle(joined.select("set_id", F.coalesce("root", "set_id").alias("root"), "least"), "classes")
    named = joined.join(joined.groupBy("root").agg(F.min("least").alias("component")), "root").select("set_id", "root", "component")
    return rows.join(named, "set_id", "left").select("doc_id", "text_hash", "n_shingles", "root", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first(documents: DataFrame) -> DataFrame:
    """One document of each component stays: the one of the smallest id (a null id comes last; of equal ids the smaller text hash). Rows that
    repeat both id and text count as one document. Documents without words stay."""
    joined = settle(join_documents(documents).where("root is not null"), "joined")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    first = joined.groupBy("root").agg(F.min(place).alias("first"))
    gone = joined.join(first, "root").where((F.col("text_hash") != F.col("first.text_hash")) | ~F.col("doc_id").eqNullSafe(F.col("first.doc_id")))
    key, own = unused(documents.columns, "id", "text")
    gone = settle(gone.select(F.col("doc_id").alias(key), F.col("text_hash").alias(own)).distinct(), "gone")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(own))
    kept = documents.join(if_small(gone), same, "left_anti")
    again = settle(joined.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(own)), "again")
    if again.isEmpty():
        return kept
    once = kept.join(if_small(again), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(if_small(again), same, "left_anti").unionByName(once)
