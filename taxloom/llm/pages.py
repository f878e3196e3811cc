"""Main text of web pages by consensus of a host's pages.

1. Every page is parsed and its containers are scored: the share of the page's clean text (letters and other visible characters outside links, those
   outside paragraphs and headings counted half) that stands in a container, nested ones included. A container is named by its generalised path:
   tags from the root, each with its class (digits in a class become ``#``). A page votes for all its paths with these shares.
2. Votes are summed per host and path in Spark (combined before the shuffle, so a hot host is a few rows per task); per host the deepest path
   wins that holds more than half of the clean text of the host's pages taken together, ties going to the larger sum, then the smaller name.
3. Every page is parsed again. It starts from the winning path, or, where that holds not more than half of the page's own clean text, from the
   page's deepest path that does. From there it goes up to the ancestor while what the ancestor adds is mostly paragraphs and headings (a title, a
   lead, a sibling section), and never out of an ``article`` or ``main``. Its text is that of all containers on the path reached.

Left out wherever they stand: head, scripts, styles, menus, headers and footers of the page, sidebars, forms, buttons, and elements whose
class, id or role names advertising, notices, navigation, sharing or reader comments: a name of theirs alone (``share``, ``comments``) or with words for
parts of a page only (``share-buttons``, ``site-footer``), so ``share-price`` stays. A ``header`` inside an article is kept, as it is part of it.

A page without ``body`` is read as the inside of one. A path longer than ``LONG_PATH`` is shortened by a digest, so deep nesting costs no more than its depth.
Null and empty pages give empty text. A page may end anywhere: open elements end with it, and a tag cut off at the end is dropped. A null URL is a
host of its own. Repeated rows and equal ids are pages of their own. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from taxloom.llm.sizes import if_small
from taxloom.session import settle

LONG_PATH = 400

# Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg".split())
DROPPED = frozenset("head script style noscript template textarea title iframe svg nav footer aside form button select menu dialog canvas object".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CONTAINERS = frozenset("article main section div body td".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th figcaption".split())
#: Opening the key closes an open element of the values (within the same container).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
# Names of what is not part of an article, words for parts of a page that may stand beside them, and names of places that may stand before.
NOISE = frozenset("ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion banner banners cookie cookies consent gdpr notice "
                  "notices popup popups modal newsletter subscribe subscription nav navbar navigation navi menu menus breadcrumb breadcrumbs sidebar footer masthead share shares "
                  "sharing social related comment comments disqus reply replies respond".split())
PARTS = frozenset("bar bars block blocks body box boxes btn btns button buttons center col column container content contents count form group header heading icon icons inner item items "
                  "label left link links list listing message messages outer overlay panel popup region right row section side slot space strip table tag text thread title toggle "
                  "toolbar top unit widget widgets wrap wrapper zone articles posts stories media".split())
PLACES = frozenset("site page main top bottom left right global user users reader readers post posts article blog side primary secondary mobile js social email skip sticky fixed "
                   "google dfp the".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")


class _Container:
    """One container: its path and its parent's, its depth, the range of its blocks, and characters in textual elements, elsewhere and in links."""

    __slots__ = ("path", "above", "tag", "depth", "first", "last", "text", "other", "linked")

    def __init__(self, path: str, above: str, tag: str, depth: int, first: int, counts: tuple[int, int, int]):
        self.path, self.above, self.tag, self.depth, self.first, self.last = path, above, tag, depth, first, first
        self.text, self.other, self.linked = counts


def is_noise(names: str) -> bool:
    """Whether one of the blank-separated names stands for what is not part of an article."""
    for token in names.lower().split():
        words = [w for w in re.split(r"[-_]+", token) if w and not w.isdigit()]
        at = next((i for i, w in enumerate(words) if w in NOISE), None)
        if at is not None and all(w in PLACES for w in words[:at]) and all(w in NOISE or w in PARTS for w in words[at + 1:]):
            return True
    return False


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t\r") else {}


def containers(page: str) -> tuple[list[_Container], list[str]]:
    """The containers of a page and its blocks of clean text, both in page order; a container's blocks are a range."""
    found: list[_Container] = []
    blocks: list[str] = []
    stack: list[tuple[str, _Container | None, bool]] = []  # tag, its container, whether it drops its content
    block_at: list[int] = []  # places of block elements in the stack
    opened: dict[str, int] = {}  # how many of a tag are open
    live: list[_Container] = []
    piece: list[str] = []
    drop = link = textual = 0
    counts = [0, 0, 0]

    def end_block() -> None:
        if piece:
            text = _SPACE.sub(" ", "".join(piece)).strip(" ")
            piece.clear()
            if text:
                blocks.append(text)

    def close(depth: int) -> None:
        nonlocal drop, link, textual
        while len(stack) > depth:
            tag, box, dropped = stack.pop()
            opened[tag] -= 1
            if tag in BLOCKS:
                end_block()
                block_at.pop()
            drop -= dropped
            if box:
                live.pop()
                box.last = len(blocks)
                box.text, box.other, box.linked = counts[0] - box.text, counts[1] - box.other, counts[2] - box.linked
            link -= tag == "a"
            textual -= tag in TEXTUAL

    def say(raw: str) -> None:
        if raw and not drop and live:
            text = entities.unescape(raw) if "&" in raw else raw
            piece.append(text)
            counts[2 if link else 0 if textual else 1] += len(text) - text.count(" ")

    at = 0
    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at:m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m.group(0)[-1] != ">":
            break  # cut off inside a tag
        if m[1]:
            if opened.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name == "p":
                end_block()
            continue
        if name in VOID:
            if name == "br":
                piece.append("\n")
            elif name == "hr":
                end_block()
            continue
        raw = m[3]
        if name in RAW:
            if name == "svg" and raw.rstrip().endswith("/"):
                continue
            stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            # a drawing that is never closed hides nothing; the others take the rest of the page, as browsers have it
            at = stop.end() if stop else at if name == "svg" else size
            continue
        if name in BLOCKS:
            # a paragraph ends where a block begins, with whatever is open inside it
            if block_at and stack[block_at[-1]][0] == "p":
                close(block_at[-1])
            end_block()
        if name in CLOSES:
            for i in reversed(block_at):
                if stack[i][0] in CLOSES[name]:
                    close(i)
                    break
                if stack[i][0] in CONTAINERS or stack[i][0] in ("ul", "ol", "dl", "table"):
                    break
        attributes = _attributes(raw)
        inside = opened.get("article") or opened.get("main")
        dropped = name in DROPPED or (name == "header" and not inside) or "hidden" in attributes
        if not dropped and attributes and name not in ("html", "body", "article", "main"):
            dropped = any(is_noise(attributes[k]) for k in ("class", "id", "role") if k in attributes)
        box = None
        if name in CONTAINERS and not dropped and not drop:
            label = re.sub(r"\d+", "#", ".".join(sorted(attributes.get("class", "").split())))
            above = live[-1].path if live else ""
            head = above if len(above) <= LONG_PATH else "#" + blake2b(above.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()
            box = _Container(f"{head}/{name}" + (f".{label}" if label else ""), above, name, len(live), len(blocks), tuple(counts))
            found.append(box)
            live.append(box)
        if name in BLOCKS:
            block_at.append(len(stack))
        stack.append((name, box, dropped))
        opened[name] = opened.get(name, 0) + 1
        drop += dropped
        link += name == "a"
        textual += name in TEXTUAL
    close(0)
    end_block()
    return found, blocks


def parsed(page: str | None) -> tuple[list[_Container], list[str]]:
    """As ``containers``; a page without ``body`` is read as the inside of one."""
    if not page:
        return [], []
    return containers(page if "<body" in page.lower() else "<body>" + page)


class _Path:
    """What the containers on one path hold together."""

    __slots__ = ("path", "above", "tag", "depth", "text", "other", "linked", "boxes")

    def __init__(self, box: _Container):
        self.path, self.above, self.tag, self.depth = box.path, box.above, box.tag, box.depth
        self.text = self.other = self.linked = 0
        self.boxes: list[_Container] = []

    @property
    def clean(self) -> float:
        return self.text + self.other / 2


def paths_of(found: list[_Container]) -> dict[str, _Path]:
    out: dict[str, _Path] = {}
    for box in found:
        own = out.get(box.path) or out.setdefault(box.path, _Path(box))
        own.text, own.other, own.linked = own.text + box.text, own.other + box.other, own.linked + box.linked
        own.boxes.append(box)
    return out


def shares(paths: dict[str, _Path]) -> list[tuple[str, int, float]]:
    """Path, depth and share of the page's clean text, for the paths that have any; the path ``""`` stands for the page."""
    whole = sum(p.clean for p in paths.values() if p.depth == 0)
    return [("", -1, 1.0)] + [(p.path, p.depth, p.clean / whole) for p in paths.values() if p.clean] if whole else []


def reached(paths: dict[str, _Path], start: str | None) -> _Path | None:
    """The path of a page's text: from the winning path, or the page's own, up as long as paragraphs and headings come in."""
    whole = sum(p.clean for p in paths.values() if p.depth == 0)
    here = paths.get(start) if start else None
    if here is None or 2 * here.clean <= whole:
        here = min((p for p in paths.values() if 2 * p.clean > whole), key=lambda p: (-p.depth, -p.clean, p.path), default=None)
    above = here
    while above is not None and above.tag not in ("article", "main") and above.above in paths:
        above = paths[above.above]
        text, other, linked = above.text - here.text, above.other - here.other, above.linked - here.linked
        if text and text >= 2 * other and text >= linked:
            here = above
        elif other or linked:
            break
    return here


def text_on(page: tuple[list[_Container], list[str]], start: str | None) -> str:
    """The blocks of the containers on the path reached, in page order."""
    found, blocks = page
    own = reached(paths_of(found), start)
    return "\n\n".join(b for c in own.boxes for b in blocks[c.first:c.last]) if own else ""


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"://(?:www\.)?([^/?#:]*)", 1))


def votes(pages: DataFrame) -> DataFrame:
    """``host, path, depth, score``: every page's shares; the path ``""`` counts pages with clean text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host, *s) for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True)
                    for s in shares(paths_of(parsed(page)[0]))]
            host, path, depth, score = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(depth, pa.int32()), pa.array(score, pa.float64())],
                                             ["host", "path", "depth", "score"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(run, "host string, path string, depth int, score double")


def winning_paths(found: DataFrame) -> DataFrame:
    """``host, path``: the deepest path that holds more than half of the votes of the host's pages."""
    sums = settle(found.groupBy("host", "path").agg(F.min("depth").alias("depth"), F.round(F.sum("score"), 6).alias("score")), "votes")
    whole = sums.where("path = ''").select(F.col("host").alias("of"), F.col("score").alias("pages"))
    held = sums.where("path <> ''").join(whole, F.col("host").eqNullSafe(F.col("of"))).where(2 * F.col("score") > F.col("pages"))
    order = Window.partitionBy("host").orderBy(F.desc("depth"), F.desc("score"), "path")
    return held.withColumn("r", F.row_number().over(order)).where("r = 1").select("host", "path")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, path`` per page; ``path`` is the winning path of its host, or null if nothing on the host had a vote."""
    winners = settle(winning_paths(votes(pages)), "winners").withColumnRenamed("host", "__host")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_on(parsed(h), p) for h, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), batch.column("path")],
                                             ["page_id", "url", "text", "path"])

    df = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    named = df.join(if_small(winners), F.col("host").eqNullSafe(F.col("__host")), "left")
    return named.select("page_id", "url", "html", "path").mapInArrow(run, "page_id long, url string, text string, path string")
