"""Secret scans with multipart credential linking.

A first pass over the texts (Python's regular expressions in batches, no shuffle) finds spans of three strong kinds, each leftmost and
non-overlapping within its kind, and weak parts: text that is only suspicious next to its complement.

* ``assign``: a credential word, ``:`` or ``=``, and a value of 12 or more characters.  * ``access``: ``AKIA`` and capitals or digits, 18 or more.
* ``hex``: 16 or more of 0-9 a-f.

Weak parts are ``identifier`` (a short access id or an assignment to a user, client or key id, login or email), ``secret`` (a mixed token of 20 or more characters,
or an assignment whose value was too short) and ``endpoint`` (a URL or host of an api, auth or login service). Linking is an interval
join: each weak part covers ``SCOPE`` characters around itself, and it is reported only if a part of a complementary role, weak or strong,
begins inside and does not overlap it. The text is laid on a grid of cells of ``SCOPE`` characters, each part stands in its own cell and the two beside it, and
within (row, cell) a sliding window looks for complements. A cell holds at most ``SCOPE`` parts per kind, so windows are bounded however
long a text or hot a key is, and no pairs are written.

Rows are told apart by position in the stored scan, so repeated rows and equal or null ids are each scanned. A null text is empty and
has no spans. Spans are code points, end exclusive. Columns of other names are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from taxloom.llm.names import unused
from taxloom.llm.sizes import if_small
from taxloom.session import settle

SCOPE = 200
ASSIGN_VALUE, ACCESS_SIZE, HEX_SIZE = 12, 18, 16
STRONG = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
#: The order of kinds in digests.
ORDER = STRONG + WEAK
#: What completes what. A strong access id is an identifier, a strong assignment or hex run a secret.
ROLE = {"access": "identifier", "assign": "secret", "hex": "secret", "identifier": "identifier", "secret": "secret", "endpoint": "endpoint"}

# re.A keeps \x20-style classes to ASCII; the credential words are spelled per letter so that no other letter folds to them.
_spelled = lambda *words: "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else "_?" for c in w) for w in words)
_WORD = _spelled("password", "passwd", "secret", "token", "api_key")
_OWNER, _FIELD, _ALONE = _spelled("client", "user", "account", "access", "login"), _spelled("id", "name", "key_id", "key"), _spelled("login", "email", "key_id")
_ASSIGN = re.compile(rf"(?:{_WORD})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_IDENTIFIER = re.compile(rf"(?:(?:{_OWNER})_?(?:{_FIELD})|{_ALONE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]{{4,}})")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_MIXED = tuple(re.compile(c) for c in ("[0-9]", "[A-Z]", "[a-z]"))
_URL = re.compile(r"[Hh][Tt][Tt][Pp][Ss]?://([A-Za-z0-9.-]*[A-Za-z0-9])(?::[0-9]+)?(/[A-Za-z0-9._~/-]*)?")
#: A first host label that begins with such a word, or one that is such a word (with a version number) elsewhere in host or path.
_SERVICE = re.compile(r"(?:api|auth|login|oauth)|.*?[./_~-](?:api|auth|login|oauth)[0-9]*(?:[./_~-]|\Z)")
SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All strong spans and weak parts of one text; cheap substring tests come before the patterns."""
    out = []
    if "=" in text or ":" in text:
        for m in _ASSIGN.finditer(text):
            out.append(("assign" if len(m[1]) >= ASSIGN_VALUE else "secret", m.start(), m.end()))
        out += [("identifier", m.start(), m.end()) for m in _IDENTIFIER.finditer(text)]
    if "AKIA" in text:
        out += [("access" if m.end() - m.start() >= ACCESS_SIZE else "identifier", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    # maximal runs, so the runs of sixteen or more are the long ones among all runs
    out += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    if "://" in text:
        out += [("endpoint", m.start(), m.end()) for m in _URL.finditer(text) if _SERVICE.match((m[1] + (m[2] or "")).lower())]
    out += [("secret", m.start(), m.end()) for m in _TOKEN.finditer(text) if all(c.search(m[0]) for c in _MIXED)]
    return out


def scan(documents: DataFrame) -> DataFrame:
    """``row, doc_id, text_hash, parts`` for every document row."""

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(parts, kind)], ["doc_id", "text_hash", "parts"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return texts.mapInArrow(run, f"doc_id bigint, text_hash bigint, parts {SPANS}").withColumn("row", F.monotonically_increasing_id())


def _role(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair]), kind)


def linked(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complement in their scope: ``row, kind, start, end``. Rows without a weak part, or with one role only, stay out."""
    weak = F.exists("parts", lambda p: p["kind"].isin(*WEAK))
    roles = F.size(F.array_distinct(F.transform("parts", lambda p: _role(p["kind"]))))
    parts = scanned.where(weak & (roles > 1)).select("row", F.explode("parts").alias("p")).select("row", "p.*").distinct()
    parts = parts.withColumns({"role": _role(F.col("kind")), "own": F.expr(f"start div {scope}")})
    placed = parts.withColumn("cell", F.explode(F.array(F.col("own") - 1, F.col("own"), F.col("own") + 1)))
    near = Window.partitionBy("row", "cell").orderBy("start").rangeBetween(-scope, scope)
    around = placed.withColumn("around", F.collect_set(F.struct("role", "start", "end")).over(near))
    # a part that lies over another one is the same characters read twice, not its complement
    linked_ = F.exists("around", lambda o: (o["role"] != F.col("role")) & ((o["end"] <= F.col("start")) | (o["start"] >= F.col("end"))))
    return around.where((F.col("cell") == F.col("own")) & F.col("kind").isin(*WEAK) & linked_).select("row", "kind", "start", "end")


def find_secrets(documents: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``doc_id, text_hash, base, spans`` per document row: strong spans alone, and with the linked weak ones, both ordered by start, then kind."""
    scanned = settle(scan(documents), "scan")
    extra = linked(scanned, scope).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("extra"))
    rank = F.create_map(*[x for i, k in enumerate(ORDER) for x in (F.lit(k), F.lit(i))])

    def ordered(parts: Column) -> Column:
        keyed = F.transform(parts, lambda p: F.struct(p["start"].alias("start"), F.element_at(rank, p["kind"]).alias("rank"), p["end"].alias("end"), p["kind"].alias("kind")))
        return F.transform(F.array_sort(keyed), lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))

    df = scanned.join(extra, "row", "left").withColumn("strong", F.filter("parts", lambda p: p["kind"].isin(*STRONG)))
    every = F.concat("strong", F.coalesce("extra", F.array().cast(SPANS)))
    return df.select("doc_id", "text_hash", ordered(F.col("strong")).alias("base"), ordered(every).alias("spans"))


def told(parts: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(parts, lambda p: F.concat_ws(":", p["kind"], p["start"].cast("string"), p["end"].cast("string"))), ",")


def _cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
    """Each text with its spans, which are ordered by start, replaced."""
    out = []
    for text, found in zip(texts, spans, strict=True):
        pieces, at = [], 0
        for p in found:
            if p["start"] >= at:
                pieces += [text[at:p["start"]], "[secret]"]
            at = max(at, p["end"])
        out.append("".join([*pieces, text[at:]]))
    return pd.Series(out, dtype=object)


def redact(documents: DataFrame) -> DataFrame:
    """The documents with every span in ``text`` replaced by ``[secret]`` (and ``n_chars``, where there is one, counted again).

    Documents are joined to their spans by id and a hash of the text; only documents with a span have a row there.
    """
    key, own, found = unused(documents.columns, "id", "text", "spans")
    spans = settle(find_secrets(documents).where(F.size("spans") > 0).select(
        F.col("doc_id").alias(key), F.col("text_hash").alias(own), F.col("spans").alias(found)).dropDuplicates([key, own]), "spans")
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(own))
    joined = documents.join(if_small(spans), same, "left")
    dirty = F.col(found).isNotNull()
    clean = joined.withColumn("text", F.when(dirty, F.pandas_udf(_cut, "string")(F.when(dirty, F.col("text")).otherwise(""), F.coalesce(found, F.array().cast(SPANS)))).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        clean = clean.withColumn("n_chars", F.when(dirty, F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.drop(key, own, found)
