"""Token counts without token ids.

A byte-level BPE tokenizer cuts a text into pre-tokens (pieces of text that no merge crosses), and the number of tokens of a pre-token does
not depend on its surroundings. So the count of a text is the sum over its distinct pre-tokens of frequency times tokens.

1. Every task cuts its texts and packs, per bucket of the pre-token's hash, the distinct pre-tokens and the (document, pre-token, frequency)
   entries: the frequencies are pre-aggregated and a common pre-token is sent once per pack, not once per document.
2. A bucket counts the tokens of each of its distinct pre-tokens once, joins them to the frequencies and sums per document of a pack.
3. The partial sums of a pack, one row per bucket, are added up.

Special strings are cut out first as
the tokenizer does by default and count one token each. ``public_tokenizers`` is the place of the vocabulary files; the path is a parameter.

Null text counts as empty (0 bytes, 0 tokens). Rows need no id: repeated rows, and equal or null ids, are counted one by one. An
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from taxloom.llm.sizes import stored_bytes

LIMIT = 512
#: Pre-tokens are dealt to at least so many buckets, and to one for so many bytes of the stored table: a bucket's size does not grow with the data.
LEAST_BUCKETS, BUCKET_BYTES = 64, 4 << 20
#: Documents and bytes of text packed together at most.
PACK_ROWS, PACK_BYTES = 8192, 16 << 20
#: Texts with other characters are cut by the library itself; for these the pattern engines cannot differ.
_PLAIN = regex.compile(r"[\t-\r -~¡-¬®-ɏ‘-„€]*")
# Fixed value: the pattern of byte-level pre-tokenization.
_PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def _tokenizer(path: str):
    """The tokenizer of a file, its pre-tokenizer and the strings it treats as special; read once per worker."""
    if path not in _tokenizer.known:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        special = sorted((t.content for t in tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        _tokenizer.known[path] = tok, regex.compile("|".join(map(regex.escape, special))) if special else None
    return _tokenizer.known[path]


_tokenizer.known = {}


def _byte_names() -> dict[str, int]:
    """The printable characters that stand for bytes in the library's pre-tokens: printable ones for themselves, others from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


_NAMES = _byte_names()


def pre_tokens(text: str, path: str) -> tuple[list[str], int]:
    """The pre-tokens of a text and the number of special strings in it."""
    tok, special = _tokenizer(path)
    parts = special.split(text) if special else [text]
    found: list[str] = []
    for part in parts:
        if _PLAIN.fullmatch(part):
            found += _PATTERN.findall(part)
        elif part:
            for name, _ in tok.pre_tokenizer.pre_tokenize_str(part):
                found.append(bytes(_NAMES[c] for c in name).decode("utf-8", "surrogateescape"))
    return found, len(parts) - 1


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes that hold the largest, with that width in front."""
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if not len(values) or values.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype={1: np.uint8, 2: np.uint16, 4: np.uint32}[raw[0]], offset=1).astype(np.int64)


def _pack_rows(texts: list[str], path: str, buckets: int) -> list[dict]:
    """Per bucket: the distinct pre-tokens; entries per document; and per entry the place of the pre-token and its frequency."""
    index: dict[str, int] = {}
    sizes, places, times = [], [], []
    for text in texts:
        found, extra = pre_tokens(text, path)
        counts = Counter(found)
        if extra:
            counts[""] = extra  # stands for special strings: one token each
        sizes.append(len(counts))
        places.append(np.fromiter((index.setdefault(w, len(index)) for w in counts), dtype=np.int64, count=len(counts)))
        times.append(np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))
    place, time = np.concatenate(places), np.concatenate(times)
    doc = np.repeat(np.arange(len(texts)), sizes)
    raw = [w.encode("utf-8", "surrogateescape") for w in index]
    own = np.array([zlib.crc32(w) % buckets for w in raw], dtype=np.int64)
    order = np.argsort(own[place], kind="stable")
    doc, place, time = doc[order], place[order], time[order]
    cut = np.searchsorted(own[place], np.arange(buckets + 1))
    rows = []
    for b in range(buckets):
        x, y = cut[b], cut[b + 1]
        if x == y:
            continue
        ids, local = np.unique(place[x:y], return_inverse=True)
        chosen = [raw[i] for i in ids]
        rows.append({"bucket": b, "words": b"".join(chosen), "lengths": _narrow(np.array([len(w) for w in chosen])),
                     "entries": _narrow(np.bincount(doc[x:y])), "places": _narrow(local), "times": _narrow(time[x:y])})
    return rows


def count_tokens(documents: DataFrame, path: str, buckets: int | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per document row. ``path`` names a tokenizer file that all workers can read."""
    texts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    buckets = buckets or max(LEAST_BUCKETS, -(-stored_bytes(texts) // BUCKET_BYTES))

    names = ["bucket", "pack", "ids", "n_bytes", "words", "lengths", "entries", "places", "times"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = 0
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and end - at < PACK_ROWS and (end == at or size < PACK_BYTES):
                    size += len(texts[end] or "")
                    end += 1
                pack = f"{TaskContext.get().partitionId()}-{number}"
                chosen = [t or "" for t in texts[at:end]]
                rows = _pack_rows(chosen, path, buckets)
                m = len(rows)
                head = [[batch.column("doc_id").slice(at, end - at).to_pylist()], [[len(t.encode("utf-8")) for t in chosen]]]
                cols = [pa.array([number % buckets] + [r["bucket"] for r in rows], type=pa.int32()), pa.array([pack] * (m + 1)),
                        pa.array(head[0] + [None] * m, type=pa.list_(pa.string())), pa.array(head[1] + [None] * m, type=pa.list_(pa.int64()))]
                cols += [pa.array([None] + [r[c] for r in rows], type=pa.binary()) for c in names[4:]]
                yield pa.RecordBatch.from_arrays(cols, names)
                number += 1
                at = end

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        """Heads of packs go through; entries become sums per document of the pack."""
        tok, _ = _tokenizer(path)
        packed = rows[rows["words"].notna()]
        index: dict[bytes, int] = {}
        lists = []
        for words, lengths in zip(packed["words"], packed["lengths"], strict=True):
            stops = np.cumsum(_wide(lengths)).tolist()
            lists.append(np.array([index.setdefault(words[a:b], len(index)) for a, b in zip([0, *stops], stops, strict=False)], dtype=np.int64))
        distinct = list(index)
        known = np.zeros(len(distinct), dtype=np.int64)
        for i in range(0, len(distinct), 10_000):
            part = [w.decode("utf-8", "surrogateescape") for w in distinct[i:i + 10_000]]
            known[i:i + len(part)] = [len(e.ids) for e in tok.encode_batch(part, add_special_tokens=False)]
        if b"" in index:
            known[index[b""]] = 1
        out = []
        for own, entries, places, times in zip(lists, packed["entries"], packed["places"], packed["times"], strict=True):
            entries = _wide(entries)
            each = known[own[_wide(places)]] * _wide(times)
            sums = np.concatenate([[0], np.cumsum(each)])
            stops = np.cumsum(entries)
            out.append(sums[stops] - sums[stops - entries])
        done = pd.DataFrame({"pack": packed["pack"], "ids": None, "n_bytes": None, "sums": pd.Series(out, dtype=object, index=packed.index)})
        heads = rows[rows["words"].isna()][["pack", "ids", "n_bytes"]].assign(sums=None)
        return pd.concat([done, heads], ignore_index=True)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        head = rows[rows["ids"].notna()].iloc[0]
        total = np.zeros(len(head["n_bytes"]), dtype=np.int64)
        for part in rows["sums"].dropna():
            total[:len(part)] += part
        return pd.DataFrame({"doc_id": pd.Series(list(head["ids"]), dtype=object), "n_bytes": head["n_bytes"], "n_tokens": total})

    packs = texts.mapInArrow(cut, "bucket int, pack string, ids array<string>, n_bytes array<long>, words binary, lengths binary, entries binary, "
                                  "places binary, times binary")
    sums = packs.groupBy("bucket").applyInPandas(meet, "pack string, ids array<string>, n_bytes array<long>, sums array<long>")
    counted = sums.groupBy("pack").applyInPandas(add, "doc_id string, n_bytes long, n_tokens long")
    return counted.select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
