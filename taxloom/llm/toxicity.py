"""Toxicity of texts that may be disguised: a noisy-channel decoder restores the words, a logistic model scores what was restored.

**Language model.** Tasks count the trigrams of characters of all documents (letters folded to lower case; every run of other characters is one
boundary), Spark adds the counts, whose number is bounded by the alphabet (``SYMBOLS`` cubed, 226,981), and smoothing gives the cost of a
character after two others.

**Channel.** A token that shows disguise is a lattice of what may have been meant: a digit or sign stands for a letter or for itself (a
boundary), a letter written three or more times for one or two of it, a sign between letters for nothing or for a boundary, and so does the blank
between single characters in a row of three or more. Viterbi's algorithm takes the path whose characters cost least under the language model
plus the channel's costs; time is linear in the token. A token of letters without such a run is a lattice of one path and is not decoded.

**Score.** A word gives itself and its beginnings as features, present or absent per document. From a sample of at most ``FIT_ROWS`` labelled rows
(the least hashes of the ids, so reruns agree) the features with the largest likelihood ratio are kept, at most ``FEATURES``, and a logistic
model is fitted to them. Rows whose crc32(id) mod 5 is 0 are held out and never read for it. Only the text of a document enters its score.

A null or empty text has no features and gets the model's score for none. Labels that are null, or whose document is absent, are left out;
of several labels of one id the largest counts, of several texts of a labelled id the first in order. Without labels of both kinds the score is
the share of toxic labels, 0 without any. A null id is never labelled and is not held out. Repeated rows are scored each; an empty table gives an
empty result. Only the id and the text are read of the documents; other columns, whatever their names, do not matter.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows that the classifier is fitted on, and features that it uses, at most.
FIT_ROWS, FEATURES = 12_000, 2_000
#: A feature must stand in so many toxic rows and have such a likelihood ratio.
LEAST_ROWS, LEAST_RATIO = 4, 15.0
#: Lengths of the beginnings of a word that are features besides the word.
BEGINNINGS = (3, 4, 5, 6)
FOLDS = 5
PENALTY, STEPS, RATE = 1e-4, 400, 0.05
#: Tokens that a task remembers, at most; longer ones than this are decoded anew.
REMEMBERED, LONG_TOKEN = 200_000, 64
SLICE = 1 << 20

# Letters that a digit or sign may stand for, and signs that are put between letters.
MEANT = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
         "+": "t", "(": "c", "€": "e", "£": "l"}
BETWEEN = ".-_*~'’`^,:;/\\ \t"
EDGE = ".,;:!?\"'`()[]{}<>#%&*_~^/\\=-…«»„“”’¡¿|+"

# Channel costs in nats: a sign for a letter inside a word and at its edge, a sign for itself in the same places, a dropped sign, a dropped blank, a shortened run.
AS_LETTER, AS_LETTER_EDGE, AS_SIGN, AS_SIGN_EDGE, DROPPED, DROPPED_BLANK, SHORTENED = 0.5, 1.5, 4.0, 1.0, 1.0, 0.5, 0.5

OTHER = 60
SYMBOLS = OTHER + 1
_RUN = re.compile(r"(.)\1\1")
_SIGNS_AT_END = re.compile(r"([$@+|€£])\1{2,}$")
_SINGLES = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
_NOT_LETTER = re.compile(r"[\W\d_]+")


def _symbol_table() -> np.ndarray:
    """Code points below U+0250 to symbols: 0 for a boundary, a to z, the letters U+00DF to U+00FF, OTHER."""
    table = np.zeros(0x250, dtype=np.uint8)
    for point in range(0x250):
        low = chr(point).lower()
        if low.isalpha() and len(low) == 1:
            table[point] = ord(low) - 96 if "a" <= low <= "z" else ord(low) - 0xDF + 27 if 0xDF <= ord(low) <= 0xFF else OTHER
    return table


TABLE = _symbol_table()


def symbols(text: str) -> np.ndarray:
    """The text as symbols, one per character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(points < len(TABLE), TABLE[np.minimum(points, len(TABLE) - 1)], OTHER)


def _counted(s: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Trigram counts of symbols, runs of boundaries made one; ``starts`` marks where a text begins, and no trigram spans two texts."""
    keep = (s != 0) | starts
    keep[1:] |= s[:-1] != 0
    keep[:1] = True
    s, starts = s[keep].astype(np.int64), starts[keep]
    within = ~(starts[1:-1] | starts[2:])
    return np.bincount(((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])[within], minlength=SYMBOLS**3)


def text_trigrams(texts: list[str]) -> np.ndarray:
    """Trigram counts of texts, each between two boundaries. Short texts are counted together, long ones in slices: memory follows SLICE."""
    counts, held, size = np.zeros(SYMBOLS**3, dtype=np.int64), [], 0

    def flush() -> None:
        nonlocal counts, held, size
        if held:
            starts = np.zeros(size, dtype=bool)
            starts[np.cumsum([0] + [len(t) + 2 for t in held[:-1]])] = True
            counts += _counted(symbols("".join(f" {t} " for t in held)), starts)
        held, size = [], 0

    for text in texts:
        if len(text) <= SLICE:
            held.append(text)
            size += len(text) + 2
            if size > SLICE:
                flush()
            continue
        carried = np.zeros(1, dtype=np.uint8)
        for at in range(0, len(text), SLICE):
            s = np.concatenate([carried, symbols(text[at:at + SLICE] + (" " if at + SLICE >= len(text) else ""))])
            counts += _counted(s, np.zeros(len(s), dtype=bool))
            carried = s[np.flatnonzero((s != 0) | (np.concatenate([[1], s[:-1]]) != 0))[-2:]]
    flush()
    return counts


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One count per trigram and task."""
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    for batch in batches:
        counts += text_trigrams([t for t in batch.column(0).to_pylist() if t])
    found = np.flatnonzero(counts)
    yield pa.record_batch([pa.array(found.astype(np.int32)), pa.array(counts[found])], names=["trigram", "n"])


def language_model(texts: DataFrame) -> np.ndarray:
    """Costs ``[before, last, next]`` in nats, from the trigrams of all texts."""
    found = texts.select("__text").mapInArrow(_trigrams, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in found:  # at most SYMBOLS ** 3 rows
        counts[r["trigram"]] = r["n"]
    return smoothed(counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS))


def smoothed(counts: np.ndarray, mass: float = 5.0) -> np.ndarray:
    """Trigrams backed by bigrams, those by single characters, those by equal shares."""
    pairs, singles = counts.sum(axis=0), counts.sum(axis=(0, 1))
    one = (singles + 1) / (singles.sum() + SYMBOLS)
    two = (pairs + mass * one) / (pairs.sum(axis=1, keepdims=True) + mass)
    three = (counts + mass * two) / (counts.sum(axis=2, keepdims=True) + mass)
    return -np.log(three).astype(np.float32)


def _symbol(char: str) -> int:
    return int(TABLE[ord(char)]) if ord(char) < len(TABLE) else OTHER


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each place of a lower-case token what may be meant there, and its cost: letters, a blank for a boundary, or nothing."""
    places, i, n = [], 0, len(token)
    while i < n:
        char, j = token[i], i + 1
        while j < n and token[j] == char:
            j += 1
        inside = i > 0 and j < n
        if char in MEANT:
            letter, sign = (AS_LETTER, AS_SIGN) if inside else (AS_LETTER_EDGE, AS_SIGN_EDGE)
            for _ in range(min(j - i, 2)):
                places.append([(x, letter) for x in MEANT[char]] + [(" ", sign)])
        elif not char.isalpha():
            drop = DROPPED_BLANK if char in " \t" else DROPPED
            places.append([(" ", 0.0)] + ([("", drop)] if inside and char in BETWEEN else []))
        elif j - i >= 3:
            places.append([(char, SHORTENED), (char * 2, SHORTENED)])
        else:
            places.extend([(char, 0.0)] for _ in range(j - i))
        i = j
    return places


def decode(token: str, costs: np.ndarray) -> list[str]:
    """The words of the cheapest path. States are the last two symbols; a path is a chain of pairs, so time is linear in the token."""
    states = {(0, 0): (0.0, None)}
    for place in [*lattice(token), [(" ", 0.0)]]:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (before, last), (cost, path) in states.items():
            for meant, extra in place:
                a, b, total, chain = before, last, cost + extra, path
                for char in meant:
                    s = _symbol(char)
                    if s or b:  # a boundary after a boundary is the same one
                        total += float(costs[a, b, s])
                        a, b, chain = b, s, (char, chain)
                old = after.get((a, b))
                if old is None or total < old[0]:
                    after[a, b] = (total, chain)
        states = after
    chain, chars = min(states.values(), key=lambda s: s[0])[1], []
    while chain:
        chars.append(chain[0])
        chain = chain[1]
    return "".join(reversed(chars)).split()


def words_of(token: str, costs: np.ndarray) -> list[str]:
    """The words of a lower-case token without white space, or of a row of single characters."""
    core = _SIGNS_AT_END.sub("", token.strip(EDGE)).strip(EDGE)
    if core.isalpha() and not _RUN.search(core):
        return [core]
    if not any(c.isalpha() for c in core):
        return []
    return decode(core, costs)


def features_of(word: str) -> list[str]:
    """The word, closed by ``$``, and its beginnings."""
    return [word + "$", *[word[:n] for n in BEGINNINGS if len(word) >= n]]


class Reader:
    """Texts to the set of their features, or to those that a model knows. Tokens met before are remembered, up to a bound."""

    def __init__(self, costs: np.ndarray, known: dict[str, int] | None = None) -> None:
        self.costs, self.known, self.memory = costs, known, {}

    def _found(self, token: str) -> tuple:
        found = [f for w in words_of(token, self.costs) for f in features_of(w)]
        return tuple(found) if self.known is None else tuple(self.known[f] for f in found if f in self.known)

    def read(self, text: str | None) -> tuple[set, int]:
        low = (text or "").lower()
        tokens, found = set(low.split()), set()
        for token in tokens:
            if len(token) > LONG_TOKEN:
                found.update(self._found(token))
                continue
            hit = self.memory.get(token)
            if hit is None:
                if len(self.memory) >= REMEMBERED:
                    self.memory.clear()
                hit = self.memory[token] = self._found(token)
            if hit:
                found.update(hit)
        for row in _SINGLES.finditer(low):
            if len(set(row.group().split())) > 1:
                found.update(self._found(row.group()))
        return found, len(tokens)


def _ratio(toxic: F.Column, clean: F.Column, n_toxic: int, n_clean: int) -> F.Column:
    """The log-likelihood ratio of a feature's counts against equal shares in both kinds."""
    share = (toxic + clean) / F.lit(float(n_toxic + n_clean))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    terms = [part(x, e) for x, e in ((toxic, share * n_toxic), (clean, share * n_clean), (n_toxic - toxic, n_toxic - share * n_toxic), (n_clean - clean, n_clean - share * n_clean))]
    return 2 * (terms[0] + terms[1] + terms[2] + terms[3])


def held_out(key: F.Column) -> F.Column:
    return F.coalesce(F.crc32(key.cast("string")) % FOLDS == 0, F.lit(False))


def fit_rows(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, __text) of at most FIT_ROWS labelled rows, none of them held out. The ids are bounded by FIT_ROWS and broadcast."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("__key")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("__key"), "__key").limit(FIT_ROWS)
    return texts.join(F.broadcast(known), "__key").groupBy("__key").agg(F.max("toxic").alias("toxic"), F.min("__text").alias("__text")).select("toxic", "__text")


class Model:
    """Features with their weights, the weight of the logarithm of the number of distinct tokens, and the bias."""

    def __init__(self, known: dict[str, int], weights: np.ndarray, length: float, bias: float) -> None:
        self.known, self.weights, self.length, self.bias = known, weights, length, bias

    def score(self, found: set, tokens: int) -> float:
        z = self.bias + self.length * np.log1p(tokens) / 5 + float(self.weights[sorted(found)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit(texts: DataFrame, labels: DataFrame, costs: np.ndarray) -> Model:
    rows = fit_rows(texts, labels)
    rows = rows.persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, seen = Reader(costs), (Counter(), Counter())
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("__text").to_pylist()):
                seen[int(toxic > 0)].update(reader.read(text)[0])
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.record_batch([pa.array(names, pa.string()), pa.array([seen[1][f] for f in names], pa.int64()), pa.array([seen[0][f] for f in names], pa.int64())],
                              names=["feature", "toxic", "clean"])

    kinds = rows.agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") <= 0).alias("clean")).first()
    n_toxic, n_clean = kinds["toxic"], kinds["clean"]
    if not n_toxic or not n_clean:
        rows.unpersist()
        share = n_toxic / max(n_toxic + n_clean, 1)
        return Model({}, np.zeros(0), 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    table = rows.mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    table = table.where((F.col("toxic") >= LEAST_ROWS) & (F.col("toxic") * n_clean > F.col("clean") * n_toxic))
    table = table.withColumn("ratio", _ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean)).where(F.col("ratio") > LEAST_RATIO)
    chosen = table.orderBy(F.col("ratio").desc(), "feature").limit(FEATURES).collect()
    known = {r["feature"]: i for i, r in enumerate(chosen)}

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(costs, known)
        for batch in batches:
            read = [reader.read(t) for t in batch.column("__text").to_pylist()]
            yield pa.record_batch([batch.column("toxic"), pa.array([sorted(f) for f, _ in read], pa.list_(pa.int32())), pa.array([n for _, n in read], pa.int64())],
                                  names=["toxic", "found", "tokens"])

    # at most FIT_ROWS rows of at most FEATURES numbers; in a fixed order, so that sums round alike
    data = rows.mapInArrow(narrow, "toxic int, found array<int>, tokens long").groupBy((F.col("toxic") > 0).alias("toxic"), "found", "tokens").count().collect()
    rows.unpersist()
    return Model(known, *logistic(sorted((tuple(r["found"]), r["tokens"], int(r["toxic"]), r["count"]) for r in data), len(known)))


def logistic(rows: list[tuple], size: int) -> tuple[np.ndarray, float, float]:
    """Weights, weight of the length and bias by penalised maximum likelihood; ``rows``: (features, tokens, label, how often)."""
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    column = np.array([f for r in rows for f in r[0]], dtype=np.int64)
    length, label, often = (np.array([f(r) for r in rows], dtype=float) for f in (lambda r: np.log1p(r[1]) / 5, lambda r: r[2], lambda r: r[3]))
    w, first, second = np.zeros(size + 2), np.zeros(size + 2), np.zeros(size + 2)
    for step in range(1, STEPS + 1):
        z = np.bincount(row, w[column], len(rows)) + w[-2] * length + w[-1]
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - label) * often / often.sum()
        slope = np.concatenate([np.bincount(column, error[row], size), [error @ length, error.sum()]])
        slope[:-1] += PENALTY * w[:-1]
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        w -= RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return w[:size], float(w[-2]), float(w[-1])


def score_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. ``documents``: doc_id, text; ``labels``: doc_id, toxic."""
    texts = documents.select(F.col("doc_id").alias("__key"), F.col("text").alias("__text"))
    costs = language_model(texts)
    model = fit(texts, labels.select("doc_id", "toxic"), costs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(costs, model.known)
        for batch in batches:
            scores = [model.score(*reader.read(t)) for t in batch.column("__text").to_pylist()]
            yield pa.record_batch([batch.column("__key"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    scored = texts.mapInArrow(score, f"doc_id {texts.schema['__key'].dataType.simpleString()}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
