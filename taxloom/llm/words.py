"""Word shingles as 64-bit values, computed for many texts at once with numpy inside Spark tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE_WORDS = 5
#: Texts are hashed in slices of about this many bytes, so that a task's memory follows the longest text, not the batch.
SLICE_BYTES = 1 << 18

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_BYTE = _BYTE[_LOWER]


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (shifts and odd multipliers)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(30)
    v *= np.uint64(0xBF58476D1CE4E5B9)
    v ^= v >> np.uint64(27)
    v *= np.uint64(0x94D049BB133111EB)
    v ^= v >> np.uint64(31)
    return v


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if len(texts) > start:
        yield start, len(texts)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def word_values(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The value of each word of the texts in order, and the number of words of each text. A-Z count as a-z.

    One wrapping prefix sum over all bytes; a word is a difference of two sums, shifted back to its start.
    """
    joined = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    space = _SPACE[joined]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1), append=np.int8(1)))
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(len(joined) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[joined] * _powers(_BASE, len(joined)), out=sums[1:])
    values = mixed((sums[end] - sums[begin]) * _powers(_INVERSE, len(joined) + 1)[begin] + (end - begin).astype(np.uint64))
    stops = np.cumsum([len(t) + 1 for t in texts])
    last = np.searchsorted(begin, stops)
    return values, np.diff(last, prepend=0)


def shingle_sets(texts: list[bytes], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``size``-word shingles of each text, ascending, and their number per text.

    A text of fewer words, but not none, gives its whole sequence as one shingle; a text without words gives none.
    """
    words, counts = word_values(texts)
    owner = np.repeat(np.arange(len(texts)), counts)
    start = np.cumsum(counts) - counts
    place = np.arange(len(words)) - start[owner] if len(words) else owner
    left = counts[owner] - place
    first = (left >= size) | (place == 0)
    at, who = np.flatnonzero(first), owner[first]
    value = np.zeros(len(at), dtype=np.uint64)
    for k in range(size):
        inside = left[at] > k
        # past the end of a short text: a value of its own for "no word"
        word = np.where(inside, words[np.minimum(at + k, max(len(words) - 1, 0))] if len(words) else 0, _STEP)
        value = value * _STEP + word
    value = mixed(value)
    order = np.lexsort((value, who))
    value, who = value[order], who[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (who[1:] != who[:-1])
    return value[keep], np.bincount(who[keep], minlength=len(texts))
