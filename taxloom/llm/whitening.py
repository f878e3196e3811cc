"""Embedding whitening from exact integer sums: bit-sliced scatter in tasks, centring in whole numbers, then one small eigenproblem.

Every entry ``c`` becomes the whole number ``floor(SCALE * c) + OFFSET``. A task takes blocks of rows, subtracts each dimension's least
value in the block and packs every bit plane of every dimension across the rows into 64-bit words. The cross-product of two dimensions is
then the sum over their planes ``p, q`` of ``2^(p+q)`` times the number of rows in which both planes are set: an AND and a population count
per word, exact whatever the number of rows. A task adds up its blocks and hands on one number per pair of dimensions; Spark adds those.
The driver sees sums over all rows only, at most ``(d + 1)(d + 2) / 2`` whole numbers for ``d`` dimensions. ``n * sum(xy) - sum(x) sum(y)`` is
formed in whole numbers, so nothing cancels, and only that centred matrix is rounded to doubles for ``eigh``. Components and means go back
to the tasks as ``d * (k + 1)`` numbers.

Left out: rows whose vector is null, holds a null, NaN or infinite entry, or lacks a dimension that the longest vector has. Repeated rows
and ids, null ids included, count as often as they occur. An empty table, or one without a usable row, gives no rows. Directions in which
the rows do not vary (a single row, constant or repeated dimensions) have no square root to divide by and give no component. Entries
beyond 2^55 end the job with an error, as their whole numbers would not fit. Only the id and the vector are read; other columns,
whatever their names, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Rows per block of bit planes: at most d * 8 bytes * BLOCK_ROWS of whole numbers in a task, whatever the size of its partition.
BLOCK_ROWS = 8192
#: Eigenvalues below this share of the largest are rounding noise.
NOISE = 1e-12


def usable(vector: Column, size: int) -> Column:
    """The vector has ``size`` entries, all of them finite numbers."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) == size) & ~bad, F.lit(False))


def _whole(vectors: pa.Array, size: int) -> np.ndarray:
    """A batch as whole numbers without the offset: one row per vector."""
    scaled = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * SCALE).reshape(-1, size)
    if scaled.size and np.abs(scaled).max() > 2.0**61:
        raise OverflowError("an entry is too large for whole numbers of 64 bits")
    return scaled.astype(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """Whole numbers in blocks of about BLOCK_ROWS rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(_whole(batch.column("__vector"), size))
        rows += len(held[-1])
        if rows >= BLOCK_ROWS:
            yield np.concatenate(held)
            held, rows = [], 0
    if rows:
        yield np.concatenate(held)


def bit_planes(shifted: np.ndarray) -> tuple[np.ndarray, int]:
    """The planes of non-negative whole numbers, packed across rows: entry ``[i * planes + p]`` holds bit ``p`` of dimension ``i``, 64 rows a word."""
    planes = max(int(shifted.max(initial=0)).bit_length(), 1)
    bits = (shifted.T[:, None, :] >> np.arange(planes)[None, :, None]) & 1
    packed = np.packbits(bits.astype(np.uint8).reshape(shifted.shape[1] * planes, -1), axis=1)
    padded = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, :packed.shape[1]] = packed
    return padded.view(np.uint64), planes


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of ``x_i`` and of ``x_i * x_j`` over the rows, as Python whole numbers."""
    least = x.min(axis=0)
    words, planes = bit_planes(x - least)
    size = x.shape[1]
    weight = np.array([1 << p for p in range(planes)], dtype=object)
    both = np.zeros((size, size), dtype=object)
    for i in range(size):
        # rows: planes of dimension i; columns: planes of the dimensions from i on
        rest = words[i * planes:]
        counts = np.stack([np.bitwise_count(words[i * planes + p] & rest).sum(axis=1, dtype=np.int64) for p in range(planes)])
        both[i, i:] = (counts.reshape(planes, size - i, planes).astype(object) * weight[:, None, None] * weight).sum(axis=(0, 2))
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64).reshape(size, planes).astype(object)
    moved, low = (ones * weight).sum(axis=1), least.astype(object)
    total = moved + len(x) * low
    both = both + np.outer(low, moved) + np.outer(moved, low) + len(x) * np.outer(low, low)
    return total, both


def scatter(vectors: DataFrame, size: int) -> DataFrame:
    """Sums over all rows: ``i, j, total`` for ``i <= j``; index -1 stands for the constant 1, so that (-1, -1) counts rows and (-1, j) sums a dimension.

    One number per pair and task leaves the tasks, however many rows a task reads.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, both = 0, np.zeros(size, dtype=object), np.zeros((size, size), dtype=object)
        for x in _blocks(batches, size):
            t, b = cross_products(x)
            rows, total, both = rows + len(x), total + t, both + b
        if rows:
            pairs = [(-1, -1, rows)] + [(-1, j, total[j]) for j in range(size)] + [(i, j, both[i, j]) for i in range(size) for j in range(i, size)]
            i, j, value = zip(*pairs)
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([str(v) for v in value])], names=["i", "j", "value"])

    parts = vectors.mapInArrow(sums, "i int, j int, value string")
    return parts.groupBy("i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("total"))


@dataclass
class Whitening:
    """What tasks need: row count, exact sums without the offset, components as columns, their eigenvalues and shares of the variance."""

    rows: int
    total: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def solve(rows: int, total: list[int], both: dict[tuple[int, int], int], components: int = COMPONENTS) -> Whitening:
    """The eigenvectors of the covariance. Centred in whole numbers: each entry is rounded once."""
    size = len(total)
    centred = np.zeros((size, size))
    for (i, j), value in both.items():
        centred[i, j] = centred[j, i] = float(Fraction(rows * value - total[i] * total[j], rows * rows))
    values, vectors = np.linalg.eigh(centred)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(centred))
    kept = min(components, int((values > NOISE * max(values.max(initial=0.0), 0.0)).sum()) if trace > 0 else 0)
    return Whitening(rows, total, np.ascontiguousarray(vectors[:, :kept]), values[:kept], values[:kept] / trace if trace > 0 else values[:kept])


def _centred(x: np.ndarray, fit: Whitening) -> np.ndarray:
    """``n * x - S``, exact; in 64 bits where that provably fits, else as Python whole numbers."""
    largest = fit.rows * int(np.abs(x).max(initial=0)) + max(map(abs, fit.total), default=0)
    if largest < 1 << 62:
        return fit.rows * x - np.array(fit.total, dtype=np.int64)
    return fit.rows * x.astype(object) - np.array(fit.total, dtype=object)


def _projected(centred: np.ndarray, fit: Whitening) -> np.ndarray:
    return (centred / fit.rows).astype(np.float64) @ fit.vectors / np.sqrt(fit.values)


def identity_error(vectors: DataFrame, fit: Whitening, size: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity; moments are summed in tasks and added by Spark."""
    kept = len(fit.values)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((kept + 1, kept + 1))
        for x in _blocks(batches, size):
            rows = np.column_stack([np.ones(len(x)), _projected(_centred(x, fit), fit)])
            sums += rows.T @ rows
        i, j = np.triu_indices(kept + 1)
        if sums[0, 0]:
            yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(sums[i, j])], names=["i", "j", "value"])

    parts = vectors.mapInArrow(moments, "i int, j int, value double")
    found = {(r["i"], r["j"]): r["total"] for r in parts.groupBy("i", "j").agg(F.sum("value").alias("total")).collect()}
    mean = [found[0, k + 1] / fit.rows for k in range(kept)]
    return max(abs(found[i + 1, j + 1] / fit.rows - mean[i] * mean[j] - (i == j)) for i in range(kept) for j in range(i, kept))


WHITENED = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable vector and component: ``key, component, n, deviation, whitened, explained, identity_error``."""
    source = embeddings.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{vector}`").alias("__vector"))
    schema = f"`{key}` {source.schema['__key'].dataType.simpleString()}, {WHITENED}"
    size = source.agg(F.max(F.size("__vector"))).first()[0] or 0
    vectors = source.where(usable(F.col("__vector"), size))
    sums = {(r["i"], r["j"]): int(r["total"]) for r in scatter(vectors.select("__vector"), size).collect()} if size > 0 else {}
    if not sums:
        return embeddings.sparkSession.createDataFrame([], schema)
    both = {pair: value for pair, value in sums.items() if pair[0] >= 0}
    fit = solve(sums[-1, -1], [sums[-1, j] for j in range(size)], both, components)
    kept = len(fit.values)
    if not kept:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors.select("__vector"), fit, size)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            centred = _centred(_whole(batch.column("__vector"), size), fit)
            deviation = (centred.astype(object) ** 2).sum(axis=1)
            each = np.repeat(np.arange(batch.num_rows), kept)
            yield pa.record_batch([
                batch.column("__key").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(len(each), fit.rows, dtype=np.int64)),
                pa.array([str(v) for v in deviation]).take(pa.array(each)),
                pa.array(_projected(centred, fit).reshape(-1)),
                pa.array(np.tile(fit.explained, batch.num_rows)),
                pa.array(np.full(len(each), error)),
            ], names=[key, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    made = vectors.mapInArrow(rows, schema.replace("deviation decimal(38,0)", "deviation string"))
    return made.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))
