"""Embedding whitening against exact fractions and numpy."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from taxloom.llm import whitening

VECTORS = "vec_id long, embedding array<float>, component string, __vector int"


def plain(rows, components):
    """(id, component) -> (n, deviation, whitened without sign, explained), from the definition."""
    size = max((len(v) for _, v in rows if v is not None), default=0)
    ok = [(k, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for k, v in rows
          if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    n = len(ok)
    total = [sum(x[i] for _, x in ok) for i in range(size)]
    v = np.array([[float(Fraction(sum((n * x[i] - total[i]) * (n * x[j] - total[j]) for _, x in ok), n**3)) for j in range(size)] for i in range(size)])
    values, vectors = np.linalg.eigh(v)
    out = []
    for key, x in ok:
        centred = np.array([float(Fraction(n * x[i] - total[i], n)) for i in range(size)])
        deviation = sum((n * x[i] - total[i]) ** 2 for i in range(size))
        for c in range(min(components, int((values > 1e-12 * values.max()).sum()))):
            e = values[-1 - c]
            out.append((key, c + 1, n, deviation, abs(centred @ vectors[:, -1 - c] / math.sqrt(e)), e / v.trace()))
    return out


def sample(rows, seed=2, size=7):
    rng = random.Random(seed)
    data = [(i, [rng.gauss(0, 0.2 + j) for j in range(size)]) for i in range(rows)]
    inf, nan = float("inf"), float("nan")
    return data + [(None, data[0][1]), (1, data[1][1]), (1, data[1][1]), (900, None), (901, []), (902, [1.0] * (size - 1)),
                   (903, [None, *data[2][1][1:]]), (904, [nan, *data[2][1][1:]]), (905, [-inf, *data[2][1][1:]]), (906, [-0.0, 1e3, *data[3][1][2:]])]


@pytest.mark.parametrize("rows", [4, 40, 300])
def test_whitening_is_that_of_the_definition(spark, rows):
    data = sample(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in data], VECTORS).repartition(3)
    got = sorted([(r["vec_id"], r["component"], r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]) for r in whitening.whiten(df, components=5).collect()], key=repr)
    expected = sorted(plain(data, 5), key=repr)
    order = lambda r: (repr(r[0]), r[1], r[3])
    for a, b in zip(sorted(got, key=order), sorted(expected, key=order), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-6, abs=1e-7) and a[5] == pytest.approx(b[5], rel=1e-9)


def test_whitened_covariance_is_the_identity(spark, sf):
    got = whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))
    rows = got.collect()
    n = rows[0]["n"]
    table = np.zeros((n, 32))
    for r in rows:
        table[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert len(rows) == 32 * n
    centred = table - table.mean(axis=0)
    error = np.abs(centred.T @ centred / n - np.eye(32)).max()
    assert error < 1e-9 and all(r["identity_error"] == pytest.approx(error, abs=1e-11) for r in rows[:50])


@pytest.mark.parametrize("rows,size,spread", [(1, 3, 5), (63, 4, 40), (64, 2, 1), (1000, 5, 1 << 40), (129, 3, 0)])
def test_cross_products_are_exact(rows, size, spread):
    rng = random.Random(rows)
    x = np.array([[rng.randint(-spread, spread) for _ in range(size)] for _ in range(rows)], dtype=np.int64)
    total, both = whitening.cross_products(x)
    exact = x.astype(object)
    assert list(total) == list(exact.sum(axis=0))
    full = exact.T @ exact
    assert all(both[i, j] == full[i, j] for i in range(size) for j in range(i, size))


def test_nothing_to_whiten(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [float("nan")]), (2, [None])]):
        got = whitening.whiten(spark.createDataFrame(rows, schema))
        assert got.count() == 0 and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    constant = [(i, [float(i), 3.0, 2.0 * i]) for i in range(10)]
    assert {r["component"] for r in whitening.whiten(spark.createDataFrame(constant, schema)).collect()} == {1}
