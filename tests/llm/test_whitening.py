"""Op 11."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from sieve.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, whitened string, _x int, n int"


def whole(v):
    return tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v)


def exact(data):
    """Whole vectors, distinct ones, their sums and their covariance as fractions."""
    rows = [(i, whole(v)) for i, v in data]
    fit = sorted(set(x for _, x in rows))
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    mean = [Fraction(s, n) for s in sums]
    cov = [[sum((x[i] - mean[i]) * (x[j] - mean[j]) for x in fit) / n for j in range(dims)] for i in range(dims)]
    return rows, n, sums, cov


@pytest.mark.parametrize("spread", [1.0, 3000.0, 1e9])
def test_against_fractions(spark, spread):
    draw = random.Random(int(spread))
    data = [(i, [draw.gauss(0, spread / (d + 1)) for d in range(6)]) for i in range(300)]
    data += [(7, data[7][1]), (None, data[8][1])] + [(1000 + i, data[0][1]) for i in range(150)]
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2003, [math.nan] * 6), (2004, [math.inf] + [0.0] * 5), (2005, [1.0] * 3)]
    df = spark.createDataFrame([(i, v, 1, "w", 2, 3) for i, v in data + odd], SCHEMA).repartition(5)
    got = whitening.components(df, k=4).collect()
    rows, n, sums, cov = exact(data)
    dense = np.array([[float(c) for c in r] for r in cov])
    values, vectors = np.linalg.eigh(dense)
    values, vectors = values[::-1][:4], vectors[:, ::-1][:, :4]
    assert len(got) == 4 * len(data) and {r["n"] for r in got} == {n}
    deviation = {}
    for i, x in rows:
        deviation.setdefault(i, set()).add(sum((n * a - s) ** 2 for a, s in zip(x, sums)))
    assert all((r["deviation"] if r["deviation"] is not None else None) in {d if d < 2**63 else None for d in deviation[r["vec_id"]]} for r in got)
    for r in got:
        assert abs(r["explained"] / (values[r["component"] - 1] / np.trace(dense)) - 1) < 1e-9 and r["identity_error"] < 1e-9
    want = {i: (np.array([float(Fraction(a) - Fraction(s, n)) for a, s in zip(x, sums)]) @ vectors) / np.sqrt(values) for i, x in rows}
    sign = {}
    for r in got:
        if r["vec_id"] is not None:
            w = want[r["vec_id"]][r["component"] - 1]
            sign.setdefault(r["component"], set()).add(r["whitened"] * w > 0) if abs(w) > 1e-3 else None
            assert abs(abs(r["whitened"]) - abs(w)) < 1e-6
    assert all(len(s) == 1 for s in sign.values())


def test_planes_give_products():
    x = np.random.default_rng(1).integers(0, 2**9, (130, 5))
    counts = whitening.plane_counts(whitening.packed_planes(x, 9)).reshape(5, 9, 5, 9)
    assert all(
        sum(int(counts[i, p, j, q]) << (p + q) for p in range(9) for q in range(9)) == int((x[:, i] * x[:, j]).sum()) for i in range(5) for j in range(i + 1, 5)
    )


def test_one_vector_constant_dimension_and_nothing(spark):
    one = whitening.components(spark.createDataFrame([(1, [0.5, -0.5], 1, "", 2, 3)] * 3, SCHEMA)).collect()
    assert len(one) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)}
    flat = [(i, [float(i), 2.0, -1.0 * (i % 3)], 1, "", 2, 3) for i in range(30)]
    rows = whitening.components(spark.createDataFrame(flat, SCHEMA)).collect()
    assert len(rows) == 90 and all((r["whitened"] is None) == (r["component"] == 3) for r in rows) and rows[0]["identity_error"] < 1e-9
    for df in (spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, None, 1, "", 2, 3)], SCHEMA)):
        assert whitening.components(df).collect() == []


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(i, [float(i), float(i * i)], i, "gone", 2, 3) for i in range(10)], SCHEMA)
    found, model = whitening.whiten(df)
    rows = found.collect()
    assert model.n == 10 and {(r["vec_id"], r["label"], r["_x"], r["n"]) for r in rows} == {(i, i, 2, 3) for i in range(10)}
    assert all(len(r["whitened"]) == 2 for r in rows)
