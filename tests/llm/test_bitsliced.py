"""Op 7."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from sieve.llm import bitsliced

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(data, queries, k):
    quant = lambda v: [math.floor(256 * float(np.float32(x))) for x in v]
    fine = [(i, quant(v)) for i, v in data if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in sorted(((i, v) for i, v in fine if i is not None and queries(i)), key=lambda x: (x[0], x[1])):
        asked.setdefault(i, v)
    out = []
    for q, v in asked.items():
        found = [(sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q]
        found.sort(key=lambda x: (-x[0], math.inf if x[1] is None else x[1]))
        out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, pack, together", [(8192, 128, 16), (40, 3, 2)])
def test_against_brute_force(spark, monkeypatch, block, pack, together):
    monkeypatch.setattr(bitsliced, "BLOCK", block)
    monkeypatch.setattr(bitsliced, "PACK", pack)
    monkeypatch.setattr(bitsliced, "TOGETHER", together)
    draw = random.Random(block)
    data = [(i, [draw.uniform(-1, 1) for _ in range(8)]) for i in range(200)]
    data += [(1000 + i, [0.5] * 8) for i in range(60)] + [(2000 + i, [0.0] * 8) for i in range(20)]  # ties
    data += [(10, None), (3000, [1.0, float("nan")]), (3001, [float("inf")] * 8), (3002, [None, 1.0]), (3003, []), (3004, [0.9] * 3)]
    data += [(20, [0.1] * 8), (20, [0.1] * 8), (None, [0.9] * 8), (None, None), (3005, [40.0, -33.3] + [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 0) for i, v in data], SCHEMA)
    got = bitsliced.top_k(df, df.filter("vec_id % 10 = 0"), 5)
    assert sorted([tuple(r) for r in got.collect()], key=str) == brute(data, lambda i: i % 10 == 0, 5)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [0.1, -0.2], 1), (50, [0.3, 0.4], 1)], SCHEMA)
    got = bitsliced.top_k(df, df, 5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 50, 25 * 76 - 52 * 102), (50, 1, 0, 25 * 76 - 52 * 102)]
    assert bitsliced.top_k(df, df.filter("false")).count() == 0 and bitsliced.top_k(df.filter("false"), df.filter("false")).count() == 0


def test_bitmaps():
    draw = np.random.default_rng(0)
    rows = draw.random((3, 130)) < 0.4
    packed = bitsliced.pack_bits(rows)
    assert packed.shape == (3, 3) and all((bitsliced.unpack_bits(p, 130) == np.flatnonzero(r)).all() for p, r in zip(packed, rows))
