"""Op 5."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from sieve.llm import minhash
from sieve.llm.components import components
from tests.llm.edge import empty, rows, table


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(data, percent):
    """Smallest id that links reach, per row of (id, text)."""
    sets, parent = [shingles(t) for _, t in data], list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(data)), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            parent[find(a)] = find(b)
    least = {}
    for i, (name, _) in enumerate(data):
        if name is not None:
            least[find(i)] = min(name, least.get(find(i), name))
    return [(data[i][0], len(sets[i]), least.get(find(i))) for i in range(len(data))]


def variants(draw, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randint(0, edits)):
            words[draw.randrange(len(words))] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("block", [4, 256])
def test_against_brute_force(spark, monkeypatch, block):
    """Families of near copies, larger than a block; groups of equal texts; similarities around the threshold."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(block)
    texts = []
    for family in range(4):
        base = [f"w{draw.randrange(400)}" for _ in range(120)]
        texts += variants(draw, base, 25, 6)
    texts += [texts[3]] * 20 + ["a b c", "A b\tc", "a b c d e", "a b c d e f"]
    draw.shuffle(texts)
    data = list(enumerate(texts))
    got = minhash.clustered(spark.createDataFrame(data, "doc_id bigint, text string"), 85).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(data, 85))
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_edge_rows(spark):
    data = [(r[0], r[1]) for r in rows()]
    got = minhash.clustered(table(spark), 80).collect()
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=key) == sorted(brute(data, 80), key=key)
    stays = minhash.deduplicated(table(spark), 80)
    assert stays.columns == table(spark).columns
    assert stays.count() == sum(r["kept"] for r in got)
    assert minhash.clustered(empty(spark)).count() == 0 and minhash.deduplicated(empty(spark)).count() == 0


@pytest.mark.parametrize("limit", ["10m", "1"])
def test_one_row_of_each_component(spark, limit):
    """Ids that repeat with equal, near and different texts, copies under one id, and groups without an id."""
    base, other, third = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    near = base.replace("a59", "x")
    data = [(5, base, "s"), (5, base, "s"), (5, base, "r"), (5, near, "s"), (7, base, "s"), (5, other, "s"), (None, near, "s")]
    data += [(None, third, "s"), (None, third, "q"), (None, third.replace("c59", "x"), "s"), (8, " ", "s"), (9, None, "s"), (10, "alone", "s")]
    data += [(20, f"{other} y", "s")] * 30
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").repartition(5)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        stays = minhash.deduplicated(df, 80, single=True)
        got = [tuple(r) for r in stays.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert stays.columns == df.columns and set(got) <= set(data) and len(got) == 6
    assert sorted((i or 0, (t or " ")[0]) for i, t, _ in got) == [(0, "c"), (5, "a"), (5, "b"), (8, " "), (9, " "), (10, "a")]


def test_signature_is_circulant_and_estimates_jaccard():
    draw = np.random.default_rng(0)
    pool = draw.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = np.unique(pool[:2000]), np.unique(pool[500:2500])
    same = (minhash.signature(a, 1000) == minhash.signature(b, 1000)).mean()
    assert same == pytest.approx(1500 / 2500, abs=0.06)
    assert (minhash.signature(a, 200)[:100] == minhash.signature(a, 100)).all()


def test_components(spark):
    draw = random.Random(5)
    links = [(f"n{i}", f"n{i + 1}") for i in range(60)] + [(f"m{draw.randrange(40)}", f"m{draw.randrange(40)}") for _ in range(30)]
    links += [("hub", f"h{i}") for i in range(50)] + [("z", "z"), ("a", None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "u string, v string")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    assert got == {n: find(n) for n in parent}
