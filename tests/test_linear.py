"""Logistic regressions with weights as rows, against a dense solver."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.operators import linear
from sieve.operators.spool import new_dir

SCHEMA = "topic_id string, pid string, text string, relevance int, w double, size double"
WORDS = "alpha beta gamma delta trial control blood test serum cohort über 12".split()


def corpus():
    draw = random.Random(11)
    out = []
    for topic, n in (("hot", 160), ("b", 40), (None, 30)):
        for i in range(n):
            y = int(draw.random() < 0.4)
            pool = WORDS + (["alpha", "trial"] * 2 if y else ["control", "blood"] * 2)
            text = " ".join(draw.choice(pool) for _ in range(draw.randint(0, 14)))
            out.append((topic, f"{topic}{i}", text or None, y, 2.5 if y else 1.0, draw.random()))
    out += [out[3], out[3], ("hot", "hot3", "beta beta", 1, 2.5, 0.1)]  # repeated rows and a repeated id
    return out + [("one", f"o{i}", "only one class", 0, 1.0, 0.0) for i in range(6)] + [("b", "gap", "no label", None, 1.0, 0.0)]


def dense(rows, weighted, numeric):
    """The minimum by Newton's method: {token: weight}."""
    rows = [r for r in rows if r[3] is not None]
    vectors = []
    for r in rows:
        n = Counter(re.findall(r"\w+|[^\w\s]", (r[2] or "").lower()))
        norm = math.sqrt(sum(math.log1p(k) ** 2 for k in n.values()))
        vectors.append({t: math.log1p(k) / norm for t, k in n.items()} | {"": 1.0} | ({"\tsize": r[5]} if numeric else {}))
    names = sorted({t for v in vectors for t in v})
    x = np.array([[v.get(t, 0.0) for t in names] for v in vectors])
    y, c = np.array([r[3] for r in rows], float), np.array([r[4] if weighted else 1.0 for r in rows])
    w = np.zeros(len(names))
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        gradient = x.T @ (c * (p - y)) / len(y) + linear.PENALTY * w
        hessian = (x.T * (c * p * (1 - p))) @ x / len(y) + linear.PENALTY * np.eye(len(names))
        w -= np.linalg.solve(hessian, gradient)
    z = x @ w
    loss = float((c * (np.log1p(np.exp(-abs(z))) + np.maximum(z, 0) - y * z)).mean())
    return dict(zip(names, w)), dict(zip(range(len(rows)), 1 / (1 + np.exp(-z)))), loss


@pytest.mark.parametrize("group, weighted, numeric", [("topic_id", False, False), ("topic_id", True, True), (None, True, False)])
def test_minimum_of_every_topic(spark, group, weighted, numeric):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    options = {"numeric": ["size"] if numeric else []}
    model = linear.fit(df, group=group, weight="w" if weighted else None, **options)
    got = {}
    for r in model.weights.df.collect():
        got.setdefault(r["g"], {})[r["token"]] = r["weight"]
    topics = {None if g == "~" else g[1:]: w for g, w in got.items()} if group else {"all": got["*"]}
    assert set(topics) == ({r[0] for r in rows} if group else {"all"})
    last = {r["g"]: r["loss"] for r in model.losses.filter(F.col("epoch") == model.epochs - 1).collect()}
    start = {r["g"]: r["loss"] for r in model.losses.filter("epoch = 0").collect()}
    for topic, weights in topics.items():
        want, _, loss = dense([r for r in rows if not group or r[0] == topic], weighted, numeric)
        assert weights.keys() == want.keys() and all(abs(weights[t] - want[t]) < 1e-4 for t in want)
        key = "*" if not group else "~" if topic is None else f"={topic}"
        assert abs(last[key] - loss) < 1e-4 and last[key] < start[key]


def test_scores_save_and_load(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    model = linear.fit(df)
    path = new_dir(spark, "linear")
    linear.save(model, path)
    out = linear.score(df, linear.load(spark, path), carry=["relevance"]).collect()
    assert len(out) == len(rows)
    for topic in ("hot", "b", None):
        mine = [r for r in rows if r[0] == topic]
        _, prob, _ = dense(mine, False, False)
        known = [r for r in mine if r[3] is not None]
        want = {}
        for i, r in enumerate(known):
            want.setdefault(r[1], set()).add(round(prob[i], 3))
        for r in out:
            if r["topic_id"] == topic and r["relevance"] is not None:
                assert any(abs(r["prob"] - p) < 1e-3 for p in want[r["pid"]])
    one = linear.load(spark, path, "b")
    assert {r[0] for r in one.weights.df.select("g").distinct().collect()} == {"=b"}
    probe = spark.createDataFrame([("b", "1", "alpha unknown", 1, 1.0, 0.0), ("hot", "2", "alpha", 1, 1.0, 0.0), ("b", "3", None, 1, 1.0, 0.0)], SCHEMA)
    got = {r["pid"]: r["prob"] for r in linear.score(probe, one).collect()}
    assert got["2"] is None and 0 < got["1"] < 1 and 0 < got["3"] < 1
    with pytest.raises(FileNotFoundError):
        linear.load(spark, path + "-none")


def test_the_same_model_by_shuffled_joins(spark):
    df = spark.createDataFrame(corpus(), SCHEMA)
    weights = lambda m: {(r["g"], r["token"]): r["weight"] for r in m.weights.df.collect()}
    want = weights(linear.fit(df, epochs=4, tolerance=0))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        got = weights(linear.fit(df, epochs=4, tolerance=0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_nothing_to_fit(spark):
    model = linear.fit(spark.createDataFrame([], SCHEMA))
    assert model.weights.df.count() == 0 and model.losses.count() == 0
    assert linear.score(spark.createDataFrame(corpus()[:3], SCHEMA), model).filter("prob is null").count() == 3
