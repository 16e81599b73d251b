"""Ops 2 and 9."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sieve.llm import mixing, sharding
from sieve.llm.common import word_count
from tests.llm.edge import empty, rows, table


@pytest.mark.parametrize("n", [1, 2, 3, 7, 63, 64, 1000])
def test_network_permutes_and_inverts(spark, n):
    df = sharding.place_of(spark.range(n).withColumnRenamed("id", "row"), "row", n, 5)
    back = sharding.row_at(df, n, 5, "again").collect()
    assert all(r["row"] == r["again"] for r in back)
    assert sorted(r["slot"] * 5 + r["shard"] for r in back) == list(range(n))
    if n == 1000:
        assert [r["slot"] * 5 + r["shard"] for r in sorted(back, key=lambda r: r["row"])] != list(range(n))
        other = sharding.place_of(spark.range(n).withColumnRenamed("id", "row"), "row", n, 5, key="1").collect()
        assert {(r["row"], r["slot"]) for r in other} != {(r["row"], r["slot"]) for r in back}


def test_shards_of_edge_rows(spark):
    slim = table(spark).withColumn("h", F.xxhash64("text"))
    out = sharding.sharded(slim.select("doc_id", "h", "size"), ["doc_id", "h", "size"], 4)
    got = out.collect()
    counts = Counter(r["shard"] for r in got)
    assert sum(counts.values()) == len(rows()) and max(counts.values()) - min(counts.values()) <= 1
    for shard, n in counts.items():
        assert sorted(r["slot"] for r in got if r["shard"] == shard) == list(range(n))
    again = sharding.sharded(slim.repartition(3).select("size", "doc_id", "h"), ["doc_id", "h", "size"], 4)
    assert Counter((r["doc_id"], r["h"], r["shard"], r["slot"]) for r in got) == Counter(
        (r["doc_id"], r["h"], r["shard"], r["slot"]) for r in again.collect()
    )


def test_shards_of_nothing(spark):
    assert sharding.sharded(empty(spark).select("doc_id"), ["doc_id"], 4).count() == 0
    assert mixing.planned(empty(spark)).count() == 0


def test_word_count(spark):
    texts = [r[1] or "" for r in rows()] + [" a", "a ", "a b\x0b", "\x1ca\x85", "a\n", "a \x85"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def brute_targets(sizes: dict, weights=(5, 2, 1), cap=3):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, held = sum(sizes.values()), set()
    while True:
        free = sum(w for s, w in weight.items() if s not in held)
        left = total - sum(cap * sizes[s] for s in held)
        target = {s: cap * sizes[s] if s in held else left * weight[s] / free for s in order}
        over = {s for s in order if target[s] > cap * sizes[s]}
        if not over - held:
            return target
        held |= over


@pytest.mark.parametrize("data", [
    {"a": 10, "b": 1000, "c": 30, None: 5}, {"x": 7}, {"a": 0, "b": 10, "c": 1}, {"é": 50, "z": 50, "Z": 50, "~": 1, None: 3},
])
def test_targets(spark, data):
    docs = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(data.items())]
    plan = mixing.planned(spark.createDataFrame(docs, "doc_id int, text string, source string"))
    want = brute_targets(data)
    for r in plan.collect():
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == data[r["source"]]
        assert r["copies"] <= 3 and abs(r["copies"] - r["rate"]) < 1


def test_mix_is_near_targets_repeats_and_survives_skew(spark):
    docs = [(i, "w " * (1 + i % 7), "hot" if i % 3 else f"s{i % 60}") for i in range(6000)]
    df = spark.createDataFrame(docs, "doc_id int, text string, source string")
    plan = mixing.planned(df)
    got = {r["doc_id"]: r["copies"] for r in plan.collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        salted = mixing.planned(df.repartition(5))
        assert {r["doc_id"]: r["copies"] for r in salted.collect()} == got
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hot = plan.filter("source = 'hot'").agg(F.sum(F.col("copies") * F.col("size")), F.max("target")).first()
    assert hot[0] == pytest.approx(hot[1], rel=0.13)  # four standard deviations
    sent = mixing.emitted(plan, df.columns)
    assert sent.columns == df.columns and sent.count() == sum(got.values())
    u = int(hashlib.md5(f"mix:5:{hashlib.md5(docs[5][1].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
    rate = plan.filter("doc_id = 5").first()["rate"]
    assert got[5] == int(rate) + (u < rate - int(rate))


def test_mix_of_edge_rows(spark):
    plan = mixing.planned(table(spark))
    assert plan.count() == len(rows())
    assert plan.filter("text is null").agg(F.max("size")).first()[0] == 0
    assert plan.schema["size"].dataType.simpleString() == "bigint" and "_key" in plan.columns
    assert set(mixing.emitted(plan, table(spark).columns).columns) == set(table(spark).columns)


def test_mix_of_equal_rows_is_near_its_target(spark):
    """Half of a source is one row repeated, and other sources have repeated rows as well."""
    docs = [(1, "ten words " * 5, "a")] * 500 + [(i + 10, "w " * (10 + i % 3), "a") for i in range(480)]
    docs += [(i % 40, f"other {i % 40} " * 4, "b") for i in range(400)] + [(None, None, None)] * 5 + [(2, "", "b")] * 3
    df = spark.createDataFrame(docs, "doc_id int, text string, source string").repartition(7)
    plan = mixing.planned(df)
    assert plan.count() == len(docs) and plan.columns[:3] == df.columns
    sums = {r["source"]: r for r in plan.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("target").alias("target")).collect()}
    same = plan.filter("doc_id = 1 and source = 'a'").agg(F.sum("copies"), F.max("rate")).first()
    assert abs(same[0] - 500 * same[1]) <= 1
    for r in (sums["a"], sums["b"]):
        assert r["taken"] == pytest.approx(r["target"], rel=0.06)
    assert plan.agg(F.max("copies")).first()[0] <= 3
    again = mixing.planned(df.repartition(3))
    key = lambda p: Counter((r["doc_id"], r["text"], r["copies"]) for r in p.collect())
    assert key(again) == key(plan)
    half = spark.createDataFrame([(1, "ten words " * 5, "a")] * 500 + [(i + 10, "w", "b") for i in range(2000)], "doc_id int, text string, source string")
    taken, target = mixing.planned(half).filter("source = 'a'").agg(F.sum(F.col("copies") * F.col("size")), F.max("target")).first()
    assert taken == pytest.approx(target, rel=0.01)
