"""Op 4."""

from __future__ import annotations

import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sieve.llm import spotsigs
from tests.llm.edge import empty, rows, table


def signatures(text):
    words = [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]
    content, out, seen = [w for w in words if w not in spotsigs.ANCHORS], set(), 0
    if content:
        out.add(("^", *content[:3]))
    for w in words:
        if w in spotsigs.ANCHORS:
            out.add((w, *content[seen : seen + 3]))
        else:
            seen += 1
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_beside_next(spark):
    draw = random.Random(2)
    words = ["the", "of", "and", "la", "cat", "dog", "bird", "fish", "tree", "é", "sea"]
    data = [(i * 3, " ".join(draw.choices(words, k=draw.randint(0, 40)))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in spotsigs.beside_next(df.repartition(4)).select(
        "*", spotsigs.likeness(F.col("signatures"), F.col("edited_signatures")).alias("near_edited"),
        spotsigs.likeness(F.col("signatures"), F.col("next_signatures")).alias("near_next"),
    ).collect()}
    order = sorted(data, reverse=True)
    for i, (name, text) in enumerate(order):
        after_id, after = order[(i + 1) % len(order)]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = got[name]
        assert (r["next_doc_id"], r["edited"], r["n_chars"]) == (after_id, edited, len(text))
        assert r["near_edited"] == pytest.approx(jaccard(signatures(text), signatures(edited)))
        assert r["near_next"] == pytest.approx(jaccard(signatures(text), signatures(after)))


def whole_signatures(text):
    words = [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]
    content, out, seen, reached = [w for w in words if w not in spotsigs.ANCHORS], signatures(text), 0, 3
    for w in words:
        if w in spotsigs.ANCHORS:
            reached = seen + 3
        else:
            if seen >= reached:
                out.add(("~", *content[seen : seen + 3]))
            seen += 1
    return out


def test_signatures_cover_texts_with_few_anchors(spark):
    draw = random.Random(8)
    plain = [" ".join(f"w{draw.randrange(50)}" for _ in range(n)) for n in (1, 3, 4, 5, 30, 200)]
    few = [" ".join("the" if draw.random() < 0.08 else f"w{draw.randrange(50)}" for _ in range(80)) for _ in range(20)]
    texts = [*plain, *few, "Москва река дом лес поле", "the of and", ""]
    pairs = [(t, f"{t[: -len(t) // 3]} other end") for t in texts] + [(t + " last", t + " end") for t in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    for side in "ab":
        df = spotsigs.with_signatures(df, side, f"s{side}", whole=True)
    got = df.select("a", "b", spotsigs.likeness(F.col("sa"), F.col("sb")).alias("near")).collect()
    assert len(got) == len(pairs)
    for r in got:
        assert r["near"] == pytest.approx(jaccard(whole_signatures(r["a"]), whole_signatures(r["b"]))) and r["near"] < 1


def test_query_tells_lists_with_another_end_apart(spark, tmp_path):
    from sieve.llm.queries import QUERIES

    items = " ".join(f"item{i}" for i in range(60))
    rows = [(1, f"{items} aaa bbb ccc"), (2, f"{items} ddd eee fff")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op4_spot_signatures"](spark, str(tmp_path)).collect()
    assert len(got) == 2 and all(0.5 < r["near_next"] < 1 and r["near_edited"] < 0.7 for r in got)
    assert got[0]["fingerprint"] != got[1]["fingerprint"]


def test_edge_rows(spark):
    got = spotsigs.beside_next(table(spark)).collect()
    assert len(got) == len(rows())
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    twins = [r for r in got if r["doc_id"] == 0]
    assert len(twins) == 3 and len({(r["edited"], r["next_doc_id"]) for r in twins}) == 1
    assert spotsigs.beside_next(empty(spark)).count() == 0
    many = spark.createDataFrame([(5, "the same cat again and again")] * 400 + [(i, f"the cat number {i}") for i in range(6)], "doc_id int, text string")
    again = spotsigs.beside_next(many.repartition(9)).collect()
    assert len(again) == 406 and len({(r["doc_id"], r["edited"]) for r in again}) == 7
    alone = spotsigs.beside_next(spark.createDataFrame([(1, "abcdef the cat")], "doc_id int, text string")).first()
    assert alone["next_doc_id"] == 1 and alone["edited"] == "abcdef theabcd"
    df = spotsigs.with_signatures(spark.createDataFrame([("The cat",), ("the  CAT!",), ("",)], "text string"), "text", "s")
    prints = [r[0] for r in df.select(spotsigs.fingerprint(F.col("s"))).collect()]
    assert prints[0] == prints[1] and len(prints[0]) == 16 and prints[2] == ""


def test_near_pairs_against_brute_force(spark):
    draw = random.Random(4)
    sets = []
    for family in range(12):
        base = [draw.randrange(-(2**31), 2**31) for _ in range(draw.randint(3, 60))]
        for _ in range(6):
            sets.append(sorted({x if draw.random() > 0.06 else draw.randrange(2**31) for x in base}))
    sets += [sets[0], [], []]
    data = list(enumerate(sets))
    got = spotsigs.near_pairs(spark.createDataFrame(data, "key int, signatures array<int>"), 80).collect()
    first = {}
    for k, s in data:
        first.setdefault(tuple(s), k)
    want = {(a, b) for (s, a), (t, b) in combinations(first.items(), 2) if s and t and 100 * len({*s} & {*t}) >= 80 * len({*s} | {*t})}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_plan_stays_in_the_jvm(spark):
    df = spotsigs.beside_next(spark.range(10).selectExpr("id as doc_id", "concat('the cat ', id) as text"))
    assert len(df.collect()) == 10
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "ReusedExchange" in plan
