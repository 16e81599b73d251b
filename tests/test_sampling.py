from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sieve.operators import corpus as C
from sieve.operators import ranking as K
from sieve.operators import sampling as S


def md5(x):
    return hashlib.md5(x.encode()).hexdigest()


def order(pid, seed=42):
    return md5(f"{seed}:{pid}"), pid


@pytest.fixture(scope="module")
def rows(spark):
    """One topic with two thirds of all rows, a small one, one without negatives, and odd grades."""
    rnd = random.Random(3)
    data = [("hot", str(i), int(rnd.random() < 0.3)) for i in range(6000)]
    data += [("small", f"s{i}", int(i < 7)) for i in range(20)]
    data += [("reverse", f"r{i}", int(i >= 300)) for i in range(2500)]
    data += [("onesided", f"o{i}", 1) for i in range(9)]
    data += [("hot", f"g{i}", 2) for i in range(50)]
    return data


SCHEMA = "topic_id string, pid string, relevance int"


def expected_balance(rows, seed=42):
    groups = defaultdict(list)
    for t, p, y in rows:
        if y in (0, 1):
            groups[t, y].append(p)
    out = set()
    for t in {t for t, _ in groups}:
        n = min(len(groups[t, 0]), len(groups[t, 1]))
        for y in (0, 1):
            out |= {(t, p, y) for p in sorted(groups[t, y], key=lambda p: order(p, seed))[:n]}
    return out


def expected_test(balanced, percent=25, seed=42):
    groups = defaultdict(list)
    for t, p, y in balanced:
        groups[t, y].append(p)
    out = set()
    for t in {t for t, _ in groups}:
        sizes = {y: len(ps) for (u, y), ps in groups.items() if u == t}
        n = sum(sizes.values())
        n_test = math.ceil(n * percent / 100)
        quota = {y: n_test * c // n for y, c in sizes.items()}
        for y in sorted(sizes, key=lambda y: (-(n_test * sizes[y] % n), y))[: n_test - sum(quota.values())]:
            quota[y] += 1
        for y, q in quota.items():
            out |= {(t, p, y) for p in sorted(groups[t, y], key=lambda p: order(p, seed))[:q]}
    return out


def test_undersample_by_brute_force(spark, rows):
    got = {tuple(r) for r in S.undersample(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected_balance(rows)
    counts = Counter((t, y) for t, _, y in got)
    assert all(counts[t, 0] == counts[t, 1] for t in ("hot", "small", "reverse"))
    assert not any(t == "onesided" for t, _ in counts)


def test_strict_undersample_refuses_a_short_majority(spark, rows):
    with pytest.raises(ValueError):
        S.undersample(spark.createDataFrame(rows, SCHEMA), strict=True)
    fine = [r for r in rows if r[0] in ("hot", "small")]
    S.undersample(spark.createDataFrame(fine, SCHEMA), strict=True)


def test_split_by_brute_force(spark, rows):
    kept = [r for r in rows if r[2] in (0, 1)]
    split = S.stratified_split(spark.createDataFrame(kept, SCHEMA))
    got = {tuple(r)[:3] for r in split.collect() if r["is_test"]}
    assert got == expected_test(kept)
    assert split.count() == len(kept)


@pytest.mark.parametrize("partitions", [1, 13])
def test_balanced_split_is_the_two_steps(spark, rows, partitions):
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    got = S.balanced_split(df).collect()
    balanced = expected_balance(rows)
    assert {tuple(r)[:3] for r in got} == {(t, p, y) for t, p, y in balanced} and len(got) == len(balanced)
    assert {tuple(r)[:3] for r in got if r["is_test"]} == expected_test(balanced)


def test_other_seed_other_sample(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    one, two = ({r["pid"] for r in S.undersample(df, seed).collect()} for seed in (1, 2))
    assert one != two and len(one) == len(two)


def test_salted_join_equals_broadcast(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    want = {tuple(r) for r in S.undersample(df).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        got = [tuple(r) for r in S.undersample(df).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(got) == want and len(got) == len(want)


def test_ranked_over_table_and_groups(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    whole = {r["pid"]: r["rank"] for r in K.ranked(df, [K.seeded_order()]).collect()}
    want = sorted((p for _, p, _ in rows), key=order)
    assert whole == {p: i for i, p in enumerate(want, 1)}
    assert {r["pid"]: r["rank"] for r in K.shuffled(df).collect()} == whole
    groups = defaultdict(list)
    for t, p, _ in rows:
        groups[t].append(p)
    got = {(r["topic_id"], r["pid"]): r["rank"] for r in K.shuffled(df, ["topic_id"]).collect()}
    assert got == {(t, p): i for t, ps in groups.items() for i, p in enumerate(sorted(ps, key=order), 1)}
    got = {(r["topic_id"], r["pid"]): r["rank"] for r in K.ranked(df, ["pid"], ["topic_id"]).collect()}
    assert got == {(t, p): i for t, ps in groups.items() for i, p in enumerate(sorted(ps), 1)}


def test_batches(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = K.batched(df, 16).groupBy("topic_id", "batch_id").count().collect()
    sizes = defaultdict(list)
    for r in sorted(got, key=lambda r: r["batch_id"]):
        sizes[r["topic_id"]].append(r["count"])
    assert all(set(s[:-1]) <= {16} and 1 <= s[-1] <= 16 for s in sizes.values())
    assert sum(sizes["hot"]) == 6050


def test_chunks_with_start(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(1, 1001)] + [("x",), ("7",)], "pid string")
    got = defaultdict(list)
    for r in K.chunked(ids, 300, start=5).collect():
        got[r["chunk_id"]].append(r["pid"])
    assert {k: len(v) for k, v in got.items()} == {0: 300, 1: 300, 2: 300, 3: 96}
    assert all(len(set(v)) == len(v) for v in got.values())


@pytest.fixture(scope="module")
def corpus(spark):
    positives = [("t1", f"p{i}", f"title {i}", f"abstract {i}", 1) for i in range(40)]
    positives += [("t2", f"p{i}", f"title {i}", f"abstract {i}", 1) for i in range(30, 45)]
    articles = [(f"p{i}", f"title {i}", f"abstract {i}") for i in range(45)]
    articles += [(f"m{i}", f"misfit {i}", f"other {i}") for i in range(200)]
    articles += [("empty", "no abstract", None)]
    return (
        spark.createDataFrame(positives, "topic_id string, pid string, title string, abstract string, relevance int"),
        spark.createDataFrame(articles, "pid string, title string, abstract string"),
    )


def test_negatives(corpus):
    positives, articles = corpus
    out = S.sample_negatives(positives, articles).collect()
    pos = Counter(r["topic_id"] for r in out if r["relevance"] == 1)
    neg = Counter(r["topic_id"] for r in out if r["relevance"] == 0)
    assert pos == neg == Counter({"t1": 40, "t2": 15})
    ids = [r["pid"] for r in out if r["relevance"] == 0]
    assert len(set(ids)) == 55 and all(i.startswith("m") for i in ids)
    assert all(r["title"] == f"misfit {r['pid'][1:]}" for r in out if r["relevance"] == 0)


def test_negatives_need_enough_misfits(corpus):
    positives, articles = corpus
    with pytest.raises(ValueError):
        S.sample_negatives(positives, articles.filter("pid like 'p%' or pid like 'm1%'").limit(60))


def test_joins_keep_what_they_must(spark):
    topics = spark.createDataFrame([("a", "A"), ("b", "B"), (None, "N")], "topic_id string, topic_title string")
    judged = spark.createDataFrame(
        [("a", "1", 1), ("a", "2", 0), ("c", "3", 1), (None, "4", 1)], "topic_id string, pid string, relevance int"
    )
    got = {tuple(r) for r in C.topic_judgments(topics, judged).collect()}
    assert got == {("a", "A", "1", 1), ("a", "A", "2", 0), ("b", "B", None, None), (None, "N", None, None)}

    articles = spark.createDataFrame(
        [("1", "t", "x"), ("1", "t2", "y"), ("2", None, "x"), ("9", "t", "z"), (None, "n", "n")],
        "pid string, title string, abstract string",
    )
    assert C.judged_articles(judged, articles).count() == 2
    assert C.graded_corpus(judged, articles).count() == 3
    assert {r["pid"] for r in C.misfits(articles, judged).collect()} == {"9", None}
    assert {tuple(r) for r in C.one_per_pid(articles).collect()} >= {("1", "t2", "y"), ("2", None, "x")}


def test_relational_rules(spark):
    from sieve.operators import profile as P

    df = spark.createDataFrame(
        [("a", 1, 5), ("a", None, 1), ("b", None, 2), (None, 1, 3), ("a", 1, 0), ("c", 2, 1)],
        "topic_id string, relevance int, other int",
    )
    assert {tuple(r) for r in P.positives_per_topic(df).collect()} == {("a", 2), ("b", 0), ("c", 2)}
    assert {tuple(r) for r in P.positives_per_topic(df, numeric_only=True).collect()} == {
        ("a", 2, 6), ("b", 0, 2), ("c", 2, 1),
    }
    assert [r["topic_id"] for r in P.top_topics(df, 2).collect()] == ["a", "c"]
    assert [tuple(r) for r in P.top_topics(df, 0, 1, 3).select("rank", "topic_id").collect()] == [(2, "c"), (3, "b")]
    assert {tuple(r) for r in P.balance_profile(df).collect()} == {
        ("a", 2, 0, 2, 2), ("b", 0, 0, 0, 0), ("c", 0, 0, 1, 0),
    }
    assert C.complete_rows(df).count() == 3
    assert C.union_all(df, df.drop("other")).filter("other is null").count() == 6
    sliced = K.row_slice(spark.range(100), [F.col("id")], 10, 25)
    assert [r[0] for r in sliced.collect()] == list(range(10, 25))


@pytest.fixture
def sorted_sizes(spark, monkeypatch):
    """Rows per task of every range sort that ranks, with tasks as they were dealt."""
    sizes, spool = [], K.spool

    def watched(df, name="table"):
        made = spool(df, name)
        if name == "sorted":
            sizes.append(sorted(r["count"] for r in made.df.groupBy(F.shiftright("_place", 33)).count().collect()))
        return made

    monkeypatch.setattr(K, "spool", watched)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield sizes
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def even(sizes):
    middle = sizes[len(sizes) // 2]
    return len(sizes) >= 8 and sizes[-1] <= 3 * middle


HOT = 120_000


@pytest.fixture(scope="module")
def hot(spark):
    """One topic of all rows but a few; 60 % have no id, and those are equal but for a grade and a number of five values."""
    df = spark.range(HOT).selectExpr(
        "case when id % 1000 = 0 then 'small' else 'big' end as topic_id",
        "case when id % 10 < 6 then null else cast(id as string) end as pid",
        "cast(id % 3 = 0 as int) as relevance", "id % 5 as number",
    )
    return df.repartition(16, "number", "pid")


def test_ranks_of_rows_without_id_are_dealt_over_tasks(spark, hot, sorted_sizes):
    for got in (K.ranked(hot, ["pid"], ["topic_id"]), K.shuffled(hot, ["topic_id"]), K.batched(hot, 16).withColumn("rank", F.col("batch_id") * 16 + F.col("row_in_batch") + 1)):
        sums = {r["topic_id"]: tuple(r)[1:] for r in got.groupBy("topic_id").agg(
            F.count("*"), F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.max(F.when(F.col("pid").isNull(), F.col("rank"))),
            F.min(F.when(F.col("pid").isNull(), F.col("rank"))), F.count_if(F.col("pid").isNull())).collect()}
        for n, distinct, low, high, last, first, nulls in sums.values():
            assert n == distinct == high and low == 1 and last - first + 1 == nulls  # null ids are neighbours
        assert sum(v[0] for v in sums.values()) == HOT
        assert even(sorted_sizes.pop())


def test_deep_slices_of_every_topic(spark, hot, sorted_sizes):
    small = K.row_slice(hot, ["pid"], 10, 25, ["topic_id"])
    assert {r["topic_id"]: r["count"] for r in small.groupBy("topic_id").count().collect()} == {"big": 15, "small": 15} and not sorted_sizes
    deep = K.row_slice(hot, ["pid", "number"], HOT // 4, HOT * 7 // 8, ["topic_id"])
    ids = [p for t, p in ((r["topic_id"], r["pid"]) for r in hot.select("topic_id", "pid").collect()) if t == "big"]
    want = sorted(ids, key=lambda p: (p is not None, p or ""))[HOT // 4 : HOT * 7 // 8]
    got = [r["pid"] for r in deep.select("pid").collect()]
    assert Counter(got) == Counter(want) and even(sorted_sizes.pop())
    assert K.row_slice(hot.drop("topic_id"), ["number"], HOT - 20_000, 2 * HOT).count() == 20_000 and even(sorted_sizes.pop())


def test_quotas_that_end_inside_rows_without_id(spark, hot, sorted_sizes):
    """The class sizes of each topic decide, wherever the many rows without id come in the seeded order."""
    sizes = {(r["topic_id"], r["relevance"]): r["count"] for r in hot.groupBy("topic_id", "relevance").count().collect()}
    for seed in (1, 2, 3):
        split = S.stratified_split(S.undersample(hot, seed=seed), seed=seed)
        got = {(r["topic_id"], r["relevance"]): (r["n"], r["t"]) for r in split.groupBy("topic_id", "relevance").agg(
            F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
        for topic in ("big", "small"):
            n = min(sizes[topic, 0], sizes[topic, 1])
            assert got[topic, 0][0] == got[topic, 1][0] == n and got[topic, 0][1] + got[topic, 1][1] == math.ceil(2 * n / 4)
    assert sorted_sizes and all(even(s) for s in sorted_sizes)
    again = S.undersample(hot.repartition(5), seed=2).groupBy("topic_id", "pid", "relevance", "number").count()
    once = S.undersample(hot, seed=2).groupBy("topic_id", "pid", "relevance", "number").count()
    assert once.exceptAll(again).isEmpty() and again.exceptAll(once).isEmpty()  # the same rows however they lie
