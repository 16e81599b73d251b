"""Repeated rows, null keys, and models and stores that must not touch each other."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieve.operators import attribution as A
from sieve.operators import linear
from sieve.operators import sampling as S
from sieve.operators.ranking import batched
from sieve.operators.spool import children, lookup, new_dir, spool
from sieve.plans.explaining import explained
from sieve.plans.screening import judged, screen
from sieve.sources import tables
from sieve.streaming import verdicts

CITATION = "topic_id string, pid string, title string, abstract string, relevance int"


def repeated(spark):
    """Four relevant rows, six irrelevant ids three times each."""
    rows = [("t", f"r{i}", "a", "b", 1) for i in range(4)] + [("t", f"n{i % 6}", "a", "b", 0) for i in range(18)]
    return spark.createDataFrame(rows, CITATION)


def test_samples_of_repeated_ids_have_the_size_asked_for(spark):
    kept = S.undersample(repeated(spark)).groupBy("relevance").count().collect()
    assert {r["relevance"]: r["count"] for r in kept} == {0: 4, 1: 4}
    split = S.stratified_split(repeated(spark))
    assert split.count() == 22 and split.filter("is_test").count() == 6
    both = S.balanced_split(repeated(spark))
    assert both.count() == 8 and both.filter("is_test").count() == 2
    assert S.cut_topics(repeated(spark)).count() == 0
    flipped = repeated(spark).withColumn("relevance", 1 - F.col("relevance"))
    assert [tuple(r) for r in S.cut_topics(flipped).collect()] == [("t", 4, 18, 14)]
    with pytest.raises(ValueError):
        S.balanced_split(flipped, strict=True)


def test_negatives_of_repeated_articles(spark):
    positives = repeated(spark).filter("relevance = 1").limit(2)
    articles = spark.createDataFrame([(f"m{i % 3}", "x", "y") for i in range(9)] + [(None, "x", "y")], "pid string, title string, abstract string")
    out = S.sample_negatives(positives, articles).groupBy("relevance").count().collect()
    assert {r["relevance"]: r["count"] for r in out} == {0: 2, 1: 2}


@pytest.mark.parametrize("shuffle", [True, False])
def test_batches_keep_rows_with_null_keys(spark, shuffle):
    rows = spark.createDataFrame([("t", "1"), ("t", "1"), (None, "2"), ("t", None)], "topic_id string, pid string")
    got = [tuple(r) for r in batched(rows, 2, shuffle=shuffle).select("topic_id", "batch_id", "row_in_batch").collect()]
    assert sorted(got, key=str) == sorted([("t", 0, 0), ("t", 0, 1), ("t", 1, 0), (None, 0, 0)], key=str)


@pytest.fixture(scope="module")
def trained(spark):
    rows = [("t", str(i), "good word" if i % 2 else "bad word", "more words here", i % 2) for i in range(40)]
    rows += [("u", str(i), "left" if i % 2 else "right", "side", i % 2) for i in range(20)]
    return screen(spark.createDataFrame(rows, CITATION))


def test_repeated_rows_are_scored_and_explained_one_by_one(spark, trained):
    one = [("t", "7", "good word", "word", 1), ("u", "7", "left", None, 1), (None, "7", "good", "x", 0), ("t", None, "bad", "x", 0)]
    once = spark.createDataFrame(one, CITATION)
    twice = spark.createDataFrame(one * 2 + [("t", "7", "bad word", "other text", 0)], CITATION)
    single = {(r["topic_id"], r["pid"]): r["logit"] for r in judged(once, trained.model).collect()}
    got = judged(twice, trained.model).collect()
    assert len(got) == 9 and single[None, "7"] is None
    values = sorted((str(r["topic_id"]), str(r["pid"]), r["logit"]) for r in got if r["topic_id"])
    assert [v for v in values if v[2] == single["t", "7"]] == [("t", "7", single["t", "7"])] * 2
    records = explained(twice, trained.model).collect()
    assert len(records) == 9
    for r in records:
        if r["title"] == "good word":
            assert r["title_expl"]["tokens"] == ["good", "word"] and r["abstract_expl"]["tokens"] == ["word"]
    verdict_of = {(r["topic_id"], r["pid"], r["title"]): r["verdict"] for r in records}
    assert verdict_of[None, "7", "good"] == "Error"
    tokens = A.judged_tokens(once.select("topic_id", "pid", "title", "abstract"), trained.model)
    assert tokens.filter("pid = '7' and topic_id = 't'").count() == 3
    plan = tokens._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 8


def test_null_and_unknown_keys_are_spread(spark):
    """Most rows have no key or one that the table lacks."""
    rows = spark.range(4000).selectExpr("cast(id as string) as pid", "case when id % 10 < 6 then null else concat('k', id % 3) end as k")
    dim = spool(spark.createDataFrame([("k0", 1, 9), (None, 5, 1)], "k string, v int, w int"), "dim")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        plain = lookup(rows, dim, ["k"], "left", weight="w")
        safe = lookup(rows, dim, ["k"], "left", weight="w", null_safe=True)
        assert plain.count() == safe.count() == 4000
        assert plain.filter("k is null and v is not null").count() == 0 and safe.filter("k is null and v = 5").count() == 2400
        assert plain.filter("v = 1").count() == safe.filter("v = 1").count() == rows.filter("k = 'k0'").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_topics_of_the_linear_model_are_apart(spark):
    def rows(topic, flip):
        return [(topic, str(i), ["yes", "no"][(i + flip) % 2] + f" w{i % 5}", i % 2) for i in range(60)]

    schema = "topic_id string, pid string, text string, relevance int"
    probe = spark.createDataFrame([("a", "x", "yes w1", 1), ("a", "y", "no w2", 0)], schema)
    prob = []
    for other in (rows("b", 0), rows("b", 1) + rows("c", 1)):
        fitted = linear.fit(spark.createDataFrame(rows("a", 0) + other, schema))
        prob.append([r["prob"] for r in linear.score(probe, fitted).orderBy("pid").collect()])
    assert np.allclose(prob[0], prob[1], atol=1e-9) and abs(prob[0][0] - prob[0][1]) > 0.3


def test_result_runs_of_numeric_topics(spark):
    store = new_dir(spark, "numeric")
    for run in range(3):
        tables.append_results(spark.createDataFrame([("007", f"a{run}"), ("012", f"b{run}")], "topic_id string, pid string"), store)
    schema = spark.createDataFrame([], "pid string").schema
    got = tables.read_results(spark, store, schema, "007").orderBy("run_id").collect()
    assert [(r["topic_id"], r["run_id"], r["pid"]) for r in got] == [("007", 0, "a0"), ("007", 1, "a1"), ("007", 2, "a2")]
    assert {r["topic_id"] for r in tables.topic_catalogue(spark, store, schema).collect()} == {"007", "012"}


def test_compaction_changes_no_verdict(spark):
    table = new_dir(spark, "verdicts")
    for batch in range(4):
        rows = [("t", f"a{i}", f"v{batch}", batch, batch * 10 + i) for i in range(3 + batch)]
        df = spark.createDataFrame(rows, "topic_id string, article_id string, verdict string, ts int, event_id int")
        df.write.parquet(f"{table}/batch_id={batch}")
    before = sorted(map(tuple, verdicts.read_verdicts(spark, table).collect()))
    verdicts.compact_verdicts(spark, table)
    assert len(children(spark, table)) == 1
    assert sorted(map(tuple, verdicts.read_verdicts(spark, table).collect())) == before
    verdicts.compact_verdicts(spark, table)
    assert sorted(map(tuple, verdicts.read_verdicts(spark, table).collect())) == before
