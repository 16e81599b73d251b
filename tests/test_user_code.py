"""Code that users bring (aggregates over rows, table functions), and summaries that merge."""

from __future__ import annotations

import random
import statistics
from collections import Counter, defaultdict

import pytest

from sieve.functions.table_functions import register
from sieve.operators import encoding as E
from sieve.operators import sketches
from sieve.operators import user_aggregate as U
from sieve.operators.spool import new_dir
from sieve.queries.learning import Distinct, Median

SCHEMA = "topic string, grade int, n int, word string"


def rows():
    draw = random.Random(9)
    out = [("hot" if i % 4 else draw.choice(["a", "b", None]), draw.choice([1, 2, None]), draw.randrange(50), f"w{draw.randrange(99)}") for i in range(4000)]
    return out + [("nothing", 1, None, None)] * 3


@pytest.mark.parametrize("held, fan_in", [(50_000, 128), (2, 3)])
def test_aggregates_of_any_rows(spark, monkeypatch, held, fan_in):
    monkeypatch.setattr(U, "HELD", held)
    monkeypatch.setattr(U, "FAN_IN", fan_in)
    df = spark.createDataFrame(rows(), SCHEMA).repartition(13)
    groups = defaultdict(list)
    for t, g, n, w in rows():
        groups[t, g].append((n, w))
    got = {(r["topic"], r["grade"]): r["value"] for r in U.aggregate_rows(df, ["topic", "grade"], ["n"], Median(), "double").collect()}
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        known = [n for n, _ in values if n is not None]
        assert got[key] == (statistics.median(known) if known else None)
    got = {r["topic"]: r["words"] for r in U.aggregate_rows(df, ["topic"], ["word"], Distinct(), "bigint", "words").collect()}
    assert got == {t: len({w for u, _, _, w in rows() if u == t and w is not None}) for t in {r[0] for r in rows()}}
    assert U.aggregate_rows(df.limit(0), ["topic"], ["n"], Median(), "double").count() == 0


def test_a_hot_group_is_shared_by_tasks(spark):
    """The user's function sees a task's rows at a time, never a whole group."""

    class Largest:
        def init(self):
            return 0

        def update(self, state, part):
            return max(state, len(part))

        def merge(self, a, b):
            return max(a, b)

        def finish(self, state):
            return state

    df = spark.range(40_000).selectExpr("'hot' as topic", "id").repartition(16)
    assert U.aggregate_rows(df, ["topic"], ["id"], Largest(), "bigint").first()["value"] <= 2 * 40_000 // 16


def test_lateral_table_function(spark):
    register(spark)
    df = spark.createDataFrame([(1, "a,b,,c"), (2, None), (3, ""), (4, "x")], "id int, text string")
    df.createOrReplaceTempView("sieve_split_in")
    out = spark.sql("SELECT id, s.* FROM sieve_split_in, LATERAL split_text(text, ',', 'piece') s")
    assert out.schema.simpleString() == "struct<id:int,piece_no:bigint,piece:string>"
    assert sorted(map(tuple, out.collect())) == [(1, 1, "a"), (1, 2, "b"), (1, 3, ""), (1, 4, "c"), (3, 1, ""), (4, 1, "x")]
    assert spark.sql("SELECT * FROM split_text('a b', ' ', 'other')").columns == ["other_no", "other"]
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT s.* FROM sieve_split_in, LATERAL split_text(text, ',', text) s").collect()


def test_table_function_over_groups(spark):
    register(spark)
    data = [(t, f"p{i:03d}", i) for t, n in (("hot", 500), ("b", 7), (None, 5)) for i in range(n)]
    spark.createDataFrame(data, "topic string, pid string, n int").repartition(9).createOrReplaceTempView("sieve_batches_in")
    out = spark.sql("SELECT * FROM numbered_batches(TABLE(sieve_batches_in), 'topic', 'pid', 4)")
    assert out.schema.simpleString() == "struct<topic:string,pid:string,n:int,batch_id:bigint,row_in_batch:bigint>"
    assert sorted(map(tuple, out.collect()), key=str) == sorted(((t, p, i, i // 4, i % 4) for t, p, i in data), key=str)
    for call in ("'nope', 'pid', 4", "'topic', 'pid', 0"):
        with pytest.raises(Exception, match="no column|above 0"):
            spark.sql(f"SELECT * FROM numbered_batches(TABLE(sieve_batches_in), {call})").collect()


def test_sketches_of_chunks(spark):
    path = new_dir(spark, "sketches")
    chunk = lambda lo, hi: spark.range(lo, hi).selectExpr("cast(id % 30000 as string) as v", "case when id % 3 = 0 then 'a' when id % 3 = 1 then 'b' end as k")
    for i, (lo, hi) in enumerate(((0, 20_000), (10_000, 40_000), (0, 500))):
        sketches.add_chunk(chunk(lo, hi), path, i, "v", ["k"])
    sketches.add_chunk(chunk(0, 500), path, 2, "v", ["k"])  # once more
    got = {r["k"]: r["n"] for r in sketches.distinct_estimate(spark, path, ["k"]).collect()}
    assert got.keys() == {"a", "b", None} and all(abs(n / 10_000 - 1) < 0.04 for n in got.values())
    assert abs(sketches.distinct_estimate(spark, path).first()["n"] / 30_000 - 1) < 0.04
    sketches.add_chunk(chunk(30_000, 30_000), path, 3, "v", ["k"])  # an empty one
    assert abs(sketches.distinct_estimate(spark, path).first()["n"] / 30_000 - 1) < 0.04


@pytest.mark.parametrize("tracked", [1 << 14, 64])
def test_heaviest_words(spark, tracked):
    draw = random.Random(3)
    texts = [" ".join(f"w{int(draw.paretovariate(0.9))}" for _ in range(60)) for _ in range(300)] + [None, ""]
    counts = Counter(w for t in texts if t for w in t.split())
    want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:25]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(6)
    assert sorted((tuple(r) for r in E.heaviest_words(df, "text", size=25, tracked=tracked).collect()), key=lambda x: (-x[1], x[0])) == want
    assert E.heaviest_words(df.limit(0), "text", size=5).count() == 0
