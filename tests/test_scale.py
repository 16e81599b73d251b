"""What grows with the input: memory of Python, rows per task, columns in a shuffle."""

from __future__ import annotations

import gc
import weakref

import pandas as pd
from pyspark.sql import functions as F


def test_scoring_function_keeps_no_batch(spark):
    from sieve.queries.explanation import _long_word_score

    texts = pd.Series(["some sentences of words", "", None])
    left = weakref.ref(texts)
    gc.disable()
    try:
        found = _long_word_score().func(texts)
        del texts
        assert left() is None  # no cycle waits for a collection
    finally:
        gc.enable()
    assert round(found[0], 6) == 0.450166
    assert found[1] == 0.5 and pd.isna(found[2])


def test_batches_for_python_are_bounded_in_bytes(spark):
    long = spark.range(64, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))

    @F.pandas_udf("int")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([len(texts)] * len(texts))

    assert long.select(size("text").alias("n")).agg(F.max("n")).first()[0] <= 17


def test_rounds_of_runs_shuffle_no_text(spark, monkeypatch):
    from sieve.operators import attribution as A
    from tests.test_plans import plan

    plans, write = [], A.spool
    monkeypatch.setattr(A, "spool", lambda df, *more: plans.append(plan(df)) or write(df, *more))
    rows = spark.createDataFrame([("t", "1", "a b c d e"), ("t", "1", "a b c d e"), (None, None, "a")], "topic_id string, pid string, text string")
    runs = A.run_attributions(rows, F.udf(lambda t: float(len(t)), "double"), rounds=2, width=2)
    assert sorted((r["pid"] or "", r["lo"], r["hi"]) for r in runs.collect()) == sorted(
        [("1", a, b) for a, b in ((0, 1), (1, 2), (2, 3), (3, 5)) for _ in range(2)] + [("", 0, 1)])
    assert plans and not any("Exchange" in p or "Join" in p for p in [*plans, plan(runs)])


def test_state_is_read_and_written_once_per_call():
    from pyspark.sql import Row

    from sieve.streaming.open_verdicts import OpenVerdicts

    calls = []

    class State(dict):
        def __init__(self):
            store = {
                "get": lambda: self[None] if None in self else None, "exists": lambda: None in self, "iterator": lambda: iter([*self.items()]),
                "update": lambda v: self.__setitem__(None, v), "updateValue": self.__setitem__, "getValue": self.__getitem__,
                "containsKey": self.__contains__, "removeKey": self.__delitem__, "clear": super().clear,
            }
            for name, does in store.items():
                setattr(self, name, lambda *args, name=name, does=does: calls.append(name) or does(*args))

    made = OpenVerdicts(None)
    made.place, made.open = State(), State()
    events = [Row(topic_id="t", article_id=f"a{i % 3}", verdict="Relevant", micros=i, event_id=i) for i in range(500)]
    out = list(made.handleInputRows(("r",), iter(reversed(events)), None))
    assert len(calls) <= 6 and {k: v[1] for k, v in made.open.items()} == {("a0",): 498, ("a1",): 499, ("a2",): 497}
    assert [r["step"] for r in out] == list(range(1, 501))
    calls.clear()
    out = list(made.handleInputRows(("r",), iter([Row(topic_id="u", article_id=None, verdict="Irrelevant", micros=600, event_id=0)]), None))
    assert len(calls) <= 5 and [(r["change"], r["topic_id"], r["ts"]) for r in out] == [("clear", "u", 499), ("set", "u", 600)]
    assert dict(made.open) == {(None,): ("Irrelevant", 600, 0)}


def test_batches_of_one_group_are_numbered_by_many_tasks(spark):
    from sieve.functions.table_functions import parted, register

    register(spark)
    rows = spark.range(1000).selectExpr("case when id % 10 = 0 then null else 'g' end as topic", "md5(cast(id as string)) as place", "id")
    parted(rows, "topic", "place", 1).createOrReplaceTempView("sieve_parted")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small parts would be put together
    try:
        out = spark.sql("SELECT * FROM numbered_batches(TABLE(sieve_parted), 'topic', 'place', 16, 'part', 'before')")
        got = out.withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == 1000 and len({r["task"] for r in got if r["topic"] == "g"}) > 1
    for topic in ("g", None):
        mine = sorted((r for r in got if r["topic"] == topic), key=lambda r: r["place"])
        assert [(r["batch_id"], r["row_in_batch"]) for r in mine] == [divmod(i, 16) for i in range(len(mine))]


def test_explanations_shuffle_no_words_with_places(spark, monkeypatch):
    """With a model too large to broadcast, a word that repeats is one row, and copies keep their own explanation."""
    from sieve.operators import attribution as A
    from sieve.operators.model import train_token_model

    kind = "topic_id string, pid string, title string, abstract string"
    train = spark.createDataFrame([("t", "1", "a b", "c", 1), ("t", "2", "d", "a", 0)], kind + ", relevance int")
    model = train_token_model(train)
    rows = spark.createDataFrame(
        [("t", "1", "A b!", "a a A"), ("t", "1", "A b!", "a a A"), ("t", "1", None, "b"), (None, None, "a", None), ("t", "3", None, "")], kind)
    seen, weigh = [], A.weigh
    monkeypatch.setattr(A, "weigh", lambda long, *more, **named: seen.append(long.count()) or weigh(long, *more, **named))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        got = A.explanation_records(rows, model).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert seen == [3 + 3 + 1 + 1]  # different words of each article, not 6 + 6 + 1 + 1 tokens
    weight = {r["token"]: r["weight"] for r in model.weights.df.collect()}
    by = sorted(got, key=lambda r: (r["pid"] or "", r["title"] or ""))
    assert [(r["pid"], r["title_expl"] and r["title_expl"]["tokens"], r["abstract_expl"] and r["abstract_expl"]["tokens"]) for r in by] == [
        (None, ["a"], []), ("1", [], ["b"]), ("1", ["A", "b", "!"], ["a", "a", "A"]), ("1", ["A", "b", "!"], ["a", "a", "A"]), ("3", None, None)]
    for r in by[2:4]:
        assert [s[1] for s in r["title_expl"]["scores"]] == [weight["a"], weight["b"], 0.0]
        assert [s[1] for s in r["abstract_expl"]["scores"]] == [weight["a"]] * 3
    assert [r["verdict"] for r in by] == ["Error", *[r["verdict"] for r in by[1:]]]


def test_explanations_shuffle_a_word_once_per_block(spark, monkeypatch):
    """A model within the broadcast limit shuffles no words at all; of a larger one, articles share the words of their block."""
    from sieve.operators import attribution as A
    from sieve.operators.model import train_token_model

    train = spark.createDataFrame(
        [("t", "1", "a b", "c", 1), ("t", "2", "d", "a", 0), ("u", "3", "a", "e", 1), ("u", "4", "f", "", 0)],
        "topic_id string, pid string, title string, abstract string, relevance int")
    model = train_token_model(train)
    rows = spark.range(1000, numPartitions=1).selectExpr(
        "case when id % 10 = 0 then null when id % 3 = 0 then 'u' else 't' end as topic_id", "cast(id div 2 as string) as pid",
        "case when id % 7 > 0 then 'A, b' end as title", "case when id % 5 > 0 then concat('a D x', id % 4) when id % 2 = 0 then '' end as abstract")
    seen, written, weigh, write = [], [], A.weigh, A.spool
    monkeypatch.setattr(A, "weigh", lambda long, *more, **named: seen.append(long.count()) or weigh(long, *more, **named))
    monkeypatch.setattr(A, "spool", lambda df, *more: written.append(df.columns) or write(df, *more))
    small = A.explanation_records(rows, model).collect()
    assert not seen and not written
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        large = A.explanation_records(rows, model).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert sorted(map(str, small)) == sorted(map(str, large)) and len(small) == 1000
    words_of_topics = 3 * 8  # a b , d x0 x1 x2 x3
    assert len(seen) == 1 and seen[0] <= (4 * spark.sparkContext.defaultParallelism + 2) * words_of_topics < 1000
    weight = {(r["topic_id"], r["token"]): r["weight"] for r in model.weights.df.collect()}
    prior = {r["topic_id"]: r["prior"] for r in model.priors.collect()}
    for r in large:
        parts = [(w, s) for x in (r["title_expl"], r["abstract_expl"]) if x for w, s in zip(x["tokens"], x["scores"], strict=True)]
        assert [w for w, _ in parts] == (["A", ",", "b"] if r["title"] else []) + (r["abstract"] or "").split()
        assert [s for _, s in parts] == [[-v, v] for v in (weight.get((r["topic_id"], w.lower()), 0.0) for w, _ in parts)]
        logit = prior[r["topic_id"]] + sum(s[1] for _, s in parts) if r["topic_id"] else None
        assert r["verdict"] == ("Error" if logit is None else "Relevant" if logit > -1e-9 else "Irrelevant")


def test_epochs_carry_no_tokens(spark, monkeypatch):
    from sieve.operators import linear

    seen, lookup = [], linear.lookup
    monkeypatch.setattr(linear, "lookup", lambda rows, dim, on, *more, **named: seen.append((on, rows.columns)) or lookup(rows, dim, on, *more, **named))
    rows = spark.createDataFrame([("t", "a b", 1), ("t", "c", 0), ("u", "a", 1), (None, None, 0)], "topic_id string, text string, relevance int")
    fitted = linear.fit(rows, epochs=3, tolerance=0)
    epochs = [columns for on, columns in seen if on == ["id"]]
    assert len(epochs) == 3 and not any({"g", "token"} & set(c) for c in epochs)
    assert fitted.weights.df.count() == len(fitted.weights.df.select("g", "token").distinct().collect()) == 4 + 2 + 1
