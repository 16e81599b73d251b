from __future__ import annotations

import json

from pyspark.sql import functions as F

from sieve import schemas
from sieve.functions import text as X
from sieve.operators import results as R
from sieve.operators.corpus import described

REL = ["Irrelevant", "Relevant"]


def expl(tokens, values, classes=REL):
    return {"tokens": tokens, "scores": [[-v, v] for v in values], "classes": classes}


def shape(spark, **fields):
    row = {"title": "t", "abstract": "a", "verdict": "Relevant", "title_expl": None, "abstract_expl": None, **fields}
    return R.article_results(spark.createDataFrame([row], schemas.EXPLAINED_ARTICLE)).first()


def words(row):
    return [(p["token"], p["value"]) for p in row["top_words"]]


TOKENS, VALUES = ["Foo", "foo", ".", "bar", "12", "b2"], [0.5, 0.6, 9.0, 0.5, 3.0, -0.7]


def test_class_index(spark):
    cases = [
        (REL, 1), (["Relevant", "Irrelevant"], 0), (["LABEL_0", "LABEL_1"], 1), (["LABEL_1", "x", "y"], 0),
        (["a", "b"], 1), (["a", "b", "c"], None), ([], None),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "classes array<string>")
    got = [r[0] for r in df.select(R.class_index(F.col("classes")) - 1).collect()]
    assert got == [want for _, want in cases]


def test_no_class_means_empty_lists(spark):
    row = shape(spark, title_expl=expl(["x"], [1.0], ["a", "b", "c"]))
    assert row["explained_title_parts"] == [] and row["top_words"] == []


def test_lengths_must_match(spark):
    bad = {"tokens": ["x", "y"], "scores": [[0.0, 1.0]], "classes": REL}
    row = shape(spark, title_expl=bad, abstract_expl=expl(["z"], [2.0]))
    assert row["explained_title_parts"] == []
    assert words(row) == [("z", 2.0)]


def test_short_score_row_is_zero(spark):
    row = shape(spark, title_expl={"tokens": ["x", "y"], "scores": [[1.0], [0.0, 2.0]], "classes": REL})
    assert [(p["token"], p["value"]) for p in row["explained_title_parts"]] == [("x", 0.0), ("y", 2.0)]


def test_verdict_orders(spark):
    order = lambda v: words(shape(spark, verdict=v, title_expl=expl(TOKENS, VALUES)))
    assert order("Relevant") == [("foo", 0.6), ("bar", 0.5), ("b2", -0.7)]
    assert order("Irrelevant") == [("b2", -0.7), ("Foo", 0.5), ("bar", 0.5)]
    assert order("Error") == [("b2", -0.7), ("foo", 0.6), ("bar", 0.5)]


def test_ties_in_reading_order_and_five_at_most(spark):
    row = shape(spark, title_expl=expl(list("gfe"), [0.1] * 3), abstract_expl=expl(list("dcba"), [0.1] * 4))
    assert [w for w, _ in words(row)] == list("gfedc")


def test_defaults(spark):
    row = shape(spark, title=None, abstract=None, verdict=None)
    assert (row["title"], row["abstract"], row["verdict"]) == ("N/A", "", "N/A")


def test_pages_hold_every_article(spark):
    part = [{"token": "x", "value": 1.0}]
    data = [("t", i, f"title {i}", "a", "Relevant", part, part, part) for i in range(32)]
    parts = "array<struct<token:string,value:double>>"
    df = spark.createDataFrame(
        data, "topic_id string, position int, title string, abstract string, verdict string, "
        f"explained_title_parts {parts}, explained_abstract_parts {parts}, top_words {parts}",
    )
    pages = R.topic_pages(df, 15).orderBy("page").collect()
    assert [len(p["articles"]) for p in pages] == [15, 15, 2]
    assert [a["title"] for p in pages for a in p["articles"]] == [f"title {i}" for i in range(32)]
    first = json.loads(pages[0]["json"])
    assert first["topic_name"] == "t"
    assert first["articles"][0]["top_words"] == [{"token": "x", "value": 1.0}]
    assert list(first["articles"][0]) == [
        "title", "abstract", "verdict", "explained_title_parts", "explained_abstract_parts", "top_words",
    ]


def test_highlight(spark):
    df = spark.createDataFrame([(0.0,), (0.0005,), (0.25,), (-2.0,)], "v double")
    got = [tuple(r[0]) for r in df.select(R.highlight(F.col("v"))).collect()]
    assert got == [("transparent", 0.0), ("transparent", 0.0), ("red", 0.4), ("green", 0.7)]


def test_rebuilt_text(spark):
    parts = "array<struct<token:string,value:double>>"
    cases = [[("Is", 0.0), ("it", 0.0), ("?", 0.0), ("über", 0.0), ("yes", 0.0)], [], None]
    df = spark.createDataFrame([(c,) for c in cases], f"p {parts}")
    got = [r[0] for r in df.select(R.rebuilt_text(F.col("p"), F.lit("none"))).collect()]
    assert got == ["Is it?über yes", "none", "none"]


def test_display(spark):
    df = spark.createDataFrame([("Relevant", "x" * 70, 1), ("Irrelevant", "x" * 71, 2), ("Error", "", 3)],
                               "v string, t string, n int")
    got = df.select(
        R.shown_verdict(F.col("v"), True), R.shown_verdict(F.col("v")), R.verdict_colour(F.col("v")),
        X.list_label(F.col("t"), F.col("n")),
    ).collect()
    assert [tuple(r) for r in got] == [
        ("Irrelevant", "Relevant", "green", "x" * 70),
        ("Relevant", "Irrelevant", "red", "x" * 70 + "..."),
        ("Error", "Error", "red", "Article 3"),
    ]


def test_topic_descriptions(spark):
    dim = spark.createDataFrame(list(R.TOPIC_DESCRIPTIONS.items()), "topic_id string, description string")
    rows = spark.createDataFrame([("CD012010", "1"), ("CD0", "2")], "topic_id string, pid string")
    got = {r["pid"]: r["description"] for r in described(rows, dim).collect()}
    assert got["1"].startswith("Title: Serum amylase") and got["2"] is None


def test_text_functions(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert val(X.strip(F.lit(" \t a b\n "))) == "a b"
    assert val(X.tokens(F.lit("Über-β2, naïve_x! 12.5 µg"))) == [
        "Über", "-", "β2", ",", "naïve_x", "!", "12", ".", "5", "µg",
    ]
    assert val(X.screening_text(F.lit(None).cast("string"), F.lit(" a "))) == "a"
    keys = ["007", "7.0", " 12 ", "x1", "0", "000", None, "123456789012345678901"]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = [r[0] for r in df.select(X.normal_key(F.col("k"))).collect()]
    assert got == ["7", "7", "12", "x1", "0", "0", None, "123456789012345678901"]
    assert val(X.between(F.lit("shaps_CD1_2.pkl"), "shaps_", ".pkl")) == "CD1_2"
    assert val(X.between(F.lit("other.pkl"), "shaps_", ".pkl")) is None
    assert val(X.base_id(F.lit("CD1_2"))) == "CD1"
    assert val(X.path_part(F.lit("a/topics/f"), -2)) == "topics"
