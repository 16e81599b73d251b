"""Joins, filters and unions that turn topics, judgments and articles into labelled rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions.text import joined, normal_key, screening_text
from sieve.operators.spool import lookup


def with_normal_key(df: DataFrame, key: str, name: str = "pid") -> DataFrame:
    return df.withColumn(name, normal_key(F.col(key)))


def not_null(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with a value in all of ``cols``, as predicates a Parquet scan can take over."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows without a null in any column."""
    return not_null(df, *df.columns)


def labelled(df: DataFrame, relevance: int) -> DataFrame:
    return df.withColumn("relevance", F.lit(relevance))


def features_and_label(df: DataFrame, topic: str | None = None, relevance: int | None = None) -> DataFrame:
    """Complete rows of a topic and class; keys and label stay next to the features."""
    if topic is not None:
        df = df.filter(F.col("topic_id") == topic)
    if relevance is not None:
        df = df.filter(F.col("relevance") == relevance)
    return complete_rows(df)


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def distinct_ids(*frames: DataFrame, key: str = "pid") -> DataFrame:
    return union_all(*[f.select(key) for f in frames]).distinct()


def shared_topics(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.select("topic_id").intersect(test.select("topic_id"))


def one_per_pid(articles: DataFrame) -> DataFrame:
    """One article per pid: the one with abstract and title rather than without, then the
    greatest text, so that every run keeps the same copy."""
    best = F.max(
        F.struct(
            F.col("abstract").isNotNull().alias("a"), F.col("title").isNotNull().alias("t"),
            "abstract", "title",
        )
    )
    return articles.groupBy("pid").agg(best.alias("_b")).select("pid", "_b.title", "_b.abstract")


def topic_judgments(topics: DataFrame, judgments: DataFrame) -> DataFrame:
    """Topics left-joined to judgments: silent topics keep one row with a null pid.

    Written as inner join plus the silent topics, because the judgments of one topic can be
    most of the table and an outer join could neither broadcast the topics nor split that side.
    """
    judged = lookup(judgments, topics, ["topic_id"], "inner")
    silent = topics.join(judgments.select("topic_id").distinct(), "topic_id", "left_anti")
    order = [*topics.columns, *[c for c in judgments.columns if c != "topic_id"]]
    return judged.select(*order).unionByName(silent, allowMissingColumns=True)


def judged_articles(judgments: DataFrame, articles: DataFrame) -> DataFrame:
    """Judgments with the article they name, where title and abstract are known."""
    return not_null(judgments.join(articles, "pid", "left"), "title", "abstract")


def graded_corpus(judgments: DataFrame, articles: DataFrame) -> DataFrame:
    """Every judgment with every article of its pid; duplicates on either side multiply."""
    return judgments.join(articles, "pid", "inner").select(
        "topic_id", "pid", "relevance", "title", "abstract"
    )


def misfits(articles: DataFrame, *judged: DataFrame) -> DataFrame:
    """Articles with an abstract that none of the judged tables names."""
    return not_null(articles, "abstract").join(distinct_ids(*judged), "pid", "left_anti")


def model_input(df: DataFrame, *cols: str, name: str = "text", null_as: str | None = None) -> DataFrame:
    return df.withColumn(name, joined(*[F.col(c) for c in cols], null_as=null_as))


def screenable(df: DataFrame) -> DataFrame:
    """Adds the text a verdict is based on; articles with nothing to read leave."""
    text = screening_text(F.col("title"), F.col("abstract"))
    return df.withColumn("text", text).filter(F.col("text") != "")


def first_match(df: DataFrame, col: str, value: str, order: str = "pid") -> DataFrame:
    return df.filter(F.col(col) == value).orderBy(order).limit(1)


def described(rows: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Adds the topic's description, null where there is none."""
    return lookup(rows, descriptions, ["topic_id"], "left")
