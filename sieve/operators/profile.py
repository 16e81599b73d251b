"""Topic statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sieve.functions.text import token_count
from sieve.operators.ranking import rank_range

PERCENTS = (0.5, 0.75, 0.9, 0.95)


def positives_per_topic(df: DataFrame, numeric_only: bool = False) -> DataFrame:
    """Sum of relevance per topic (of every numeric column on request).

    Rows without a topic do not form a group, and a topic with nulls only sums to 0.
    """
    cols = ["relevance"]
    if numeric_only:
        cols = [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in cols]
    return df.filter(F.col("topic_id").isNotNull()).groupBy("topic_id").agg(*sums)


def top_topics(df: DataFrame, min_positives: int = 70, start: int = 0, stop: int | None = None) -> DataFrame:
    """Topics with enough positives, most first; optionally only the ranks [start, stop)."""
    topics = positives_per_topic(df).filter(F.col("relevance") >= min_positives)
    order = [F.desc("relevance"), "topic_id"]
    return topics.orderBy(*order) if stop is None else rank_range(topics, order, start, stop)


def balance_profile(df: DataFrame) -> DataFrame:
    y = F.col("relevance")
    return (
        df.filter(F.col("topic_id").isNotNull())
        .groupBy("topic_id")
        .agg(
            F.count_if(y == 1).alias("rel_count"),
            F.count_if(y == 0).alias("not_rel_count"),
            F.count(y).alias("count"),
        )
        .withColumn("balance_score", F.abs(F.col("rel_count") - F.col("not_rel_count")))
    )


def most_balanced(df: DataFrame, n: int = 15) -> DataFrame:
    """The ``n`` topics with most positives, best balanced first."""
    top = balance_profile(df).orderBy(F.desc("rel_count"), "topic_id").limit(n)
    return top.orderBy("balance_score", "topic_id")


def class_weight(df: DataFrame, keys: Sequence[str] = ("topic_id",)) -> DataFrame:
    """Negatives per positive, null where there is no positive."""
    y = F.col("relevance")
    negatives, positives = F.count_if(y == 0), F.count_if(y == 1)
    return df.groupBy(*keys).agg(
        negatives.alias("n_neg"), positives.alias("n_pos"),
        F.try_divide(negatives.cast("double"), positives.cast("double")).alias("pos_weight"),
    )


def length_percentiles(df: DataFrame, percents: Sequence[float] = PERCENTS, count=token_count) -> DataFrame:
    """Percentiles of token counts per topic for titles, abstracts and both lists as one.

    ``percentile`` is exact; its state is one counter per distinct length, not one per row.
    """
    lengths = df.select("topic_id", count(F.col("title")).alias("t"), count(F.col("abstract")).alias("a"))
    part = lambda name, n: F.struct(F.lit(name).alias("part"), n.alias("n"))
    t, a = F.col("t"), F.col("a")
    rows = lengths.select(
        "topic_id",
        F.inline(F.array(part("title", t), part("abstract", a), part("total", t), part("total", a))),
    )
    points = F.percentile("n", F.array(*[F.lit(p) for p in percents]))
    found = rows.groupBy("topic_id", "part").agg(points.alias("_p"))
    return found.select(
        "topic_id", "part", *[F.col("_p")[i].alias(f"p{round(p * 100)}") for i, p in enumerate(percents)]
    )
