"""Explain verdicts and shape them for reading."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators.attribution import explanation_records
from sieve.operators.corpus import screenable
from sieve.operators.model import TokenModel
from sieve.operators.results import article_results


def explained(rows: DataFrame, model: TokenModel) -> DataFrame:
    """Raw explanation records of articles that have something to read."""
    rows = screenable(rows).select(
        "topic_id", "pid", F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("abstract", F.lit("")).alias("abstract"),
    )
    return explanation_records(rows, model)


def readable(rows: DataFrame, model: TokenModel) -> DataFrame:
    """Explained articles: parts with scores, and the top words."""
    return article_results(explained(rows, model))
