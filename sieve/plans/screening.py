"""Train, score and judge every topic in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators.corpus import complete_rows
from sieve.operators.metrics import threshold_sweep
from sieve.operators.model import TokenModel, score, train_token_model, verdict
from sieve.operators.ranking import SEED
from sieve.operators.sampling import balanced_split


@dataclass(frozen=True)
class Screening:
    split: DataFrame  # balanced corpus with is_test, spooled
    model: TokenModel

    @property
    def train(self) -> DataFrame:
        return self.split.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.split.filter("is_test")

    def predictions(self) -> DataFrame:
        """topic_id, pid, label, logit, prob of the held-out part."""
        rows = self.test.withColumnRenamed("relevance", "label")
        return score(rows, self.model, carry=["label"])

    def sweep(self) -> DataFrame:
        return threshold_sweep(self.predictions())


def screen(citations: DataFrame, seed: int = SEED, test_percent: int = 25, strict: bool = False) -> Screening:
    """``citations``: topic_id, pid, title, abstract, relevance. Incomplete rows are left out.

    ``strict`` refuses topics with fewer irrelevant than relevant rows, which are cut otherwise.
    """
    split = balanced_split(complete_rows(citations), seed, test_percent, strict)
    return Screening(split, train_token_model(split.filter(~F.col("is_test"))))


def judged(rows: DataFrame, model: TokenModel) -> DataFrame:
    """Any articles with probability and verdict; ``Error`` where the topic has no model."""
    return score(rows, model).withColumn("verdict", verdict(F.col("prob")))
