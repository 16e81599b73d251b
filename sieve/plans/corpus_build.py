"""From raw files to the training corpus, in both label regimes."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sieve.operators.corpus import graded_corpus, judged_articles, labelled, one_per_pid, topic_judgments
from sieve.operators.ranking import SEED
from sieve.operators.sampling import sample_negatives
from sieve.sources.files import judged_ids


def sampled_corpus(topics: DataFrame, judgments: DataFrame, articles: DataFrame, seed: int | str = SEED,
                   exclude: DataFrame | None = None, dedupe: bool = True) -> DataFrame:
    """Everything judged is relevant; as many unjudged articles are the irrelevant ones.

    ``exclude`` names more ids that must not become negatives, such as those of the other split.
    """
    if dedupe:
        articles = one_per_pid(articles)
    judged = topic_judgments(topics, judged_ids(judgments))
    positives = labelled(judged_articles(judged, articles), 1)
    corpus = sample_negatives(positives, articles, seed, exclude)
    return corpus.select(
        "topic_id", "topic_title", "topic_objective", "pid", "relevance", "title", "abstract"
    )


def graded(judgments: DataFrame, articles: DataFrame, dedupe: bool = True) -> DataFrame:
    """Every judged article with the grade it was given."""
    return graded_corpus(judgments, one_per_pid(articles) if dedupe else articles)
