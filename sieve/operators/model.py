"""Relevance models for all topics in one job.

The main one is multinomial naive Bayes: a log-odds weight per topic and token, so training is
one grouped count and scoring one join, and a score splits exactly into token contributions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.functions.numeric import sigmoid
from sieve.functions.text import lower_tokens
from sieve.operators.encoding import Tokenizer, term_rows
from sieve.operators.spool import Spooled, broadcast_limit, lookup, path_exists, spool, stored_bytes

# Model codes and the class names shown for them (fixed values).
LABEL_NAMES = {"LABEL_0": "Irrelevant", "LABEL_1": "Relevant"}
CLASS_NAMES = ("Irrelevant", "Relevant")
ERROR = "Error"
# Stored weights are rounded, so that equal evidence gives equal weights on every cluster and
# rankings by weight break ties the same way. Sums of weights are sums of whole units, so they do
# not depend on the order of adding, and a logit is the same wherever it is computed.
WEIGHT_DIGITS = 6
_UNIT = 10**WEIGHT_DIGITS
_PENALTY = 0.01  # of the pooled logistic regression


@dataclass(frozen=True)
class TokenModel:
    weights: Spooled  # topic_id, token, weight, n (occurrences in training)
    priors: DataFrame  # topic_id, prior; one row per topic


def train_token_model(train: DataFrame, fields: Sequence[str] = ("title", "abstract"),
                      tokenizer: Tokenizer = lower_tokens) -> TokenModel:
    """Weight = ln((c_pos + 1) / (P + V)) - ln((c_neg + 1) / (N + V)) per topic and token."""
    y = F.col("relevance")
    priors = train.groupBy("topic_id").agg(F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"))
    # Null where a class is missing: such a topic has no model.
    prior = F.ln(F.try_divide(F.col("p").cast("double"), F.col("n").cast("double")))
    priors = priors.select("topic_id", F.when((F.col("p") > 0) & (F.col("n") > 0), prior).alias("prior"))

    words = F.concat(*[tokenizer(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    counts = spool(
        train.select("topic_id", "relevance", F.explode(words).alias("token"))
        .groupBy("topic_id", "token")
        .agg(F.count_if(y == 1).alias("c_pos"), F.count_if(y == 0).alias("c_neg")),
        "token-counts",
    )
    totals = counts.df.groupBy("topic_id").agg(
        F.sum("c_pos").alias("p"), F.sum("c_neg").alias("n"), F.count("*").alias("v")
    )
    odds = F.ln((F.col("c_pos") + 1) / (F.col("p") + F.col("v"))) - F.ln(
        (F.col("c_neg") + 1) / (F.col("n") + F.col("v"))
    )
    weights = lookup(counts.df, totals, ["topic_id"], "inner", spread="token").select(
        "topic_id", "token",
        F.round(odds, WEIGHT_DIGITS).alias("weight"),
        (F.col("c_pos") + F.col("c_neg")).alias("n"),
    )
    return TokenModel(Spooled(weights, counts.path, counts.bytes), priors)


def units(value: Column) -> Column:
    return F.round(value * _UNIT).cast("bigint")


def from_units(whole: Column) -> Column:
    return whole / _UNIT


def exact_sum(value: Column, n: Column | int = 1) -> Column:
    """The sum of ``n`` times a weight."""
    return from_units(F.sum(units(value) * n))


def weigh(tokens: DataFrame, model: TokenModel, key: Column | None = None, spread: str = "pid") -> DataFrame:
    """Adds each token occurrence's weight; tokens the model does not know weigh nothing."""
    key = F.lower("token") if key is None else key
    dim = model.weights.df.withColumnRenamed("token", "_key").withColumnRenamed("n", "_n")
    out = lookup(
        tokens.withColumn("_key", key), Spooled(dim, model.weights.path, model.weights.bytes),
        ["topic_id", "_key"], "left", spread=spread, weight="_n",
    )
    return out.withColumn("weight", F.coalesce("weight", F.lit(0.0))).drop("_key", "_n")


def score(rows: DataFrame, model: TokenModel, keys: Sequence[str] = ("topic_id", "pid"),
          carry: Sequence[str] = (), fields: Sequence[str] = ("title", "abstract")) -> DataFrame:
    """Logit and probability per row; null where the topic has no model.

    Rows that repeat their keys are scored one by one. After a broadcast of the weights all tokens
    of an article sit in one task, and the sum shuffles one partial row per article. A larger model
    is joined by shuffle, so there each text first counts its own tokens.
    """
    words = F.concat(*[lower_tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # lives within this one plan
    group = ["_row", *keys, *carry]
    if model.weights.bytes <= broadcast_limit(rows.sparkSession):
        tokens = rows.select(*group, F.explode_outer(words).alias("token"), F.lit(1).alias("n"))
    else:
        tokens = term_rows(rows, words, group)
    found = weigh(tokens, model, F.col("token"), spread="_row")
    evidence = found.groupBy(*group).agg(exact_sum(F.col("weight"), F.coalesce("n", F.lit(0))).alias("_sum"))
    logit = F.col("prior") + F.col("_sum")
    return (
        lookup(evidence, model.priors, ["topic_id"], "left", spread="_row")
        .withColumn("logit", logit)
        .withColumn("prob", sigmoid(F.col("logit")))
        .drop("prior", "_sum", "_row")
    )


def label_name(code: Column) -> Column:
    """LABEL_0 and LABEL_1 by name; other codes stay as they are."""
    pairs = [F.lit(x) for pair in LABEL_NAMES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def verdict(prob: Column) -> Column:
    code = F.when(prob >= 0.5, "LABEL_1").when(prob < 0.5, "LABEL_0").otherwise(ERROR)
    return label_name(code)


def save_model(model: TokenModel, path: str) -> None:
    """One folder per topic, so that loading a topic reads only its own weights."""
    model.weights.df.hint("rebalance", "topic_id").write.mode("overwrite").partitionBy("topic_id").parquet(
        f"{path}/weights"
    )
    model.priors.write.mode("overwrite").parquet(f"{path}/priors")


def load_model(spark: SparkSession, path: str, topic: str | None = None) -> TokenModel:
    if not path_exists(spark, f"{path}/weights"):
        raise FileNotFoundError(f"no model in {path}")
    weights = spark.read.schema("token string, weight double, n bigint, topic_id string").parquet(
        f"{path}/weights"
    ).select("topic_id", "token", "weight", "n")
    priors = spark.read.schema("topic_id string, prior double").parquet(f"{path}/priors")
    if topic is not None:
        weights = weights.filter(F.col("topic_id") == topic)
        priors = priors.filter(F.col("topic_id") == topic)
    return TokenModel(Spooled(weights, f"{path}/weights", stored_bytes(spark, f"{path}/weights")), priors)


def train_linear(train: DataFrame, text: str = "text", numeric: Sequence[str] = (),
                 weight: str | None = None, features: int = 1 << 16, iterations: int = 20) -> PipelineModel:
    """One logistic regression for all rows over hashed TF-IDF of ``text``, optionally with numeric features.

    Its coefficients, ``features`` at most, live in the driver. ``linear`` has models per topic and without that bound.
    """
    joined = [VectorAssembler(inputCols=["_tfidf", *numeric], outputCol="features")] if numeric else []
    rows = linear_input(train, text).withColumn("label", F.col("relevance").cast("double"))
    hashing = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)
    fit = LogisticRegression(
        labelCol="label", featuresCol="features" if numeric else "_tfidf", maxIter=iterations, regParam=_PENALTY,
        **({"weightCol": weight} if weight else {}),
    )
    needed = ["label", "_tf", *numeric, *([weight] if weight else [])]
    # The fit passes over its input many times; the texts are tokenised for the first one only.
    counts = spool(hashing.transform(rows).select(*needed), "term-counts").df
    return PipelineModel([hashing, *Pipeline(stages=[IDF(inputCol="_tf", outputCol="_tfidf"), *joined, fit]).fit(counts).stages])


def linear_input(rows: DataFrame, text: str = "text") -> DataFrame:
    return rows.withColumn("_words", lower_tokens(F.coalesce(F.col(text), F.lit(""))))


def score_linear(rows: DataFrame, fitted: PipelineModel, text: str = "text") -> DataFrame:
    out = fitted.transform(linear_input(rows, text))
    return out.withColumn("prob", vector_to_array("probability")[1]).drop(
        "_words", "_tf", "_tfidf", "features", "rawPrediction", "probability", "prediction"
    )
