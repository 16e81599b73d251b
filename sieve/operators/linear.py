"""Logistic regression for any number of topics at once, with data and coefficients as tables.

A row of training data is a set of cells (topic, token, value), a model is a set of weights (topic,
token), and both stay distributed: an epoch joins cells and weights, adds up the logit of each row,
joins the residuals back and adds up the gradient of each weight. Every topic has its own step size
(Barzilai and Borwein), which is two sums over its weights, so topics do not touch, and one that
holds most rows is like any other. The objective of a topic is

    mean(c * cross_entropy(y, sigmoid(w . x))) + penalty / 2 * |w|^2

with c the row's weight, over all weights, the intercept's (token ``""``) included.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sieve.functions.numeric import sigmoid
from sieve.functions.text import lower_tokens
from sieve.operators.encoding import term_lists
from sieve.operators.spool import Spooled, lookup, path_exists, spool, stored_bytes

INTERCEPT = ""
_NUMERIC = "\t"  # in front of the names of numeric features; no token has it
PENALTY = 0.03
EPOCHS = 60
TOLERANCE = 1e-7
_LOOK = 5  # epochs between looks at the gradients


@dataclass(frozen=True)
class LinearModel:
    weights: Spooled  # g (group key), token, weight, n (cells in training)
    losses: DataFrame  # g, epoch (from 0), loss: weighted cross-entropy before the epoch's step
    epochs: int


def group_key(group: str | None) -> Column:
    """A topic's key, never null; null is a topic like others. Without ``group`` all rows are one."""
    return F.lit("*") if group is None else F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("~"))


def cells(rows: DataFrame, text: str = "text", numeric: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, token, v: one row per different token of each text, per numeric column, and one for the intercept.

    Token values are ln(1 + count), scaled so that a text has length 1; numeric columns enter as they are
    (scale them to about 1; null is 0). A null or empty text has its intercept and numbers only.
    """
    terms = term_lists(rows, lower_tokens(F.coalesce(F.col(text), F.lit(""))), [*keep, *numeric], "_terms")
    log = lambda t: F.log1p(t["n"].cast("double"))
    length = F.sqrt(F.aggregate("_terms", F.lit(0.0), lambda a, t: a + log(t) * log(t)))
    cell = lambda token, v: F.struct(token.alias("token"), v.alias("v"))
    scaled = F.transform("_terms", lambda t: cell(t["token"], log(t) / F.col("_length")))
    others = [cell(F.lit(INTERCEPT), F.lit(1.0))]
    others += [cell(F.lit(_NUMERIC + c), F.coalesce(F.col(c).cast("double"), F.lit(0.0))) for c in numeric]
    return terms.withColumn("_length", length).select(*keep, F.inline(F.concat(scaled, F.array(*others))))


def fit(
    train: DataFrame,
    text: str = "text",
    group: str | None = "topic_id",
    label: str = "relevance",
    weight: str | None = None,
    numeric: Sequence[str] = (),
    penalty: float = PENALTY,
    epochs: int = EPOCHS,
    tolerance: float = TOLERANCE,
) -> LinearModel:
    """One model per topic. Ends after ``epochs``, or when no gradient is above ``tolerance``.

    Rows without label or weight are left out; rows may repeat. A topic with one class only has a model too,
    that says so. The driver sees one number every few epochs.
    """
    y = F.col(label).cast("double")
    c = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    rows = train.withColumns({"_g": group_key(group), "_y": y, "_c": c}).filter(F.col("_y").isNotNull() & F.col("_c").isNotNull())
    # No second derivative of a row's loss is above a quarter of its length, which is 1 + 1 and its numbers.
    length = reduce(lambda a, n: a + F.pow(F.coalesce(F.col(n).cast("double"), F.lit(0.0)), F.lit(2.0)), numeric, F.lit(2.0))
    groups = rows.groupBy("_g").agg(F.count("*").cast("double").alias("_n"), (F.avg(F.col("_c") * length) / 4 + penalty).alias("_curve"))
    rows = lookup(rows, groups, ["_g"], "inner", spread=text).withColumn("_row", F.monotonically_increasing_id())
    own = ["_row", "_y", "_c", "_n", "_curve"]  # written with the cells, so the number stays
    data = spool(cells(rows, text, numeric, [*own, "_g"]).withColumnRenamed("_g", "g"), "cells").df
    zero = F.lit(0.0)
    first = spool(data.groupBy("g", "token").agg(F.count("*").alias("n"), F.max("_curve").alias("_curve")).select(
        F.monotonically_increasing_id().alias("id"), "g", "token", "n", "_curve",
        zero.alias("w"), zero.alias("step"), zero.alias("gradient")), "weights")
    # Weights get numbers once, so that no epoch compares, sorts or shuffles tokens.
    names = Spooled(first.df.select("g", "token", "id", F.col("n").alias("_cells")), first.path, first.bytes)
    numbered = lookup(data, names, ["g", "token"], "inner", spread="_row", weight="_cells")
    data = spool(numbered.select("_row", "id", "v", "_y", "_c", "_n", (F.col("token") == INTERCEPT).alias("_one")), "numbered").df
    state, losses, epoch = first, [], 0
    row = Window.partitionBy("_row")  # the tokens of one text
    while epoch < epochs:
        own = Spooled(state.df.select("id", "w", F.col("n").alias("_cells")), state.path, state.bytes)
        weighed = lookup(data, own, ["id"], "inner", spread="_row", weight="_cells").drop("_cells")
        weighed = weighed.withColumn("z", F.sum(F.col("v") * F.col("w")).over(row))
        residual = F.col("_c") * (sigmoid(F.col("z")) - F.col("_y")) / F.col("_n")
        entropy = F.log1p(F.exp(-F.abs("z"))) + F.greatest("z", F.lit(0.0)) - F.col("_y") * F.col("z")
        # The cell of the intercept is there once for each row, so it carries the row's loss.
        loss = F.sum(F.when(F.col("_one"), F.col("_c") * entropy / F.col("_n"))).alias("loss")
        pulled = weighed.groupBy("id").agg(F.sum(F.col("v") * residual).alias("pull"), loss).join(state.df, "id")  # one row per weight on both sides
        slope = F.col("pull") + F.lit(penalty) * F.col("w")
        tried = spool(pulled.select(
            "id", "g", "token", "n", "w", "step", F.col("gradient").alias("old"), slope.alias("gradient"), "_curve", "loss"), "tried")
        losses.append(tried.df.filter(F.col("token") == INTERCEPT).select("g", F.lit(epoch).alias("epoch"), "loss"))
        step = F.col("step")
        dots = tried.df.groupBy("g").agg(
            F.sum(step * step).alias("ss"), F.sum(step * (F.col("gradient") - F.col("old"))).alias("sy"), F.max("_curve").alias("_curve")
        )
        rate = dots.select("g", F.when(F.col("sy") > 0, F.col("ss") / F.col("sy")).otherwise(1 / F.col("_curve")).alias("rate"))
        after = lookup(tried.df, rate, ["g"], "inner", spread="token").withColumn("step", -F.col("rate") * F.col("gradient"))
        after = after.select("id", "g", "token", "n", "_curve", (F.col("w") + F.col("step")).alias("w"), "step", "gradient")
        state = Spooled(after, tried.path, tried.bytes)
        epoch += 1
        if tolerance and epoch % _LOOK == 0 and (tried.df.agg(F.max(F.abs("gradient"))).first()[0] or 0.0) <= tolerance:
            break
    weights = spool(state.df.select("g", "token", F.col("w").alias("weight"), "n"), "linear-model")
    none = train.sparkSession.createDataFrame([], "g string, epoch int, loss double")
    return LinearModel(weights, reduce(DataFrame.unionByName, losses) if losses else none, epoch)


def score(
    rows: DataFrame,
    model: LinearModel,
    text: str = "text",
    group: str | None = "topic_id",
    numeric: Sequence[str] = (),
    keys: Sequence[str] = ("topic_id", "pid"),
    carry: Sequence[str] = (),
) -> DataFrame:
    """``keys``, ``carry``, logit and prob, row by row; null where the topic has no model. Unknown tokens weigh nothing."""
    kept = list(dict.fromkeys([*keys, *carry]))
    rows = rows.withColumns({"_row": F.monotonically_increasing_id(), "_g": group_key(group)})  # lives within this one plan
    one = cells(rows, text, numeric, ["_row", "_g", *kept]).withColumnRenamed("_g", "g")
    found = lookup(one, model.weights, ["g", "token"], "left", spread="_row", weight="n")
    known = F.max(F.when(F.col("token") == INTERCEPT, F.col("weight"))).isNotNull()
    logit = F.sum(F.col("v") * F.coalesce("weight", F.lit(0.0)))
    out = found.groupBy("_row", *kept).agg(F.when(known, logit).alias("logit"))
    return out.withColumn("prob", sigmoid(F.col("logit"))).drop("_row")


def save(model: LinearModel, path: str) -> None:
    """One folder per topic, so that loading a topic reads only its own weights."""
    model.weights.df.hint("rebalance", "g").write.mode("overwrite").partitionBy("g").parquet(f"{path}/weights")
    model.losses.write.mode("overwrite").parquet(f"{path}/losses")


def load(spark: SparkSession, path: str, topic: str | None = None) -> LinearModel:
    if not path_exists(spark, f"{path}/weights"):
        raise FileNotFoundError(f"no model in {path}")
    weights = spark.read.schema("token string, weight double, n bigint, g string").parquet(f"{path}/weights").select("g", "token", "weight", "n")
    losses = spark.read.schema("g string, epoch int, loss double").parquet(f"{path}/losses")
    if topic is not None:
        weights, losses = (df.filter(F.col("g") == f"={topic}") for df in (weights, losses))
    epochs = (losses.agg(F.max("epoch")).first()[0] or 0) + 1
    return LinearModel(Spooled(weights, f"{path}/weights", stored_bytes(spark, f"{path}/weights")), losses, epochs)
