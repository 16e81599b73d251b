"""Training, scoring and evaluation of all topics at once."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions.numeric import fixed, sigmoid, two_class
from sieve.functions.text import token_count
from sieve.operators import linear
from sieve.operators import metrics as M
from sieve.operators import model as L
from sieve.operators.corpus import model_input
from sieve.operators.profile import class_weight
from sieve.operators.ranking import batched
from sieve.operators.sampling import balanced_split
from sieve.operators.spool import lookup, new_dir
from sieve.operators.user_aggregate import aggregate_rows
from sieve.plans.screening import screen
from sieve.queries.base import (
    SCORE_SQL, SCREEN_SQL, TRAIN_SQL, VERDICTS_SQL, Tables, citations_sql, query, rounded, tokens_sql, with_sql,
)

_RATES = ("accuracy", "precision", "recall", "f1")
_COUNTS_SQL = """count(*) FILTER (WHERE prob >= threshold AND label = 1) AS tp,
         count(*) FILTER (WHERE prob >= threshold AND label = 0) AS fp,
         count(*) FILTER (WHERE prob < threshold AND label = 1) AS fn,
         count(*) FILTER (WHERE prob < threshold AND label = 0) AS tn"""
_RATES_SQL = """round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 6) AS accuracy,
       CASE WHEN tp + fp = 0 THEN 0 ELSE round(tp / CAST(tp + fp AS DOUBLE), 6) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0 ELSE round(tp / CAST(tp + fn AS DOUBLE), 6) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) END AS f1"""


@query("class_weight", with_sql(citations_sql("source"), """
SELECT topic_id, n_neg, n_pos, round(n_neg / CAST(nullif(n_pos, 0) AS DOUBLE), 6) AS pos_weight FROM (
  SELECT topic_id, count(*) FILTER (WHERE relevance = 0) AS n_neg, count(*) FILTER (WHERE relevance = 1) AS n_pos
  FROM citations GROUP BY topic_id)"""))
def class_weight_query(t: Tables) -> DataFrame:
    return class_weight(t.judgments("source")).withColumn("pos_weight", rounded("pos_weight"))


@query("token_model", with_sql(TRAIN_SQL, """
SELECT w.topic_id, token, weight, c_pos + c_neg AS n, round(prior, 6) AS prior
FROM weights w JOIN priors p ON w.topic_id = p.topic_id"""))
def token_model(t: Tables) -> DataFrame:
    model = screen(t.citations()).model
    return lookup(model.weights.df, model.priors, ["topic_id"], spread="token").withColumn("prior", rounded("prior"))


@query("scores", with_sql(SCORE_SQL, """
SELECT topic_id, pid, label, round(logit, 6) AS logit, round(prob, 6) AS prob, round(1 - prob, 6) AS prob_irrelevant,
       printf('%.4f', prob) AS shown
FROM scores"""))
def scores(t: Tables) -> DataFrame:
    return screen(t.citations()).predictions().select(
        "topic_id", "pid", "label", rounded("logit").alias("logit"),
        rounded(sigmoid(F.col("logit"))).alias("prob"),
        rounded(two_class(F.col("prob"))[0]).alias("prob_irrelevant"),
        fixed(F.col("prob"), 4).alias("shown"),
    )


@query("verdicts", with_sql([*SCORE_SQL, VERDICTS_SQL], "SELECT topic_id, pid, verdict FROM verdicts"))
def verdicts(t: Tables) -> DataFrame:
    predictions = screen(t.citations()).predictions()
    return predictions.select("topic_id", "pid", L.verdict(F.col("prob")).alias("verdict"))


@query("metrics_at", with_sql(SCORE_SQL, f"""
SELECT topic_id, tp, fp, fn, tn, {_RATES_SQL}
FROM (SELECT topic_id, {_COUNTS_SQL} FROM scores, (SELECT 0.5 AS threshold) GROUP BY topic_id)"""))
def metrics_at(t: Tables) -> DataFrame:
    out = M.metrics_at(screen(t.citations()).predictions())
    return out.select("topic_id", "tp", "fp", "fn", "tn", *[rounded(c).alias(c) for c in _RATES])


@query("threshold_sweep", with_sql(SCORE_SQL, f"""
SELECT topic_id, threshold, tp, fp, fn, tn, {_RATES_SQL}
FROM (SELECT topic_id, threshold, {_COUNTS_SQL}
      FROM scores, (SELECT CAST(i / 10.0 AS DOUBLE) AS threshold FROM range(1, 10) r(i)) GROUP BY topic_id, threshold)"""))
def threshold_sweep(t: Tables) -> DataFrame:
    out = screen(t.citations()).sweep()
    return out.select("topic_id", "threshold", "tp", "fp", "fn", "tn", *[rounded(c).alias(c) for c in _RATES])


@query("weighted_loss", with_sql([*SCORE_SQL, """pos_weights AS (
  SELECT topic_id, count(*) FILTER (WHERE relevance = 0) / CAST(count(*) FILTER (WHERE relevance = 1) AS DOUBLE) AS pos_weight
  FROM citations GROUP BY topic_id),
losses AS (
  SELECT s.topic_id, pid, -(pos_weight * label * ln(greatest(prob, 1e-12)) + (1 - label) * ln(greatest(1 - prob, 1e-12))) AS loss,
         (row_number() OVER (PARTITION BY s.topic_id ORDER BY pid) - 1) // 16 AS batch_id
  FROM scores s JOIN pos_weights w ON s.topic_id = w.topic_id)"""], """
SELECT topic_id, round(avg(mean), 6) AS avg_loss, count(*) AS n_batches
FROM (SELECT topic_id, batch_id, avg(loss) AS mean FROM losses GROUP BY topic_id, batch_id) GROUP BY topic_id"""))
def weighted_loss(t: Tables) -> DataFrame:
    weights = class_weight(t.judgments()).select("topic_id", "pos_weight")
    rows = lookup(screen(t.citations()).predictions(), weights, ["topic_id"], "inner")
    losses = rows.withColumn("loss", M.cross_entropy(F.col("pos_weight"))).select("topic_id", "pid", "loss")
    out = M.mean_batch_loss(batched(losses, 16, shuffle=False))
    return out.withColumn("avg_loss", rounded("avg_loss"))


@query("grouped_aggregate", with_sql(citations_sql("source"), """
SELECT topic_id, count(*) FILTER (WHERE relevance = 1) AS rel_count FROM citations GROUP BY topic_id"""))
def grouped_aggregate(t: Tables) -> DataFrame:
    """A user's own aggregate, given partial counts: the hot topic is reduced before pandas sees it."""

    @F.pandas_udf("bigint")
    def total(n: pd.Series) -> int:
        return int(n.sum())

    hit = (F.col("relevance") == 1).cast("int")
    slices = t.judgments("source").groupBy("topic_id", F.pmod(F.xxhash64("pid"), F.lit(64)).alias("slice"))
    return slices.agg(F.sum(hit).alias("n")).groupBy("topic_id").agg(total("n").alias("rel_count"))


class Median:
    """The median of a column of whole numbers, from how often each occurs."""

    def init(self):
        return Counter()

    def update(self, state, rows):
        state.update(rows.iloc[:, 0].dropna().astype(int).tolist())
        return state

    def merge(self, a, b):
        return a + b

    def finish(self, state):
        values, n = sorted(state.items()), sum(state.values())

        def at(place):
            for value, times in values:
                place -= times
                if place < 0:
                    return value

        return None if not n else (at((n - 1) // 2) + at(n // 2)) / 2


class Distinct:
    """How many different values a column has."""

    def init(self):
        return set()

    def update(self, state, rows):
        return state | set(rows.iloc[:, 0].dropna())

    def merge(self, a, b):
        return a | b

    def finish(self, state):
        return len(state)


@query("user_aggregates", f"""
SELECT lang AS topic_id, median(n)::DOUBLE AS median_tokens, count(DISTINCT first) AS first_words
FROM (SELECT lang, len({tokens_sql('text')}) AS n, split_part(text, ' ', 1) AS first FROM documents) GROUP BY lang""")
def user_aggregates(t: Tables) -> DataFrame:
    """Two aggregates a user wrote over rows: a median and a distinct count."""
    rows = t.texts("lang as topic_id").select(
        "topic_id", token_count(F.col("abstract")).alias("n"), F.substring_index("abstract", " ", 1).alias("first"))
    median = aggregate_rows(rows, ["topic_id"], ["n"], Median(), "double", "median_tokens")
    distinct = aggregate_rows(rows, ["topic_id"], ["first"], Distinct(), "bigint", "first_words")
    return median.join(distinct, "topic_id")  # one row per topic


def _texts(t: Tables) -> DataFrame:
    """The balanced corpus with topic, title and abstract in one text."""
    split = balanced_split(t.citations("lang", "toxic"))
    return model_input(split, "topic_id", "title", "abstract")


EPOCHS = 10  # enough for probabilities within 1e-4 of the minimum on these tables, and the same in SQL


def linear_sql(group: str | None, numeric: dict[str, str] | None = None, weighted: bool = False) -> str:
    """The fit of ``linear`` step by step, one set of tables per epoch, then the held-out rows."""
    g = "'*'" if group is None else f"coalesce('=' || {group}, '~')"
    weight = "CASE WHEN relevance = 1 THEN n_neg / CAST(n_pos AS DOUBLE) ELSE 1.0 END" if weighted else "1.0"
    numbers = "".join(f"\n  UNION ALL SELECT is_test, g, topic_id, pid, y, c, chr(9) || '{n}', {e} FROM texts" for n, e in (numeric or {}).items())
    length = " + ".join(["2.0", *[f"pow({e}, 2)" for e in (numeric or {}).values()]])
    parts = [*SCREEN_SQL, f"""class_weights AS (
  SELECT topic_id, count(*) FILTER (WHERE relevance = 0) AS n_neg, count(*) FILTER (WHERE relevance = 1) AS n_pos FROM split GROUP BY topic_id),
texts AS MATERIALIZED (
  SELECT is_test, {g} AS g, s.topic_id, pid, CAST(relevance AS DOUBLE) AS y, {weight} AS c, title, abstract,
         {tokens_sql("lower(concat_ws(' ', s.topic_id, title, abstract))")} AS words
  FROM split s JOIN class_weights w ON s.topic_id = w.topic_id),
terms AS (
  SELECT is_test, g, topic_id, pid, y, c, token, ln(1 + count(*)) AS v
  FROM (SELECT is_test, g, topic_id, pid, y, c, unnest(words) AS token FROM texts) GROUP BY ALL),
cells AS MATERIALIZED (
  SELECT is_test, g, topic_id, pid, y, c, token, v / sqrt(sum(v * v) OVER (PARTITION BY g, pid)) AS v FROM terms
  UNION ALL SELECT is_test, g, topic_id, pid, y, c, '', 1.0 FROM texts{numbers}),
groups AS MATERIALIZED (SELECT g, count(*) AS n, avg(c * ({length})) / 4 + {linear.PENALTY} AS curve FROM texts WHERE NOT is_test GROUP BY g),
s0 AS (SELECT DISTINCT g, token, CAST(0 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS step, CAST(0 AS DOUBLE) AS gradient FROM cells WHERE NOT is_test)"""]
    for k in range(EPOCHS):
        parts.append(f"""r{k} AS MATERIALIZED (
  SELECT g, pid, any_value(c) * (1 / (1 + exp(-sum(v * w))) - any_value(y)) AS r FROM cells JOIN s{k} USING (g, token) WHERE NOT is_test GROUP BY g, pid),
t{k} AS MATERIALIZED (
  SELECT s.g, token, w, step, gradient AS old, pull / n + {linear.PENALTY} * w AS gradient, curve
  FROM s{k} s JOIN (SELECT g, token, sum(v * r) AS pull FROM cells JOIN r{k} USING (g, pid) WHERE NOT is_test GROUP BY g, token) USING (g, token)
  JOIN groups o ON o.g = s.g),
a{k} AS MATERIALIZED (
  SELECT g, CASE WHEN sum(step * (gradient - old)) > 0 THEN sum(step * step) / sum(step * (gradient - old)) ELSE 1 / max(curve) END AS rate
  FROM t{k} GROUP BY g),
s{k + 1} AS MATERIALIZED (SELECT g, token, w - rate * gradient AS w, -rate * gradient AS step, gradient FROM t{k} JOIN a{k} USING (g))""")
    parts.append(f"""fitted AS (
  SELECT topic_id, pid, any_value(y) AS y, 1 / (1 + exp(-sum(v * coalesce(w, 0)))) AS prob
  FROM cells LEFT JOIN s{EPOCHS} USING (g, token) WHERE is_test GROUP BY topic_id, pid)""")
    return with_sql(parts, """SELECT topic_id, pid, CAST(y AS INTEGER) AS label, round(prob, 4) AS prob,
  CASE WHEN prob >= 0.5 THEN 'Relevant' ELSE 'Irrelevant' END AS verdict FROM fitted""")


def _judged(scored: DataFrame) -> DataFrame:
    return scored.select(
        "topic_id", "pid", F.col("relevance").alias("label"), rounded("prob", 4).alias("prob"), L.verdict(F.col("prob")).alias("verdict")
    )


@query("pooled_model", linear_sql(None, weighted=True))
def pooled_model(t: Tables) -> DataFrame:
    """One logistic regression for all topics, topic text included, weighted by class."""
    rows = _texts(t)
    weights = class_weight(rows).select("topic_id", "pos_weight")
    weighted = lookup(rows.filter("not is_test"), weights, ["topic_id"], "inner").withColumn(
        "w", F.when(F.col("relevance") == 1, F.col("pos_weight")).otherwise(1.0)
    )
    fitted = linear.fit(weighted, group=None, weight="w", epochs=EPOCHS, tolerance=0)
    return _judged(linear.score(rows.filter("is_test"), fitted, group=None, carry=["relevance"]))


@query("topic_linear_models", linear_sql("s.topic_id"))
def topic_linear_models(t: Tables) -> DataFrame:
    """One logistic regression per topic, all in one fit, saved and loaded again."""
    rows = _texts(t)
    store = new_dir(t.spark, "linear-models")
    linear.save(linear.fit(rows.filter("not is_test"), epochs=EPOCHS, tolerance=0), store)
    return _judged(linear.score(rows.filter("is_test"), linear.load(t.spark, store), carry=["relevance"]))


@query("numeric_features", linear_sql(None, {
    "title_n": f"ln(1 + len({tokens_sql('title')})) / 10", "abstract_n": f"ln(1 + len({tokens_sql('abstract')})) / 10"}))
def numeric_features(t: Tables) -> DataFrame:
    """Text plus two numbers: how long title and abstract are."""
    length = lambda c: F.log1p(token_count(F.col(c)).cast("double")) / 10
    rows = _texts(t).withColumns({"title_n": length("title"), "abstract_n": length("abstract")})
    numeric = ["title_n", "abstract_n"]
    fitted = linear.fit(rows.filter("not is_test"), group=None, numeric=numeric, epochs=EPOCHS, tolerance=0)
    return _judged(linear.score(rows.filter("is_test"), fitted, group=None, numeric=numeric, carry=["relevance"]))
