"""Attributions, top words, nested results and reviewer verdicts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions.text import list_label, tokens
from sieve.operators import attribution as A
from sieve.operators import results as R
from sieve.operators.corpus import model_input
from sieve.operators.model import verdict
from sieve.operators.ranking import ranked
from sieve.plans.explaining import readable
from sieve.plans.screening import screen
from sieve.queries.base import (
    ARTICLES_SQL, LONG_SQL, SCORE_SQL, TOKEN_SQL, TRAIN_SQL, VERDICTS_SQL, Tables, query, rounded,
    tokens_sql, with_sql,
)
from sieve.streaming.verdicts import latest_verdicts, open_verdicts

LATIN = "regexp_matches(token, '[a-zA-Z]')"
FIELD_NO = "CASE WHEN field = 'title' THEN 0 ELSE 1 END"


def micro(value: Column) -> Column:
    """A score as a whole number of millionths, for lists compared as text."""
    return F.round(value * 1000000).cast("bigint").cast("string")


def listed(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["token"], F.lit("="), micro(p["value"]))), " ")


MICRO_SQL = "CAST(CAST(round({v} * 1000000) AS BIGINT) AS VARCHAR)"
LISTED_SQL = f"token || '=' || {MICRO_SQL.format(v='value')}"


@query("attributions", with_sql([*TRAIN_SQL, LONG_SQL], """
SELECT topic_id, pid, field, pos, token, round(value, 6) AS value FROM attributions"""))
def attributions(t: Tables) -> DataFrame:
    s = screen(t.citations())
    return A.attributions(s.test, s.model).withColumn("value", rounded("value"))


@query("background_attributions", with_sql([*TRAIN_SQL, f"""background AS (
  SELECT topic_id, unnest(list_concat({tokens_sql('lower(title)')}, {tokens_sql('lower(abstract)')})) AS token, n_docs
  FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY md5('42:background:' || pid), pid) AS rn,
               least(count(*) OVER (PARTITION BY topic_id), 100) AS n_docs FROM split WHERE NOT is_test) WHERE rn <= 100),
means AS (SELECT topic_id, token, count(*) / CAST(any_value(n_docs) AS DOUBLE) AS mean FROM background GROUP BY topic_id, token),
base AS (
  SELECT w.topic_id, w.token, weight, weight * coalesce(mean, 0) AS base
  FROM weights w LEFT JOIN means m ON w.topic_id = m.topic_id AND w.token = m.token),
terms AS (
  SELECT topic_id, pid, token, count(*) AS n FROM (
    SELECT topic_id, pid, unnest(list_concat({tokens_sql('lower(title)')}, {tokens_sql('lower(abstract)')})) AS token
    FROM split WHERE is_test) GROUP BY topic_id, pid, token),
valued AS (
  SELECT t.topic_id, t.pid, t.token, n, coalesce(weight, 0) * n - coalesce(base, 0) AS value, coalesce(base, 0) AS base
  FROM terms t LEFT JOIN base b ON t.topic_id = b.topic_id AND t.token = b.token)"""], """
SELECT topic_id, pid, token, n, round(value, 8) AS value FROM valued
UNION ALL
SELECT v.topic_id, pid, NULL, 0, round(sum(base) - any_value(whole), 8)
FROM valued v JOIN (SELECT topic_id, sum(base) AS whole FROM base GROUP BY topic_id) b ON v.topic_id = b.topic_id
GROUP BY v.topic_id, pid"""))
def background_attributions(t: Tables) -> DataFrame:
    s = screen(t.citations())
    return A.background_attributions(s.test, s.model, s.train).withColumn("value", rounded("value", 8))


def _long_word_score():
    """A user's scoring function over texts.

    ``Series.str`` stays with its series in a cycle, so that every batch of texts would lie in the Python process
    until a late collection of garbage; ``map`` leaves none.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        import re

        import numpy as np

        def count(pattern: str) -> np.ndarray:
            find = re.compile(pattern).findall
            return texts.map(lambda text: len(find(text)), na_action="ignore").to_numpy(dtype="float64")

        n, n_long = count("[^ ]+"), count("[^ ]{7,}")
        return pd.Series(1 / (1 + np.exp(-(3.0 * n_long - n) / (n + 1.0))))

    return score


@query("sampled_attributions", with_sql(ARTICLES_SQL, f"""
SELECT topic_id, pid, CAST(ceil(n / ceil(n / 8.0)) AS BIGINT) AS n_parts, n AS n_tokens,
       round(1 / (1 + exp(-(3.0 * n_long - n) / (n + 1.0))) - 0.5, 6) AS total
FROM (SELECT lang AS topic_id, pid, len({tokens_sql('abstract')}) AS n,
             len(list_filter({tokens_sql('abstract')}, lambda w: length(w) > 6)) AS n_long FROM articles)
WHERE n > 0"""))
def sampled_attributions(t: Tables) -> DataFrame:
    """A user's scoring function sees texts only; the parts add up to f(text) - f(empty)."""

    rows = model_input(t.texts("lang as topic_id"), "abstract")
    parts = A.sampled_attributions(rows, _long_word_score(), permutations=2, groups=8)
    return parts.groupBy("topic_id", "pid").agg(
        F.count("*").alias("n_parts"), F.sum(F.size("tokens")).alias("n_tokens"), rounded(F.sum("value")).alias("total")
    )


_ROUNDS, _WIDTH = 4, 2


def _run_values_sql() -> str:
    """The halving of runs, one set of tables per round."""
    f = lambda n, long: f"1 / (1 + exp(-(3.0 * ({long}) - ({n})) / (({n}) + 1.0)))"
    parts = [ARTICLES_SQL, f"""words AS MATERIALIZED (
  SELECT lang AS topic_id, pid, {tokens_sql('abstract')} AS w FROM articles WHERE len({tokens_sql('abstract')}) > 0),
sums AS MATERIALIZED (SELECT topic_id, pid, w, len(w) AS n, list_transform(w, lambda x: CASE WHEN length(x) > 6 THEN 1 ELSE 0 END) AS l FROM words),
ends AS MATERIALIZED (SELECT topic_id, pid, n, l, list_sum(l) AS t, {f("n", "list_sum(l)")} AS f1, {f("0", "0")} AS f0 FROM sums),
r0 AS (SELECT pid, 0 AS lo, n AS hi, f1 - f0 AS value, f1 AS alone, f0 AS without FROM ends)"""]
    for k in range(_ROUNDS):
        parts.append(f"""o{k} AS MATERIALIZED (
  SELECT *, CASE WHEN hi - lo > 1 THEN row_number() OVER (PARTITION BY pid, hi - lo > 1 ORDER BY round(abs(value), 9) DESC, lo) END AS place FROM r{k}),
h{k} AS MATERIALIZED (
  SELECT o.*, (lo + hi) // 2 AS mid, n, t, f0, f1, coalesce(list_sum(l[lo + 1 : (lo + hi) // 2]), 0) AS la,
         coalesce(list_sum(l[(lo + hi) // 2 + 1 : hi]), 0) AS lb FROM o{k} o JOIN ends USING (pid) WHERE place <= {_WIDTH}),
s{k} AS MATERIALIZED (
  SELECT *, {f("mid - lo", "la")} AS a, {f("hi - mid", "lb")} AS b, {f("n - mid + lo", "t - la")} AS no_a, {f("n - hi + mid", "t - lb")} AS no_b FROM h{k}),
v{k} AS MATERIALIZED (
  SELECT *, ((a - f0) + (alone - b) + (no_b - without) + (f1 - no_a)) / 4 AS x, ((b - f0) + (alone - a) + (no_a - without) + (f1 - no_b)) / 4 AS y FROM s{k}),
r{k + 1} AS MATERIALIZED (
  SELECT pid, lo, hi, value, alone, without FROM o{k} WHERE place IS NULL OR place > {_WIDTH}
  UNION ALL SELECT pid, lo, mid, x + (value - x - y) / 2, a, no_a FROM v{k}
  UNION ALL SELECT pid, mid, hi, y + (value - x - y) / 2, b, no_b FROM v{k})""")
    return with_sql(parts, f"""SELECT topic_id, pid, CAST(lo AS BIGINT) AS first_pos, CAST(hi - lo AS BIGINT) AS n_tokens, round(value, 6) AS value,
  md5(array_to_string(w[lo + 1 : hi], ' ')) AS tokens_md5 FROM r{_ROUNDS} JOIN words USING (pid)""")


@query("run_attributions", _run_values_sql())
def run_attributions(t: Tables) -> DataFrame:
    """What runs of tokens add to a user's score; taken apart into tokens and put together again."""
    rows = model_input(t.texts("lang as topic_id"), "abstract")
    runs = A.run_attributions(rows, _long_word_score(), _ROUNDS, _WIDTH)
    return runs.select(
        "topic_id", "pid", F.col("lo").cast("bigint").alias("first_pos"), (F.col("hi") - F.col("lo")).cast("bigint").alias("n_tokens"),
        rounded("value").alias("value"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"),
    )


# Explanations whose shape depends on the language, to meet every rule for class names.
_CLASSES = {
    "en": ("Irrelevant", "Relevant"), "de": ("LABEL_0", "LABEL_1"), "fr": ("first", "second"), "es": ("a", "b", "c"),
}


def _classes(topic: str) -> Column:
    cases = F.lit(None).cast("array<string>")
    for lang, names in _CLASSES.items():
        cases = F.when(F.col(topic) == lang, F.array(*[F.lit(n) for n in names])).otherwise(cases)
    return cases


@query("class_index", """
SELECT CAST(doc_id AS VARCHAR) AS pid, CASE WHEN lang IN ('en', 'de', 'fr') THEN 1 END AS relevant_index,
       CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 1 END AS irrelevant_index
FROM documents""")
def class_index(t: Tables) -> DataFrame:
    rows = t.articles("lang").withColumn("classes", _classes("lang"))
    return rows.select(
        "pid", (R.class_index(F.col("classes")) - 1).alias("relevant_index"),
        (R.class_index(F.col("classes"), "Irrelevant") - 1).alias("irrelevant_index"),
    )


@query("explanation_checks", f"""
WITH raw AS (
  SELECT CAST(doc_id AS VARCHAR) AS pid, lang, n_chars, split_part(text, chr(10), 1) AS title,
         CASE WHEN n_chars >= 100 THEN text END AS abstract FROM documents),
lists AS (
  SELECT *, regexp_extract_all(title, '{TOKEN_SQL}', 1) AS tt, regexp_extract_all(coalesce(abstract, ''), '{TOKEN_SQL}', 1) AS aa
  FROM raw)
SELECT pid, CASE WHEN n_chars < 200 THEN 'N/A' ELSE title END AS title, length(coalesce(abstract, '')) AS abstract_length,
       CASE WHEN n_chars < 300 THEN 'N/A' ELSE lang END AS verdict,
       CASE WHEN lang = 'es' OR n_chars < 400 THEN '' ELSE array_to_string(list_transform(tt,
         lambda w: w || '=' || CAST(length(w) * 100000 AS VARCHAR)), ' ') END AS title_parts,
       CASE WHEN lang = 'es' OR n_chars < 100 THEN '' ELSE array_to_string(list_transform(aa,
         lambda w: w || '=' || CASE WHEN length(w) > 7 THEN '0' ELSE CAST(length(w) * 100000 AS VARCHAR) END), ' ') END AS abstract_parts
FROM lists""")
def explanation_checks(t: Tables) -> DataFrame:
    """Titles of short texts have one score too many, long words of abstracts no score for the class."""
    value = lambda w: F.length(w) / 10.0
    pair = lambda w: F.array(-value(w), value(w), F.lit(0.0))
    title, abstract = tokens(F.col("title")), tokens(F.col("abstract"))
    n = F.col("n_chars")
    rows = t.texts("lang", "n_chars").withColumn("abstract", F.when(n >= 100, F.col("abstract")))
    title_scores = F.transform(title, pair)
    raw = rows.select(
        "pid", F.when(n >= 200, F.col("title")).alias("title"), "abstract", F.when(n >= 300, F.col("lang")).alias("verdict"),
        F.struct(
            title.alias("tokens"),
            F.when(n < 400, F.concat(title_scores, F.array(F.array(F.lit(0.0))))).otherwise(title_scores).alias("scores"),
            _classes("lang").alias("classes"),
        ).alias("title_expl"),
        F.when(
            F.col("abstract").isNotNull(),
            F.struct(
                abstract.alias("tokens"),
                F.transform(abstract, lambda w: F.when(F.length(w) > 7, F.array(F.lit(9.0))).otherwise(pair(w))).alias("scores"),
                _classes("lang").alias("classes"),
            ),
        ).alias("abstract_expl"),
    )
    shaped = R.article_results(raw)
    return shaped.select(
        "pid", "title", F.length("abstract").alias("abstract_length"), "verdict",
        listed(F.col("explained_title_parts")).alias("title_parts"),
        listed(F.col("explained_abstract_parts")).alias("abstract_parts"),
    )


TOP_WORDS_SQL = f"""keyed AS (
  SELECT a.topic_id, a.pid, verdict, token, value, {FIELD_NO} AS field_no, pos,
         CASE verdict WHEN 'Relevant' THEN -value WHEN 'Irrelevant' THEN value ELSE -abs(value) END AS key
  FROM attributions a JOIN verdicts v ON a.topic_id = v.topic_id AND a.pid = v.pid WHERE {LATIN}),
spelt AS (
  SELECT *, row_number() OVER (PARTITION BY topic_id, pid, lower(token) ORDER BY key, field_no, pos) AS copy FROM keyed),
top_words AS (
  SELECT topic_id, pid, verdict, row_number() OVER (PARTITION BY topic_id, pid ORDER BY key, field_no, pos) AS rank, token, value
  FROM spelt WHERE copy = 1 QUALIFY rank <= 5)"""


@query("top_words", with_sql([*SCORE_SQL, VERDICTS_SQL, TOP_WORDS_SQL], """
SELECT topic_id, pid, verdict, rank, token, round(value, 6) AS value FROM top_words"""))
def top_words(t: Tables) -> DataFrame:
    s = screen(t.citations())
    return A.top_words(A.judged_tokens(s.test, s.model)).withColumn("value", rounded("value"))


@query("top_abs_words", with_sql(SCORE_SQL, f"""
SELECT topic_id, pid, row_number() OVER (PARTITION BY topic_id, pid ORDER BY abs(value) DESC, {FIELD_NO}, pos) AS rank,
       token, round(value, 6) AS value
FROM attributions QUALIFY rank <= 5"""))
def top_abs_words(t: Tables) -> DataFrame:
    s = screen(t.citations())
    return A.top_contributions(A.attributions(s.test, s.model)).withColumn("value", rounded("value"))


@query("highlight", with_sql(SCORE_SQL, """
SELECT topic_id, pid, field, pos, token, CASE WHEN value > 0 THEN 'darkred' ELSE 'darkgreen' END AS word_colour,
       CASE WHEN value > 0.001 THEN 'red' WHEN value < -0.001 THEN 'green' ELSE 'transparent' END AS colour,
       CASE WHEN abs(value) <= 0.001 THEN 0 ELSE round(least(abs(value) / 0.5, 1) * 0.6 + 0.1, 6) END AS alpha
FROM attributions"""))
def highlight(t: Tables) -> DataFrame:
    s = screen(t.citations())
    value = F.col("value")
    return A.attributions(s.test, s.model).select(
        "topic_id", "pid", "field", "pos", "token", R.word_colour(value).alias("word_colour"),
        R.highlight(value)["colour"].alias("colour"), rounded(R.highlight(value)["alpha"]).alias("alpha"),
    )


@query("rebuild_text", with_sql(ARTICLES_SQL, f"""
SELECT pid, CASE WHEN len(tt) = 0 THEN 'Abstract not available.' ELSE array_to_string(list_transform(tt, lambda w, i:
         CASE WHEN i > 1 AND regexp_matches(w, '^[A-Za-z0-9_]') THEN ' ' || w ELSE w END), '') END AS text
FROM (SELECT pid, {tokens_sql("abstract")} AS tt FROM articles
      UNION ALL SELECT 'empty ' || pid, {tokens_sql("''")} FROM articles WHERE lang = 'fr')"""))
def rebuild_text(t: Tables) -> DataFrame:
    """All texts, and an empty one beside each French one."""
    rows = t.texts("lang")
    none = rows.filter("lang = 'fr'").select(F.concat(F.lit("empty "), "pid").alias("pid"), F.lit("").alias("abstract"))
    parts = F.transform(tokens(F.col("abstract")), lambda w: F.struct(w.alias("token"), F.lit(0.0).alias("value")))
    rebuilt = R.rebuilt_text(F.col("parts"), F.lit("Abstract not available."))
    return rows.select("pid", "abstract").union(none).withColumn("parts", parts).select("pid", rebuilt.alias("text"))


@query("display", with_sql([*SCORE_SQL, VERDICTS_SQL], """
SELECT v.topic_id, v.pid, CASE WHEN length(title) > 70 THEN left(title, 70) || '...' ELSE title END AS label,
       'Article ' || row_number() OVER (PARTITION BY v.topic_id ORDER BY v.pid) AS fallback, verdict AS shown,
       CASE verdict WHEN 'Relevant' THEN 'Irrelevant' WHEN 'Irrelevant' THEN 'Relevant' ELSE verdict END AS shown_inverted,
       CASE verdict WHEN 'Relevant' THEN 'green' ELSE 'red' END AS colour
FROM verdicts v JOIN split s ON v.topic_id = s.topic_id AND v.pid = s.pid"""))
def display(t: Tables) -> DataFrame:
    s = screen(t.citations())
    shown = s.predictions().select("topic_id", "pid", verdict(F.col("prob")).alias("verdict"))
    rows = ranked(s.test.select("topic_id", "pid", "title"), ["pid"], ["topic_id"], "position")
    none = F.lit(None).cast("string")
    return rows.join(shown, ["topic_id", "pid"]).select(
        "topic_id", "pid", list_label(F.col("title"), F.col("position")).alias("label"),
        list_label(none, F.col("position")).alias("fallback"),
        R.shown_verdict(F.col("verdict")).alias("shown"),
        R.shown_verdict(F.col("verdict"), invert=True).alias("shown_inverted"),
        R.verdict_colour(F.col("verdict")).alias("colour"),
    )


@query("topic_result", with_sql([*SCORE_SQL, VERDICTS_SQL, TOP_WORDS_SQL, f"""words AS (
  SELECT topic_id, pid, string_agg({LISTED_SQL}, ' ' ORDER BY rank) AS top FROM top_words GROUP BY topic_id, pid),
parts AS (
  SELECT topic_id, pid, string_agg({LISTED_SQL}, ' ' ORDER BY pos) FILTER (WHERE field = 'title') AS title_parts,
         string_agg({LISTED_SQL}, ' ' ORDER BY pos) FILTER (WHERE field = 'abstract') AS abstract_parts
  FROM attributions GROUP BY topic_id, pid),
placed AS (
  SELECT v.*, s.title, s.abstract, row_number() OVER (PARTITION BY v.topic_id ORDER BY v.pid) - 1 AS position
  FROM verdicts v JOIN split s ON v.topic_id = s.topic_id AND v.pid = s.pid)"""], """
SELECT p.topic_id AS topic_name, position // 15 AS page, count(*) AS n_articles,
       string_agg(concat_ws('|', title, length(abstract), verdict, coalesce(title_parts, ''), md5(coalesce(abstract_parts, '')),
                            coalesce(top, '')), chr(10) ORDER BY position) AS articles
FROM placed p LEFT JOIN words w ON p.topic_id = w.topic_id AND p.pid = w.pid
LEFT JOIN parts a ON p.topic_id = a.topic_id AND p.pid = a.pid GROUP BY p.topic_id, position // 15"""))
def topic_result(t: Tables) -> DataFrame:
    s = screen(t.citations())
    places = ranked(s.test.select("topic_id", "pid"), ["pid"], ["topic_id"], "position")
    places = places.withColumn("position", F.col("position") - 1)
    pages = R.topic_pages(readable(s.test, s.model).join(places, ["topic_id", "pid"]))
    line = lambda a: F.concat_ws(
        "|", a["title"], F.length(a["abstract"]).cast("string"), a["verdict"], listed(a["explained_title_parts"]),
        F.md5(listed(a["explained_abstract_parts"])), listed(a["top_words"]),
    )
    return pages.select(
        "topic_name", "page", F.size("articles").cast("bigint").alias("n_articles"),
        F.array_join(F.transform("articles", line), "\n").alias("articles"),
    )


@query("topic_json", with_sql([*SCORE_SQL, VERDICTS_SQL, TOP_WORDS_SQL, """placed AS (
  SELECT v.topic_id, v.pid, verdict, title, abstract, row_number() OVER (PARTITION BY v.topic_id ORDER BY v.pid) - 1 AS position
  FROM verdicts v JOIN split s ON v.topic_id = s.topic_id AND v.pid = s.pid)"""], """
SELECT topic_id AS topic_name, position // 15 AS page, position % 15 AS place, p.pid, title, md5(abstract) AS abstract_md5, verdict, token AS top_word
FROM placed p LEFT JOIN (SELECT topic_id, pid, token FROM top_words WHERE rank = 1) USING (topic_id, pid)"""))
def topic_json(t: Tables) -> DataFrame:
    """Every article read back from the JSON of its topic's page."""
    s = screen(t.citations())
    places = ranked(s.test.select("topic_id", "pid"), ["pid"], ["topic_id"], "position").withColumn("position", F.col("position") - 1)
    pages = R.topic_pages(readable(s.test, s.model).join(places, ["topic_id", "pid"]))
    article = "struct<title: string, abstract: string, verdict: string, top_words: array<struct<token: string, value: double>>>"
    back = pages.select("page", F.from_json("json", f"topic_name string, articles array<{article}>").alias("r"))
    each = back.select(F.col("r.topic_name").alias("topic_id"), "page", F.posexplode("r.articles").alias("place", "a"))
    each = each.withColumn("position", F.col("page") * 15 + F.col("place")).join(places, ["topic_id", "position"])
    return each.select(
        F.col("topic_id").alias("topic_name"), "page", F.col("place").cast("bigint").alias("place"), "pid", "a.title", F.md5("a.abstract").alias("abstract_md5"),
        "a.verdict", F.get("a.top_words", F.lit(0))["token"].alias("top_word"),
    )


def verdict_events(t: Tables) -> DataFrame:
    return t.table("events").selectExpr(
        "cast(user_id as string) as article_id", "event_type as verdict", "ts", "event_id"
    )


LATEST_SQL = """
SELECT CAST(user_id AS VARCHAR) AS article_id, event_type AS verdict, event_id FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""


@query("latest_verdict", LATEST_SQL)
def latest_verdict(t: Tables) -> DataFrame:
    return latest_verdicts(verdict_events(t), ["article_id"]).drop("ts")


@query("open_verdicts", """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS reviewer, event_type AS topic_id, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS article_id,
         CASE WHEN value >= 50 THEN 'Relevant' ELSE 'Irrelevant' END AS verdict, ts, event_id FROM events),
marked AS (SELECT *, lag(topic_id) OVER (PARTITION BY reviewer ORDER BY ts, event_id) AS previous FROM e),
stays AS (
  SELECT *, sum(CASE WHEN previous IS DISTINCT FROM topic_id THEN 1 ELSE 0 END)
            OVER (PARTITION BY reviewer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stay FROM marked)
SELECT reviewer, topic_id, article_id, verdict, event_id FROM stays
QUALIFY stay = max(stay) OVER (PARTITION BY reviewer)
  AND row_number() OVER (PARTITION BY reviewer, stay, article_id ORDER BY ts DESC, event_id DESC) = 1""")
def open_verdicts_query(t: Tables) -> DataFrame:
    events = t.table("events").selectExpr(
        "cast(user_id as string) as reviewer", "event_type as topic_id",
        "cast(cast(floor(value / 10) as bigint) as string) as article_id",
        "case when value >= 50 then 'Relevant' else 'Irrelevant' end as verdict", "ts", "event_id",
    )
    return open_verdicts(events).drop("ts")
