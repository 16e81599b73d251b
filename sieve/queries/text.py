"""Text functions, tokens, vocabulary and encodings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions import text as X
from sieve.functions.table_functions import parted, register
from sieve.operators import encoding as E
from sieve.operators.corpus import model_input, screenable
from sieve.operators.profile import length_percentiles
from sieve.operators.ranking import batched
from sieve.operators.spool import spool
from sieve.queries.base import ARTICLES_SQL, Tables, citations_sql, query, rounded, tokens_sql, with_sql

VOCABULARY_SQL = f"""words AS (
  SELECT unnest(list_concat({tokens_sql('lower(title)')}, {tokens_sql('lower(abstract)')})) AS token FROM articles),
vocabulary AS (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id
  FROM (SELECT token, count(*) AS n FROM words GROUP BY token HAVING count(*) >= 10))"""


@query("model_input", """
WITH rows AS (
  SELECT CAST(doc_id AS VARCHAR) AS pid, split_part(text, chr(10), 1) AS title, '  ' || text || chr(9) || ' ' AS abstract FROM documents
  UNION ALL SELECT 'untitled ' || doc_id, NULL, '  ' || text || chr(9) || ' ' FROM documents WHERE n_chars < 200
  UNION ALL SELECT 'bare ' || doc_id, split_part(text, chr(10), 1), NULL FROM documents WHERE n_chars < 200
  UNION ALL SELECT 'nothing ' || doc_id, NULL, NULL FROM documents WHERE n_chars < 200)
SELECT pid, md5(trim(concat(coalesce(title, ''), ' ', coalesce(abstract, '')), chr(9) || ' ')) AS text_md5,
       md5(concat_ws(' ', title, abstract)) AS joined_md5, md5(coalesce(title, 'nan') || ' ' || coalesce(abstract, 'nan')) AS printed_md5
FROM rows WHERE trim(concat(coalesce(title, ''), ' ', coalesce(abstract, '')), chr(9) || ' ') <> ''""")
def model_input_query(t: Tables) -> DataFrame:
    """All articles, and beside each short one its parts without the others."""
    rows = t.articles("n_chars").withColumn("abstract", F.concat(F.lit("  "), "abstract", F.lit("\t ")))
    short, none = rows.filter("n_chars < 200"), F.lit(None).cast("string")
    named = lambda word, **columns: short.withColumns({"pid": F.concat(F.lit(f"{word} "), "pid"), **columns})
    for more in (named("untitled", title=none), named("bare", abstract=none), named("nothing", title=none, abstract=none)):
        rows = rows.union(more)
    rows = model_input(rows, "title", "abstract", name="joined")
    rows = model_input(rows, "title", "abstract", name="printed", null_as="nan")
    return screenable(rows).select(
        "pid", F.md5("text").alias("text_md5"), F.md5("joined").alias("joined_md5"), F.md5("printed").alias("printed_md5")
    )


@query("scalar_text", r"""
SELECT page_id, split_part(url, '/', 3) AS host, split_part(url, '/', -1) AS last_part,
       starts_with(url, 'https:') AS is_https,
       CASE WHEN starts_with(url, 'http://') THEN trim(substr(url, 8)) END AS after_http,
       ends_with(url, '_source=feed') OR ends_with(url, '.html') AS has_suffix,
       replace(url, '/', ' ') AS spaced, split_part(url, '_', 1) AS base,
       lower(url) AS lowered, regexp_matches(split_part(url, '/', -1), '[a-zA-Z]') AS has_letter,
       CASE WHEN length(html) > 70 THEN left(html, 70) || '...' ELSE html END AS short_html,
       regexp_replace(html, '</?[A-Za-z][^<>]*>', '', 'g') AS plain
FROM pages""")
def scalar_text(t: Tables) -> DataFrame:
    url, html = F.col("url"), F.col("html")
    return t.table("pages").select(
        "page_id",
        X.path_part(url, 3).alias("host"),
        X.path_part(url, -1).alias("last_part"),
        url.startswith("https:").alias("is_https"),
        X.after_prefix(url, "http://").alias("after_http"),
        X.has_suffix(url, ["_source=feed", ".html"]).alias("has_suffix"),
        F.array_join(F.split(url, "/"), " ").alias("spaced"),
        X.base_id(url).alias("base"),
        F.lower(url).alias("lowered"),
        X.is_word(X.path_part(url, -1)).alias("has_letter"),
        X.abbreviate(html).alias("short_html"),
        F.regexp_replace(html, "</?[A-Za-z][^<>]*>", "").alias("plain"),
    )


@query("token_lengths", with_sql(ARTICLES_SQL, f"""
SELECT lang AS topic_id, part, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.75), 6) AS p75,
       round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.95), 6) AS p95
FROM (
  SELECT lang, 'title' AS part, len({tokens_sql('title')}) AS n FROM articles
  UNION ALL SELECT lang, 'abstract', len({tokens_sql('abstract')}) FROM articles
  UNION ALL SELECT lang, 'total', len({tokens_sql('title')}) FROM articles
  UNION ALL SELECT lang, 'total', len({tokens_sql('abstract')}) FROM articles)
GROUP BY lang, part"""))
def token_lengths(t: Tables) -> DataFrame:
    found = length_percentiles(t.texts("lang as topic_id"))
    return found.select("topic_id", "part", *[rounded(c).alias(c) for c in ("p50", "p75", "p90", "p95")])


@query("vocabulary", with_sql([ARTICLES_SQL, VOCABULARY_SQL], "SELECT token, n, token_id FROM vocabulary"))
def vocabulary(t: Tables) -> DataFrame:
    return E.vocabulary(E.word_counts(t.texts(), "title", "abstract", min_count=10))


@query("largest_vocabulary", with_sql([ARTICLES_SQL, VOCABULARY_SQL], """
SELECT token, n, token_id FROM vocabulary WHERE token_id < 504"""))
def largest_vocabulary(t: Tables) -> DataFrame:
    """From the most frequent words alone; the tail is not counted."""
    return E.vocabulary(E.heaviest_words(t.texts(), "title", "abstract", size=500))


@query("pair_encoding", with_sql([ARTICLES_SQL, VOCABULARY_SQL, citations_sql(), f"""lists AS (
  SELECT topic_id, pid, relevance, {tokens_sql('lower(title)')} AS tt, {tokens_sql('lower(abstract)')} AS aa FROM citations),
sizes AS (
  SELECT *, CASE WHEN len(tt) + len(aa) <= 347 THEN len(tt) ELSE least(len(tt), greatest(174, 347 - len(aa))) END AS kt FROM lists),
cut AS (
  SELECT *, CASE WHEN len(tt) + len(aa) <= 347 THEN len(aa) ELSE 347 - kt END AS ka FROM sizes),
flat AS (
  SELECT topic_id, pid, unnest(list_concat(tt[1:kt], ['[SEP]'], aa[1:ka])) AS token,
         generate_subscripts(list_concat(tt[1:kt], ['[SEP]'], aa[1:ka]), 1) AS i FROM cut),
coded AS (
  SELECT topic_id, pid, list(CASE WHEN f.token = '[SEP]' THEN 3 ELSE coalesce(token_id, 1) END ORDER BY i) AS ids
  FROM flat f LEFT JOIN vocabulary v ON f.token = v.token GROUP BY topic_id, pid)"""], """
SELECT c.topic_id, c.pid, CAST(relevance AS FLOAT) AS label,
       array_to_string(list_concat([2], ids, [3], list_transform(range(347 - kt - ka), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_transform(range(350), lambda i: CASE WHEN i < kt + ka + 3 THEN 1 ELSE 0 END), ',') AS attention_mask,
       array_to_string(list_transform(range(350), lambda i: CASE WHEN i >= kt + 2 AND i < kt + ka + 3 THEN 1 ELSE 0 END), ',')
         AS token_type_ids
FROM cut c JOIN coded k ON c.topic_id = k.topic_id AND c.pid = k.pid"""))
def pair_encoding(t: Tables) -> DataFrame:
    vocab = E.vocabulary(E.word_counts(t.texts(), "title", "abstract", min_count=10))
    encoded = E.encode_pairs(t.citations(), vocab, 350)
    lists = ("input_ids", "attention_mask", "token_type_ids")
    return encoded.select("topic_id", "pid", "label", *[F.array_join(c, ",").alias(c) for c in lists])


@query("single_encoding", with_sql([ARTICLES_SQL, VOCABULARY_SQL, f"""lists AS (
  SELECT lang AS topic_id, pid, ({tokens_sql("lower(lang || ' ' || source || ' ' || title || ' ' || abstract)")})[1:126] AS tt
  FROM articles),
flat AS (SELECT topic_id, pid, unnest(tt) AS token, generate_subscripts(tt, 1) AS i FROM lists),
coded AS (
  SELECT topic_id, pid, list(coalesce(token_id, 1) ORDER BY i) AS ids, count(*) AS k
  FROM flat f LEFT JOIN vocabulary v ON f.token = v.token GROUP BY topic_id, pid)"""], """
SELECT topic_id, pid,
       array_to_string(list_concat([2], ids, [3], list_transform(range(126 - k), lambda x: 0)), ',') AS input_ids,
       array_to_string(list_transform(range(128), lambda i: CASE WHEN i < k + 2 THEN 1 ELSE 0 END), ',') AS attention_mask
FROM coded"""))
def single_encoding(t: Tables) -> DataFrame:
    vocab = E.vocabulary(E.word_counts(t.texts(), "title", "abstract", min_count=10))
    rows = model_input(t.texts("lang as topic_id", "source"), "topic_id", "source", "title", "abstract")
    encoded = E.encode_texts(rows, vocab, 128)
    return encoded.select("topic_id", "pid", *[F.array_join(c, ",").alias(c) for c in ("input_ids", "attention_mask")])


@query("batch_offsets", with_sql([citations_sql(), f"""placed AS (
  SELECT topic_id, pid, relevance, list_concat({tokens_sql('title')}, {tokens_sql('abstract')}) AS tt,
         row_number() OVER (PARTITION BY topic_id ORDER BY md5('42:' || pid), pid) - 1 AS k FROM citations),
sized AS (
  SELECT *, k // 16 AS batch_id, coalesce(CAST(sum(len(tt)) OVER (
           PARTITION BY topic_id, k // 16 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS o
  FROM placed)"""], """
SELECT topic_id, batch_id, string_agg(CAST(relevance AS VARCHAR), ',' ORDER BY k) AS labels,
       array_to_string(flatten(list(tt ORDER BY k)), ' ') AS tokens, string_agg(CAST(o AS VARCHAR), ',' ORDER BY k) AS offsets
FROM sized GROUP BY topic_id, batch_id"""))
def batch_offsets(t: Tables) -> DataFrame:
    ids = batched(t.judgments().select("topic_id", "pid"), 16)
    rows = t.citations().join(ids, ["topic_id", "pid"]).withColumn(
        "tokens", F.concat(X.tokens(F.col("title")), X.tokens(F.col("abstract")))
    )
    flat = E.flat_batches(E.batch_offsets(rows, F.size("tokens")))
    return flat.select(
        "topic_id", "batch_id", F.array_join("labels", ",").alias("labels"),
        F.array_join("tokens", " ").alias("tokens"), F.array_join("offsets", ",").alias("offsets"),
    )


@query("custom_tokenizer", with_sql(ARTICLES_SQL, r"""
SELECT token, count(*) AS n FROM (SELECT unnest(string_split(replace(abstract, chr(10), ' '), ' ')) AS token FROM articles)
GROUP BY token HAVING count(*) >= 20"""))
def custom_tokenizer(t: Tables) -> DataFrame:
    """Any Column to Column function can take the tokenizer's place."""
    by_blank = lambda c: F.split(F.replace(c, F.lit("\n"), F.lit(" ")), " ")
    return E.word_counts(t.texts(), "abstract", min_count=20, tokenizer=by_blank)


@query("table_function", """
SELECT CAST(doc_id AS VARCHAR) AS pid, line_no, md5(line) AS line_md5 FROM (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)""")
def table_function(t: Tables) -> DataFrame:
    """A user's generator, several rows out of one, over Arrow batches of the whole table."""

    def lines(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.assign(line=frame["text"].str.split("\n")).explode("line")
            yield out.assign(line_no=out.groupby(level=0).cumcount() + 1)[["pid", "line_no", "line"]]

    articles = t.articles().select("pid", F.col("abstract").alias("text"))
    found = articles.mapInPandas(lines, "pid string, line_no bigint, line string")
    return found.select("pid", "line_no", F.md5("line").alias("line_md5"))


@query("sql_table_functions", """
WITH lines AS (
  SELECT lang, doc_id, line_no, line FROM (
    SELECT lang, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents))
SELECT lang, CAST(doc_id AS VARCHAR) AS pid, line_no, md5(line) AS line_md5, (place - 1) // 16 AS batch_id, (place - 1) % 16 AS row_in_batch
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(doc_id || ':' || line_no)) AS place FROM lines)""")
def sql_table_functions(t: Tables) -> DataFrame:
    """Lines of all texts by a lateral call, then batches of each language by a call on the table."""
    register(t.spark)
    t.texts("lang").createOrReplaceTempView("sieve_texts")
    lines = t.spark.sql("""
        SELECT lang, pid, line_no, line, md5(concat(pid, ':', line_no)) AS place
        FROM sieve_texts, LATERAL split_text(abstract, chr(10), 'line')""")
    parted(spool(lines, "lines", "zstd").df, "lang", "place").createOrReplaceTempView("sieve_lines")
    found = t.spark.sql("SELECT * FROM numbered_batches(TABLE(sieve_lines), 'lang', 'place', 16, 'part', 'before')")
    return found.select("lang", "pid", "line_no", F.md5("line").alias("line_md5"), "batch_id", "row_in_batch")
