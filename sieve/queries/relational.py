"""Selections, joins, aggregates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions.text import base_id, normal_key
from sieve.operators import corpus as C
from sieve.operators import profile as P
from sieve.operators.ranking import row_slice
from sieve.plans.corpus_build import graded
from sieve.queries.base import ARTICLES_SQL, Tables, citations_sql, query, with_sql
from sieve.sources.tables import result_file_topic


@query("normalised_keys", """
SELECT CAST(doc_id AS VARCHAR) AS pid, 1 AS relevance, source AS origin FROM documents""")
def normalised_keys(t: Tables) -> DataFrame:
    docs = t.table("documents").withColumn("raw", F.expr("concat(' 00', doc_id, '.0 ')"))
    return C.labelled(C.with_normal_key(docs, "raw"), 1).select(
        "pid", "relevance", F.col("source").alias("origin")
    )


@query("not_null_filter", """
SELECT CAST(d.doc_id AS VARCHAR) AS pid, n_chars FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
WHERE toxic IS NOT NULL AND text IS NOT NULL AND lang = 'en' AND toxic = 1""")
def not_null_filter(t: Tables) -> DataFrame:
    rows = t.table("documents").join(t.table("labels"), "doc_id", "left").selectExpr(
        "lang as topic_id", "cast(doc_id as string) as pid", "toxic as relevance", "text as abstract", "n_chars"
    )
    return C.features_and_label(C.not_null(rows, "relevance", "abstract"), "en", 1).select("pid", "n_chars")


@query("preview", with_sql(citations_sql(), """
SELECT pid, title, topic_id, relevance FROM citations ORDER BY pid LIMIT 5"""))
def preview(t: Tables) -> DataFrame:
    return row_slice(t.citations().select("pid", "title", "topic_id", "relevance"), ["pid"], 0, 5)


@query("row_count", with_sql(citations_sql("source"), """
SELECT count(*) AS n_rows, count(DISTINCT topic_id) AS n_topics FROM citations"""))
def row_count(t: Tables) -> DataFrame:
    return t.citations("source").agg(
        F.count("*").alias("n_rows"), F.count_distinct("topic_id").alias("n_topics")
    )


@query("unique_topics", "SELECT DISTINCT source AS topic_id FROM documents")
def unique_topics(t: Tables) -> DataFrame:
    return C.distinct_ids(t.table("documents").withColumnRenamed("source", "topic_id"), key="topic_id")


def _topics(t: Tables) -> DataFrame:
    docs = t.table("documents")
    names = docs.select(F.col("lang").alias("topic_id")).distinct().union(docs.select("source").distinct())
    return names.withColumn("topic_title", F.concat(F.lit("Title of "), "topic_id"))


@query("topic_left_join", with_sql(citations_sql(), """
SELECT t.topic_id, 'Title of ' || t.topic_id AS topic_title, c.pid, c.relevance
FROM (SELECT DISTINCT lang AS topic_id FROM documents UNION ALL SELECT DISTINCT source FROM documents) t
LEFT JOIN citations c ON t.topic_id = c.topic_id"""))
def topic_left_join(t: Tables) -> DataFrame:
    return C.topic_judgments(_topics(t), t.judgments().drop("quality"))


@query("judged_articles", """
SELECT d.lang AS topic_id, CAST(d.doc_id AS VARCHAR) AS pid, md5(split_part(text, chr(10), 1)) AS title_md5,
       length(text) AS abstract_length
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars >= 300""")
def judged_articles(t: Tables) -> DataFrame:
    short = F.col("n_chars") >= 300
    articles = t.articles("n_chars").withColumn("abstract", F.when(short, F.col("abstract"))).drop("n_chars")
    found = C.judged_articles(t.judgments().select("topic_id", "pid"), articles)
    return found.select(
        "topic_id", "pid", F.md5("title").alias("title_md5"), F.length("abstract").alias("abstract_length")
    )


@query("graded_corpus", """
SELECT topic_id, CAST(d.doc_id AS VARCHAR) AS pid, toxic AS relevance, md5(split_part(text, chr(10), 1)) AS title_md5,
       md5(text) AS abstract_md5
FROM (SELECT doc_id, lang AS topic_id, text FROM documents UNION ALL SELECT doc_id, source, text FROM documents) d
JOIN labels l ON d.doc_id = l.doc_id""")
def graded_corpus(t: Tables) -> DataFrame:
    judgments = C.union_all(t.judgments("lang"), t.judgments("source")).drop("quality")
    return graded(judgments, t.articles()).select(
        "topic_id", "pid", "relevance", F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5")
    )


@query("misfits", """
SELECT CAST(doc_id AS VARCHAR) AS pid, n_chars FROM documents d
WHERE text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def misfits(t: Tables) -> DataFrame:
    return C.misfits(t.articles("n_chars"), t.judgments()).select("pid", "n_chars")


@query("distinct_ids", """
SELECT CAST(doc_id AS VARCHAR) AS pid FROM documents UNION SELECT CAST(doc_id AS VARCHAR) FROM labels
UNION SELECT CAST(o_orderkey AS VARCHAR) FROM orders""")
def distinct_ids(t: Tables) -> DataFrame:
    orders = t.table("orders").select(normal_key(F.col("o_orderkey")).alias("pid"))
    return C.distinct_ids(t.articles(), t.judgments(), orders)


@query("topic_overlap", """
SELECT source AS topic_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE toxic = 1
INTERSECT SELECT source FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 0""")
def topic_overlap(t: Tables) -> DataFrame:
    judged = t.judgments("source")
    return C.shared_topics(judged.filter("relevance = 1"), judged.filter("quality = 0"))


@query("positives_per_topic", """
SELECT source AS topic_id, CAST(sum(toxic) AS BIGINT) AS relevance, CAST(sum(quality) AS BIGINT) AS quality,
       CAST(sum(n_chars) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY source ORDER BY 2 DESC, 1""")
def positives_per_topic(t: Tables) -> DataFrame:
    rows = t.table("documents").join(t.table("labels"), "doc_id", "left").selectExpr(
        "source as topic_id", "toxic as relevance", "quality", "n_chars"
    )
    return P.positives_per_topic(rows, numeric_only=True).orderBy(F.desc("relevance"), "topic_id")


@query("top_topics", with_sql(citations_sql("source"), """
SELECT rank, topic_id, relevance FROM (
  SELECT row_number() OVER (ORDER BY sum(relevance) DESC, topic_id) AS rank, topic_id,
         CAST(sum(relevance) AS BIGINT) AS relevance
  FROM citations GROUP BY topic_id HAVING sum(relevance) >= 2) WHERE rank BETWEEN 3 AND 6"""))
def top_topics(t: Tables) -> DataFrame:
    return P.top_topics(t.judgments("source"), 2, 2, 6).select("rank", "topic_id", "relevance")


@query("qualifying_topics", with_sql(citations_sql("source"), """
SELECT count(*) AS n_topics FROM (SELECT topic_id FROM citations GROUP BY topic_id HAVING sum(relevance) >= 2)"""))
def qualifying_topics(t: Tables) -> DataFrame:
    topics = P.positives_per_topic(t.judgments("source")).filter("relevance >= 2")
    return topics.agg(F.count("*").alias("n_topics"))


@query("balance_profile", with_sql(citations_sql("source"), """
SELECT * FROM (
  SELECT topic_id, count(*) FILTER (WHERE relevance = 1) AS rel_count,
         count(*) FILTER (WHERE relevance = 0) AS not_rel_count, count(relevance) AS count,
         abs(count(*) FILTER (WHERE relevance = 1) - count(*) FILTER (WHERE relevance = 0)) AS balance_score
  FROM citations GROUP BY topic_id ORDER BY rel_count DESC, topic_id LIMIT 15) ORDER BY balance_score, topic_id"""))
def balance_profile(t: Tables) -> DataFrame:
    return P.most_balanced(t.judgments("source"))


@query("complete_rows", """
SELECT lang AS topic_id, CAST(d.doc_id AS VARCHAR) AS pid, quality AS relevance,
       split_part(text, chr(10), 1) AS title, n_chars
FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE n_chars >= 100""")
def complete_rows(t: Tables) -> DataFrame:
    rows = t.table("documents").join(t.table("labels"), "doc_id", "left").selectExpr(
        "lang as topic_id", "cast(doc_id as string) as pid", "quality as relevance",
        "substring_index(text, '\\n', 1) as title", "case when n_chars >= 100 then n_chars end as n_chars",
    )
    return C.features_and_label(rows)


@query("slice_rows", """
SELECT topic_id, pid, n_chars FROM (
  SELECT lang AS topic_id, CAST(doc_id AS VARCHAR) AS pid, n_chars,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn > 10 AND rn <= 25
UNION ALL SELECT * FROM (SELECT 'all', CAST(doc_id AS VARCHAR), n_chars FROM documents ORDER BY doc_id LIMIT 15 OFFSET 10)""")
def slice_rows(t: Tables) -> DataFrame:
    rows = t.table("documents").selectExpr("lang as topic_id", "doc_id", "n_chars")
    per_topic = row_slice(rows, ["doc_id"], 10, 25, ["topic_id"])
    whole = row_slice(rows.withColumn("topic_id", F.lit("all")), ["doc_id"], 10, 25)
    return per_topic.union(whole).selectExpr("topic_id", "cast(doc_id as string) as pid", "n_chars")


@query("row_lookup", with_sql(ARTICLES_SQL, """
SELECT 'by title' AS how, min(pid) AS pid, title FROM articles
WHERE title = (SELECT title FROM articles WHERE pid = '100') GROUP BY title
UNION ALL SELECT 'by pid', pid, title FROM articles WHERE pid = '100'"""))
def row_lookup(t: Tables) -> DataFrame:
    articles = t.articles()
    by_pid = articles.filter(F.col("pid") == "100").select(F.lit("by pid").alias("how"), "pid", "title")
    named = articles.join(by_pid.select("title").limit(1), "title", "left_semi")  # one title, broadcast by its size
    by_title = named.orderBy("pid").limit(1).select(F.lit("by title").alias("how"), "pid", "title")
    return by_title.union(by_pid)


@query("result_file_topics", "SELECT DISTINCT lang AS topic_id FROM documents")
def result_file_topics(t: Tables) -> DataFrame:
    files = t.table("documents").select(F.format_string("shaps_%s_%s.pkl", "lang", "source").alias("file"))
    return files.select(base_id(result_file_topic(F.col("file"))).alias("topic_id")).distinct()


@query("topic_descriptions", with_sql(citations_sql("source"), """
SELECT c.topic_id, pid, r_name AS description FROM citations c
LEFT JOIN region r ON c.topic_id = 'src' || r.r_regionkey"""))
def topic_descriptions(t: Tables) -> DataFrame:
    regions = t.table("region").select(
        F.concat(F.lit("src"), F.col("r_regionkey").cast("string")).alias("topic_id"),
        F.col("r_name").alias("description"),
    )
    return C.described(t.judgments("source").select("topic_id", "pid"), regions)
