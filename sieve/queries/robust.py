"""The operators on rows as they come: ids that repeat, null topics and ids, articles nobody judged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions.text import shard_name
from sieve.operators import corpus as C
from sieve.operators import sampling as S
from sieve.operators.ranking import batched, draw_shards
from sieve.operators.spool import new_dir, spool
from sieve.plans.explaining import readable
from sieve.plans.screening import judged, screen
from sieve.queries.base import ARTICLES_SQL, SPLIT_SQL, TRAIN_SQL, Tables, query, rounded, tokens_sql, with_sql
from sieve.queries.exchange import article_records, write_xml
from sieve.sources import pubmed
from sieve.streaming import verdicts
from sieve.streaming.open_verdicts import read_open_changes, stream_open_verdicts

_KEY = "coalesce(pid, '')"
REPEATED_SQL = """judged AS (SELECT d.doc_id, lang, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
citations AS (
  SELECT lang AS topic_id, CAST(doc_id AS VARCHAR) AS pid, toxic AS relevance FROM judged
  UNION ALL SELECT lang, CAST(doc_id AS VARCHAR), toxic FROM judged WHERE doc_id % 3 = 0
  UNION ALL SELECT lang, CAST(doc_id AS VARCHAR), toxic FROM judged WHERE doc_id % 6 = 0
  UNION ALL SELECT NULL, CAST(doc_id AS VARCHAR), toxic FROM judged WHERE doc_id % 4 = 0
  UNION ALL SELECT lang, NULL, toxic FROM judged WHERE doc_id % 5 = 0)"""
BALANCED_REPEATS_SQL = f"""class_sizes AS (
  SELECT topic_id, count(*) FILTER (WHERE relevance = 0) AS n_neg,
         count(*) FILTER (WHERE relevance = 1) AS n_pos FROM citations GROUP BY topic_id),
balanced AS (
  SELECT c.topic_id, c.pid, c.relevance
  FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, relevance ORDER BY md5('42:' || {_KEY}), {_KEY}) AS rn
        FROM citations) c JOIN class_sizes s ON c.topic_id IS NOT DISTINCT FROM s.topic_id
  WHERE rn <= least(n_neg, n_pos))"""
SPLIT_REPEATS_SQL = (
    SPLIT_SQL.replace("c.topic_id = t.topic_id", "c.topic_id IS NOT DISTINCT FROM t.topic_id")
    .replace("b.topic_id = q.topic_id", "b.topic_id IS NOT DISTINCT FROM q.topic_id")
    .replace("'42:' || pid), pid)", f"'42:' || {_KEY}), {_KEY})")
)


def _repeated(t: Tables) -> DataFrame:
    """Judgments, some of them two or three times, some without topic, some without id."""
    rows = t.judgments().drop("quality")
    number = F.col("pid").cast("bigint")
    return C.union_all(
        rows, rows.filter(number % 3 == 0), rows.filter(number % 6 == 0),
        rows.filter(number % 4 == 0).withColumn("topic_id", F.lit(None).cast("string")),
        rows.filter(number % 5 == 0).withColumn("pid", F.lit(None).cast("string")),
    )


@query("undersample_repeats", with_sql([REPEATED_SQL, BALANCED_REPEATS_SQL], "SELECT topic_id, pid, relevance FROM balanced"))
def undersample_repeats(t: Tables) -> DataFrame:
    return S.undersample(_repeated(t))


@query("split_repeats", with_sql(
    [REPEATED_SQL, BALANCED_REPEATS_SQL, SPLIT_REPEATS_SQL], "SELECT topic_id, pid, relevance, is_test FROM split"))
def split_repeats(t: Tables) -> DataFrame:
    return S.balanced_split(_repeated(t)).select("topic_id", "pid", "relevance", "is_test")


@query("batches_repeats", with_sql(REPEATED_SQL, f"""
SELECT topic_id, pid, 'shuffled' AS kind, (k - 1) // 16 AS batch_id, (k - 1) % 16 AS row_in_batch
FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY md5('42:' || {_KEY}), {_KEY}) AS k FROM citations)
UNION ALL
SELECT topic_id, pid, 'in order', (k - 1) // 4, (k - 1) % 4
FROM (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY pid NULLS FIRST) AS k FROM citations)"""))
def batches_repeats(t: Tables) -> DataFrame:
    rows = _repeated(t).select("topic_id", "pid")
    shuffled = batched(rows, 16).withColumn("kind", F.lit("shuffled"))
    return shuffled.unionByName(batched(rows, 4, shuffle=False).withColumn("kind", F.lit("in order")))


@query("negatives_repeats", """
WITH judged AS (SELECT d.doc_id, lang, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
positives AS (
  SELECT lang AS topic_id, CAST(doc_id AS VARCHAR) AS pid FROM judged WHERE toxic = 1
  UNION ALL SELECT lang, CAST(doc_id AS VARCHAR) FROM judged WHERE toxic = 1 AND doc_id % 3 = 0),
hosts AS (
  SELECT topic_id, row_number() OVER (ORDER BY md5('42:host:' || pid || chr(9) || topic_id), pid, topic_id) AS k FROM positives),
guests AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:misfit:' || doc_id), CAST(doc_id AS VARCHAR)) AS k
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM judged WHERE toxic = 1))
SELECT topic_id, pid, 1 AS relevance FROM positives
UNION ALL SELECT topic_id, CAST(doc_id AS VARCHAR), 0 FROM hosts JOIN guests ON hosts.k = guests.k""")
def negatives_repeats(t: Tables) -> DataFrame:
    """Judgments and articles both repeat, and some articles have no id."""
    rows = t.citations().filter("relevance = 1")
    positives = rows.unionByName(rows.filter(F.col("pid").cast("bigint") % 3 == 0))
    articles = t.articles()
    nameless = articles.filter(F.col("pid").cast("bigint") % 2 == 0).withColumn("pid", F.lit(None).cast("string"))
    out = S.sample_negatives(positives, C.union_all(articles, articles, nameless))
    return out.select("topic_id", "pid", "relevance")


# Every document, some of them again, under no topic, or under a topic that has no model.
ALL_SQL = f"""all_rows AS (
  SELECT lang AS topic_id, * FROM articles
  UNION ALL SELECT lang, * FROM articles WHERE CAST(pid AS BIGINT) % 10 = 0
  UNION ALL SELECT NULL, * FROM articles WHERE CAST(pid AS BIGINT) % 20 = 0
  UNION ALL SELECT 'none', * FROM articles WHERE CAST(pid AS BIGINT) % 25 = 0),
evidence AS (
  SELECT a.lang, a.pid, sum(weight) AS total
  FROM (SELECT lang, pid, unnest(list_concat({tokens_sql('lower(title)')}, {tokens_sql('lower(abstract)')})) AS token FROM articles) a
  JOIN weights w ON a.lang = w.topic_id AND a.token = w.token GROUP BY a.lang, a.pid),
all_scores AS (
  SELECT r.topic_id, r.pid, r.title, r.abstract, p.prior + coalesce(e.total, 0) AS logit
  FROM all_rows r LEFT JOIN priors p ON r.topic_id = p.topic_id LEFT JOIN evidence e ON r.topic_id = e.lang AND r.pid = e.pid),
all_verdicts AS (
  SELECT *, CASE WHEN logit >= 0 THEN 'Relevant' WHEN logit < 0 THEN 'Irrelevant' ELSE 'Error' END AS verdict FROM all_scores)"""


def _everything(t: Tables) -> DataFrame:
    rows = t.texts("lang as topic_id")
    number = F.col("pid").cast("bigint")
    return C.union_all(
        rows, rows.filter(number % 10 == 0),
        rows.filter(number % 20 == 0).withColumn("topic_id", F.lit(None).cast("string")),
        rows.filter(number % 25 == 0).withColumn("topic_id", F.lit("none")),
    )


@query("all_verdicts", with_sql([*TRAIN_SQL, ARTICLES_SQL, ALL_SQL], """
SELECT topic_id, pid, verdict, round(logit, 6) AS logit FROM all_verdicts"""))
def all_verdicts(t: Tables) -> DataFrame:
    """The model of the split applied to every article, judged or not; no model gives ``Error``."""
    found = judged(_everything(t), screen(t.citations()).model)
    return found.select("topic_id", "pid", "verdict", rounded("logit").alias("logit"))


@query("all_results", with_sql([*TRAIN_SQL, ARTICLES_SQL, ALL_SQL], f"""
SELECT topic_id, pid, md5(title) AS title_md5, verdict, len({tokens_sql('title')}) AS n_title, len({tokens_sql('abstract')}) AS n_abstract
FROM all_verdicts"""))
def all_results(t: Tables) -> DataFrame:
    """Every article explained, with the same verdict as ``all_verdicts``."""
    found = readable(_everything(t), screen(t.citations()).model)
    size = lambda parts: F.size(parts).cast("bigint")
    return found.select(
        "topic_id", "pid", F.md5("title").alias("title_md5"), "verdict",
        size("explained_title_parts").alias("n_title"), size("explained_abstract_parts").alias("n_abstract"),
    )


@query("broken_xml", with_sql(ARTICLES_SQL, """
SELECT pid, 'article' AS kind, title AS title, md5(abstract || ' Second.') AS abstract_md5 FROM articles
WHERE CAST(pid AS BIGINT) % 7 NOT IN (2, 4)
UNION ALL SELECT pid, CASE CAST(pid AS BIGINT) % 7 WHEN 2 THEN 'record without end' ELSE 'record does not parse' END, NULL, NULL
FROM articles WHERE CAST(pid AS BIGINT) % 7 IN (2, 4)"""))
def broken_xml(t: Tables) -> DataFrame:
    """Gzip files in which two records in seven are broken in different ways; all sections are read."""
    folder = new_dir(t.spark, "broken-xml")
    kind = F.col("pid").cast("bigint") % 7
    record = F.when(kind == 2, F.replace("value", F.lit("</PubmedArticle>"), F.lit("</PubmedArticl>")))
    record = record.when(kind == 4, F.replace("value", F.lit("</ArticleTitle>"), F.lit("</Title>"))).otherwise(F.col("value"))
    # Each file ends with an intact record, for a broken last one would be cut off by the end of the file.
    records = article_records(t.articles(), F.lit("")).repartitionByRange(16, "pid").sortWithinPartitions(kind.isin(2, 4).desc(), "pid")
    write_xml(records.select(record.alias("value")), folder)
    found, rejected = pubmed.read_articles(t.spark, folder)
    lost = rejected.filter("content is not null").select(
        F.regexp_extract("content", r"<PMID[^>]*>([0-9]+)", 1).alias("pid"), F.col("reason").alias("kind"),
        F.explode(F.regexp_extract_all("content", F.lit(r"<PMID[^>]*>([0-9]+)"), F.lit(1))).alias("_each"),
    ).select(F.col("_each").alias("pid"), "kind")
    out = found.select("pid", F.lit("article").alias("kind"), "title", F.md5("abstract").alias("abstract_md5"))
    return out.unionByName(lost, allowMissingColumns=True)


def _xml_shards(t: Tables) -> tuple[str, DataFrame]:
    """The articles as one XML shard per source, and the records they were made of."""
    folder = new_dir(t.spark, "shards")
    rows = t.articles("cast(substr(source, 4) as int) as shard")
    records = article_records(rows, F.lit(""), "shard").withColumn("name", shard_name(F.col("shard")))
    body = spool(records.select("name", "shard", "value"), "records").df
    whole = F.concat(F.lit("<PubmedArticleSet>"), "value", F.lit("</PubmedArticleSet>"))  # or a file would count as broken off
    body.select("name", whole.alias("value")).hint("rebalance", "name").write.partitionBy("name").text(folder)
    return folder, body


@query("shard_sweep", with_sql(ARTICLES_SQL, "SELECT pid, md5(title) AS title_md5, false AS rejected FROM articles"))
def shard_sweep(t: Tables) -> DataFrame:
    """All shards of a folder by name, and nothing is lost on the way."""
    articles, lost = pubmed.sweep(t.spark, _xml_shards(t)[0], pattern="name=pubmed25n*.xml.gz", partitions=8)
    bad = lost.select(F.lit(None).cast("string").alias("pid"), F.md5("file").alias("title_md5"), F.lit(True).alias("rejected"))
    return articles.select("pid", F.md5("title").alias("title_md5"), F.lit(False).alias("rejected")).unionByName(bad)


@query("drawn_shards", with_sql(ARTICLES_SQL, """
SELECT pid, md5(title) AS title_md5 FROM articles
WHERE CAST(substr(source, 4) AS INTEGER) IN (SELECT shard FROM (
  SELECT DISTINCT CAST(substr(source, 4) AS INTEGER) AS shard FROM documents)
  ORDER BY md5('42:' || shard), CAST(shard AS VARCHAR) LIMIT 5)"""))
def drawn_shards(t: Tables) -> DataFrame:
    """One XML shard per source; five are drawn by name, and only their files are read."""
    folder, body = _xml_shards(t)
    names = draw_shards(body.select("shard").distinct(), 5).select(
        F.concat(F.lit("name="), shard_name(F.col("shard"))).alias("name")
    )
    return pubmed.read_shards(t.spark, folder, names)[0].select("pid", F.md5("title").alias("title_md5"))


OPEN_SQL = """
WITH e AS (
  SELECT CAST(user_id AS VARCHAR) AS reviewer, event_type AS topic_id, CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) AS article_id,
         CASE WHEN value >= 50 THEN 'Relevant' ELSE 'Irrelevant' END AS verdict, ts, event_id FROM events),
marked AS (SELECT *, lag(topic_id) OVER (PARTITION BY reviewer ORDER BY ts, event_id) AS previous FROM e),
stays AS (
  SELECT *, sum(CASE WHEN previous IS DISTINCT FROM topic_id THEN 1 ELSE 0 END)
            OVER (PARTITION BY reviewer ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS stay FROM marked)
SELECT reviewer, topic_id, article_id, verdict, event_id FROM stays
QUALIFY stay = max(stay) OVER (PARTITION BY reviewer)
  AND row_number() OVER (PARTITION BY reviewer, stay, article_id ORDER BY ts DESC, event_id DESC) = 1"""


def _review_events(t: Tables) -> DataFrame:
    return t.table("events").selectExpr(
        "cast(user_id as string) as reviewer", "event_type as topic_id",
        "cast(cast(floor(value / 10) as bigint) as string) as article_id",
        "case when value >= 50 then 'Relevant' else 'Irrelevant' end as verdict", "ts", "event_id",
    )


@query("open_verdict_stream", OPEN_SQL)
def open_verdict_stream(t: Tables) -> DataFrame:
    """Verdicts arrive as a stream; turning to another topic clears those before, also after compaction."""
    landed = spool(_review_events(t).repartition(8), "events")
    arriving = t.spark.readStream.schema(landed.df.schema).option("maxFilesPerTrigger", 3).parquet(landed.path)
    folder, keys = new_dir(t.spark, "open-verdicts"), ("reviewer", *verdicts.KEYS)
    verdicts.stream_verdicts(arriving, f"{folder}/table", f"{folder}/progress", keys).awaitTermination()
    verdicts.compact_verdicts(t.spark, f"{folder}/table", keys)
    return verdicts.read_open_verdicts(t.spark, f"{folder}/table").drop("ts")


@query("cleared_verdict_stream", OPEN_SQL)
def cleared_verdict_stream(t: Tables) -> DataFrame:
    """The same with state that the stream clears itself; events arrive shuffled."""
    landed = spool(_review_events(t).repartition(8), "events")
    arriving = t.spark.readStream.schema(landed.df.schema).option("maxFilesPerTrigger", 4).parquet(landed.path)
    folder = new_dir(t.spark, "cleared-verdicts")
    stream_open_verdicts(arriving, f"{folder}/table", f"{folder}/progress").awaitTermination()
    return read_open_changes(t.spark, f"{folder}/table").drop("ts")
