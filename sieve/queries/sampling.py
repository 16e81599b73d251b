"""Seeded samples, splits, chunks and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.functions.numeric import percent_done
from sieve.functions.text import shard_name
from sieve.operators import sampling as S
from sieve.operators.corpus import not_null
from sieve.operators.ranking import batched, chunked, draw_shards
from sieve.operators.spool import new_dir
from sieve.plans.corpus_build import sampled_corpus
from sieve.queries.base import BALANCED_SQL, SCREEN_SQL, SPLIT_SQL, Tables, citations_sql, query, with_sql
from sieve.sources.batches import read_batch, read_from, write_batches


@query("negative_sampling", """
WITH articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS pid, split_part(text, chr(10), 1) AS title, text AS abstract, lang FROM documents),
positives AS (
  SELECT lang AS topic_id, 'Title of ' || lang AS topic_title, 'To assess ' || lang AS topic_objective, a.*
  FROM articles a JOIN labels l ON a.pid = CAST(l.doc_id AS VARCHAR) WHERE toxic = 1),
hosts AS (
  SELECT topic_id, topic_title, topic_objective,
         row_number() OVER (ORDER BY md5('42:host:' || pid || chr(9) || topic_id), pid, topic_id) AS k FROM positives),
guests AS (
  SELECT pid, title, abstract, row_number() OVER (ORDER BY md5('42:misfit:' || pid), pid) AS k
  FROM articles WHERE pid NOT IN (SELECT pid FROM positives))
SELECT topic_id, topic_title, topic_objective, pid, 1 AS relevance, md5(title) AS title_md5, md5(abstract) AS abstract_md5
FROM positives
UNION ALL
SELECT topic_id, topic_title, topic_objective, pid, 0, md5(title), md5(abstract) FROM hosts JOIN guests ON hosts.k = guests.k""")
def negative_sampling(t: Tables) -> DataFrame:
    judgments = t.judgments().filter("relevance = 1").drop("quality")
    topics = t.table("documents").select(F.col("lang").alias("topic_id")).distinct().select(
        "topic_id",
        F.concat(F.lit("Title of "), "topic_id").alias("topic_title"),
        F.concat(F.lit("To assess "), "topic_id").alias("topic_objective"),
    )
    corpus = sampled_corpus(topics, judgments, t.articles(), dedupe=False)
    return corpus.select(
        "topic_id", "topic_title", "topic_objective", "pid", "relevance",
        F.md5("title").alias("title_md5"), F.md5("abstract").alias("abstract_md5"),
    )


@query("negatives_without_test_ids", """
WITH judged AS (SELECT d.doc_id, lang, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
hosts AS (
  SELECT lang AS topic_id, row_number() OVER (ORDER BY md5('7:host:' || doc_id || chr(9) || lang), doc_id, lang) AS k
  FROM judged WHERE toxic = 1),
guests AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('7:misfit:' || doc_id), CAST(doc_id AS VARCHAR)) AS k
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM judged))
SELECT lang AS topic_id, CAST(doc_id AS VARCHAR) AS pid, 1 AS relevance FROM judged WHERE toxic = 1
UNION ALL SELECT topic_id, CAST(doc_id AS VARCHAR), 0 FROM hosts JOIN guests ON hosts.k = guests.k""")
def negatives_without_test_ids(t: Tables) -> DataFrame:
    """Ids of the other split are kept out of the negatives as well."""
    positives = t.citations().filter("relevance = 1")
    out = S.sample_negatives(positives, t.articles(), seed=7, exclude=t.judgments())
    return out.select("topic_id", "pid", "relevance")


@query("chunks", """
WITH ids AS (SELECT DISTINCT doc_id FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels)),
placed AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS chunk_id FROM ids),
total AS (SELECT max(chunk_id) + 1 AS n FROM placed)
SELECT chunk_id, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS pids, count(*) AS n_pids,
       CAST(floor((chunk_id + 1) * 100 / any_value(n)) AS BIGINT) AS percent_done
FROM placed, total GROUP BY chunk_id""")
def chunks(t: Tables) -> DataFrame:
    numbered = chunked(t.articles().select("pid").union(t.judgments().select("pid")), 300)
    number = F.col("pid").cast("bigint")
    lists = numbered.groupBy("chunk_id").agg(F.sort_array(F.collect_list(number)).alias("_ids"))
    total = numbered.agg((F.max("chunk_id") + 1).alias("_total"))
    return lists.join(F.broadcast(total)).select(  # one row
        "chunk_id", F.array_join("_ids", ",").alias("pids"), F.size("_ids").cast("bigint").alias("n_pids"),
        percent_done(F.col("chunk_id") + 1, F.col("_total")).alias("percent_done"),
    )


@query("undersample", with_sql([citations_sql(), BALANCED_SQL], "SELECT topic_id, pid, relevance FROM balanced"))
def undersample(t: Tables) -> DataFrame:
    return S.undersample(t.judgments().drop("quality"))


@query("undersample_short_majority", with_sql(
    [citations_sql("source", "quality"), BALANCED_SQL], "SELECT topic_id, pid, relevance FROM balanced"))
def undersample_short_majority(t: Tables) -> DataFrame:
    """Here the relevant rows are the larger class, so it is they that are cut."""
    rows = t.judgments("source").select("topic_id", "pid", F.col("quality").alias("relevance"))
    return S.undersample(rows)


@query("stratified_split", with_sql(SCREEN_SQL, "SELECT topic_id, pid, relevance, is_test FROM split"))
def stratified_split(t: Tables) -> DataFrame:
    return S.balanced_split(t.citations()).select("topic_id", "pid", "relevance", "is_test")


@query("split_by_source", with_sql(
    [citations_sql("source"), "balanced AS (SELECT * FROM citations)", SPLIT_SQL],
    "SELECT topic_id, pid, relevance, is_test FROM split"))
def split_by_source(t: Tables) -> DataFrame:
    """Unbalanced classes over 20 topics: quotas by largest remainder."""
    return S.stratified_split(t.judgments("source").drop("quality"))


@query("batches", """
SELECT lang AS topic_id, CAST(doc_id AS VARCHAR) AS pid, 'shuffled' AS kind,
       (row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), CAST(doc_id AS VARCHAR)) - 1) // 16 AS batch_id,
       (row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), CAST(doc_id AS VARCHAR)) - 1) % 16 AS row_in_batch
FROM documents
UNION ALL
SELECT lang, CAST(doc_id AS VARCHAR), 'in order',
       (row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR)) - 1) // 4,
       (row_number() OVER (PARTITION BY lang ORDER BY CAST(doc_id AS VARCHAR)) - 1) % 4
FROM documents""")
def batches(t: Tables) -> DataFrame:
    rows = t.table("documents").selectExpr("lang as topic_id", "cast(doc_id as string) as pid")
    shuffled = batched(rows, 16).withColumn("kind", F.lit("shuffled"))
    in_order = batched(rows, 4, shuffle=False).withColumn("kind", F.lit("in order"))
    return shuffled.unionByName(in_order)


@query("batch_export", """
WITH placed AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), CAST(doc_id AS VARCHAR)) - 1 AS place FROM documents)
SELECT 'all' AS how, lang AS topic_id, CAST(doc_id AS VARCHAR) AS pid, place // 16 AS batch_id, place % 16 AS row_in_batch, md5(text) AS text_md5 FROM placed
UNION ALL SELECT 'one batch', lang, CAST(doc_id AS VARCHAR), place // 16, place % 16, md5(text) FROM placed WHERE lang = 'en' AND place // 16 = 3
UNION ALL SELECT 'resumed', lang, CAST(doc_id AS VARCHAR), place // 16, place % 16, md5(text) FROM placed WHERE lang = 'en' AND place // 16 >= 5""")
def batch_export(t: Tables) -> DataFrame:
    """Shuffled batches of all texts as files with an index; read as a whole, one batch alone, and from a batch on."""
    folder = new_dir(t.spark, "batches")
    write_batches(batched(t.table("documents").selectExpr("lang as topic_id", "cast(doc_id as string) as pid", "text"), 16), folder, per_file=4)
    cols = ["how", "topic_id", "pid", "batch_id", "row_in_batch", F.md5("text").alias("text_md5")]
    every = t.spark.read.parquet(f"{folder}/rows").withColumn("how", F.lit("all")).select(*cols)
    one = read_batch(t.spark, folder, 3, topic_id="en").withColumn("how", F.lit("one batch")).select(*cols)
    rest = read_from(t.spark, folder, 5, topic_id="en").withColumn("how", F.lit("resumed")).select(*cols)
    return every.union(one).union(rest)


@query("shard_sample", """
WITH shards AS (SELECT DISTINCT l_suppkey AS shard FROM lineitem),
drawn AS (SELECT shard FROM shards ORDER BY md5('42:' || shard), CAST(shard AS VARCHAR) LIMIT 20)
SELECT 'pubmed25n' || lpad(CAST(shard AS VARCHAR), 4, '0') || '.xml.gz' AS name, count(*) AS n_rows
FROM drawn JOIN lineitem ON l_suppkey = shard GROUP BY shard""")
def shard_sample(t: Tables) -> DataFrame:
    rows = t.table("lineitem").select(F.col("l_suppkey").alias("shard"))
    drawn = draw_shards(rows.distinct(), 20)
    return (
        not_null(rows, "shard").join(F.broadcast(drawn), "shard")  # 20 rows
        .groupBy("shard").agg(F.count("*").alias("n_rows"))
        .select(shard_name(F.col("shard")).alias("name"), "n_rows")
    )
