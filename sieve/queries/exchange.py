"""File formats: the tables are written as the exchange files, read back, and must not change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sieve.operators.model import load_model, save_model
from sieve.operators.ranking import chunked, ranked
from sieve.operators import sketches
from sieve.operators.spool import new_dir, spool
from sieve.plans.screening import screen
from sieve.queries.base import ARTICLES_SQL, TRAIN_SQL, Tables, query, with_sql
from sieve.queries.explanation import LATEST_SQL, verdict_events
from sieve.schemas import ARTICLES_CSV, CHUNK_CSV
from sieve.sources import files, pubmed, tables
from sieve.streaming import arrivals, verdicts


@query("topic_files", with_sql(ARTICLES_SQL, """
SELECT source AS topic_id, trim(max(title)) AS topic_title,
       ' ' || min(title) || '  continued: ' || max(title) AS topic_objective FROM articles GROUP BY source"""))
def topic_files(t: Tables) -> DataFrame:
    folder = new_dir(t.spark, "topic-files")
    by_source = t.articles("source").groupBy("source").agg(F.min("title").alias("low"), F.max("title").alias("high"))
    lines = F.format_string(
        "Topic: %s\r\n\r\nTitle:  %s \n\nObjectives: %s\n continued: %s\n", "source", "high", "low", "high"
    )
    by_source.select(lines).write.option("maxRecordsPerFile", 1).text(f"{folder}/topics")
    by_source.select("source").write.text(f"{folder}/notes")  # another folder, so not read
    return files.read_topics(t.spark, folder)[0]


@query("qrels_files", """
SELECT lang AS topic_id, CAST(d.doc_id AS VARCHAR) AS pid, toxic AS relevance, 'graded' AS kind
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT lang, CAST(d.doc_id AS VARCHAR), NULL, 'judged' FROM documents d JOIN labels l ON d.doc_id = l.doc_id
UNION ALL SELECT lang || ' ' || d.doc_id, NULL, NULL, 'rejected'
FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def qrels_files(t: Tables) -> DataFrame:
    folder = new_dir(t.spark, "qrels-files")
    rows = t.table("documents").select("doc_id", "lang").join(t.table("labels"), "doc_id", "left")
    full = F.format_string(" %s\t0  %s   %s ", "lang", "doc_id", "toxic")
    short = F.concat_ws(" ", "lang", F.col("doc_id").cast("string"))
    rows.select(F.when(F.col("toxic").isNotNull(), full).otherwise(short)).write.text(f"{folder}/qrels")
    judgments, rejected = files.read_judgments(t.spark, folder)
    return (
        judgments.withColumn("kind", F.lit("graded"))
        .unionByName(files.judged_ids(judgments).withColumn("kind", F.lit("judged")), allowMissingColumns=True)
        .unionByName(
            rejected.select(F.col("value").alias("topic_id"), F.lit("rejected").alias("kind")), allowMissingColumns=True
        )
    )


def _escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def article_records(articles: DataFrame, after_title: Column, *keep: str) -> DataFrame:
    """Each article as one XML record with attributes and two abstract sections; ``after_title`` is markup."""
    abstract = F.concat(F.lit(" ") if keep == ("lang",) else F.lit(""), _escaped(F.col("abstract")))
    record = F.format_string(
        '<PubmedArticle><MedlineCitation Status="X"><PMID Version="1">%s</PMID><Article>'
        "<ArticleTitle>%s%s</ArticleTitle><Abstract><AbstractText Label=\"A\">%s</AbstractText>"
        "<AbstractText>Second.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>",
        "pid", _escaped(F.col("title")), after_title, abstract,
    )
    return articles.select("pid", *keep, record.alias("value"))


def write_xml(records: DataFrame, folder: str) -> None:
    """Gzip files of whole documents, as many as the rows have partitions."""

    def one_document(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": ["<PubmedArticleSet>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</PubmedArticleSet>"]})

    records.mapInPandas(one_document, "value string").write.option("compression", "gzip").text(folder)


@query("article_xml", with_sql(ARTICLES_SQL, r"""
SELECT pid, 'compat' AS kind, title || ' ' AS title, md5(' ' || abstract) AS abstract_md5 FROM articles
UNION ALL SELECT pid, 'stripped', title || ' ' || lang || ' & more', md5(trim(abstract, ' ' || chr(10) || chr(9)) || ' Second.') FROM articles"""))
def article_xml(t: Tables) -> DataFrame:
    """Gzip XML with inline markup, attributes and a second abstract section."""
    folder = new_dir(t.spark, "article-xml")
    lead = F.concat(F.lit(" <i>"), "lang", F.lit("</i> &amp; more"))
    write_xml(article_records(t.articles("lang"), lead, "lang").select("value"), folder)
    compat = pubmed.read_articles(t.spark, folder, compat=True)[0].withColumn("kind", F.lit("compat"))
    plain = pubmed.read_articles(t.spark, folder, stripped=True)[0].withColumn("kind", F.lit("stripped"))
    return compat.union(plain).select("pid", "kind", "title", F.md5("abstract").alias("abstract_md5"))


@query("csv_round_trip", with_sql(ARTICLES_SQL, """
SELECT pid, title, md5('"' || title || '", ' || abstract || '  ') AS abstract_md5 FROM articles
UNION ALL SELECT 'untitled ' || pid, NULL, md5('"' || title || '", ' || abstract || '  ') FROM articles WHERE lang = 'fr'"""))
def csv_round_trip(t: Tables) -> DataFrame:
    """All articles, and one without a title beside each French one."""
    folder = new_dir(t.spark, "csv")
    rows = t.articles("lang").withColumn("Abstract_", F.concat(F.lit('"'), "title", F.lit('", '), "abstract", F.lit("  ")))
    untitled = rows.filter("lang = 'fr'").withColumns({"pid": F.concat(F.lit("untitled "), "pid"), "title": F.lit("N/A")})
    rows = rows.union(untitled).select(F.col("pid").alias("PMID"), F.col("title").alias("ArticleTitle"), F.col("Abstract_").alias("Abstract"))
    tables.write_csv(rows, folder)
    back = tables.read_csv(t.spark, f"{folder}/*.csv", ARTICLES_CSV)
    return back.select(F.col("PMID").alias("pid"), F.col("ArticleTitle").alias("title"), F.md5("Abstract").alias("abstract_md5"))


@query("suffix_files", with_sql(ARTICLES_SQL, """
SELECT pid, md5(title) AS title_md5 FROM articles WHERE lang IN ('en', 'de')"""))
def suffix_files(t: Tables) -> DataFrame:
    """Files of three kinds in one tree; those with two of the suffixes are opened."""
    folder = new_dir(t.spark, "suffixes")
    lines = t.articles("lang").select("lang", F.concat_ws("\t", "pid", "title").alias("value"))
    for lang, kind in (("en", "gzip"), ("de", "bzip2"), ("fr", "none")):
        lines.filter(F.col("lang") == lang).select("value").write.option("compression", kind).text(f"{folder}/deep/{lang}")
    found = files.scan_files(t.spark, folder, suffixes=[".txt.gz", "txt.bz2"])
    line = found.select(F.explode(F.split("content", "\n")).alias("line")).filter("line <> ''")
    return line.select(F.substring_index("line", "\t", 1).alias("pid"), F.md5(F.expr("substr(line, instr(line, '\t') + 1)")).alias("title_md5"))


@query("chunk_files", with_sql(ARTICLES_SQL, "SELECT pid, title, md5(abstract) AS abstract_md5 FROM articles"))
def chunk_files(t: Tables) -> DataFrame:
    """One folder per chunk of ids; the files then arrive as a stream and end up in one table."""
    folder = new_dir(t.spark, "chunks")
    articles = t.articles()
    tables.write_chunks(articles, chunked(articles.select("pid"), 300), f"{folder}/landing")
    arriving = arrivals.arriving_chunks(t.spark, f"{folder}/landing", CHUNK_CSV, files_per_batch=8)
    arrivals.collect_chunks(arriving, f"{folder}/table", f"{folder}/progress").awaitTermination()
    stored = t.spark.read.schema(CHUNK_CSV).parquet(f"{folder}/table")
    return stored.select(F.col("PID").alias("pid"), "title", F.md5("abstract").alias("abstract_md5"))


@query("distinct_sketches", """
SELECT lang AS topic_id, count(DISTINCT text) AS n_texts, count(DISTINCT source) AS n_sources, true AS close FROM documents GROUP BY lang
UNION ALL SELECT NULL, count(DISTINCT text), count(DISTINCT source), true FROM documents""")
def distinct_sketches(t: Tables) -> DataFrame:
    """Distinct texts and sources from sketches of chunks that arrive in turn, and whether texts are within 4 per cent."""
    folder = new_dir(t.spark, "sketches")
    rows = t.table("documents").select(F.col("lang").alias("topic_id"), "text", "source")
    landed = spool(rows.repartition(8), "rows")
    arriving = t.spark.readStream.schema(landed.df.schema).option("maxFilesPerTrigger", 3).parquet(landed.path)
    for column in ("text", "source"):
        sketches.stream_chunks(arriving, f"{folder}/{column}", f"{folder}/{column}-progress", column, ["topic_id"]).awaitTermination()
    exact = rows.groupBy("topic_id").agg(F.count_distinct("text").alias("n_texts"))
    exact = exact.unionByName(rows.agg(F.lit(None).cast("string").alias("topic_id"), F.count_distinct("text").alias("n_texts")))

    def estimates(column: str, name: str) -> DataFrame:
        of_topic = sketches.distinct_estimate(t.spark, f"{folder}/{column}", ["topic_id"], name)
        whole = sketches.distinct_estimate(t.spark, f"{folder}/{column}", name=name)
        return of_topic.unionByName(whole.withColumn("topic_id", F.lit(None).cast("string"))).withColumnRenamed("topic_id", f"_{column}")

    # A sketch of few values counts them exactly.
    found = exact.join(estimates("text", "guess"), F.col("topic_id").eqNullSafe(F.col("_text")))
    found = found.join(estimates("source", "n_sources"), F.col("topic_id").eqNullSafe(F.col("_source")))
    return found.select("topic_id", "n_texts", "n_sources", (F.abs(F.col("guess") / F.col("n_texts") - 1) <= 0.04).alias("close"))


@query("chunk_batch_read", with_sql(ARTICLES_SQL, "SELECT pid, title, md5(abstract) AS abstract_md5 FROM articles"))
def chunk_batch_read(t: Tables) -> DataFrame:
    folder = new_dir(t.spark, "chunks")
    articles = t.articles()
    tables.write_chunks(articles, chunked(articles.select("pid"), 300), folder)
    back = tables.read_chunks(t.spark, folder, CHUNK_CSV)
    return back.select(F.col("PID").alias("pid"), "title", F.md5("abstract").alias("abstract_md5"))


@query("result_store", """
WITH runs AS (
  SELECT source AS topic_id, 0 AS run_id, CAST(doc_id AS VARCHAR) AS pid FROM documents
  UNION ALL SELECT source, 1, CAST(d.doc_id AS VARCHAR) FROM documents d JOIN labels l ON d.doc_id = l.doc_id)
SELECT topic_id, run_id, row_number() OVER (PARTITION BY topic_id, run_id ORDER BY pid) AS position, pid, 'one topic' AS how
FROM runs WHERE topic_id = 'src1'
UNION ALL SELECT topic_id, run_id, row_number() OVER (PARTITION BY topic_id, run_id ORDER BY pid), pid, 'by prefix'
FROM runs WHERE starts_with(topic_id, 'src1')
UNION ALL SELECT DISTINCT topic_id, NULL, NULL, NULL, 'catalogue' FROM runs""")
def result_store(t: Tables) -> DataFrame:
    store = new_dir(t.spark, "results")
    articles = t.table("documents").selectExpr("source as topic_id", "cast(doc_id as string) as pid")
    judged = articles.join(t.judgments().select("pid"), "pid", "left_semi")
    for run in (articles, judged):
        tables.append_results(ranked(run, ["pid"], ["topic_id"], "position"), store)
    fields = StructType.fromDDL("pid string, position bigint")
    cols = ["topic_id", "run_id", "position", "pid"]
    one = tables.read_results(t.spark, store, fields, "src1").select(*cols, F.lit("one topic").alias("how"))
    some = tables.read_results(t.spark, store, fields, "src1", prefix=True).select(*cols, F.lit("by prefix").alias("how"))
    names = tables.topic_catalogue(t.spark, store, fields).withColumn("how", F.lit("catalogue"))
    return one.union(some).unionByName(names, allowMissingColumns=True)


@query("model_store", with_sql(TRAIN_SQL, """
SELECT w.topic_id, token, weight, round(prior, 6) AS prior FROM weights w JOIN priors p ON w.topic_id = p.topic_id
WHERE w.topic_id = 'en'"""))
def model_store(t: Tables) -> DataFrame:
    folder = new_dir(t.spark, "model")
    save_model(screen(t.citations()).model, folder)
    model = load_model(t.spark, folder, "en")
    prior = model.priors.withColumn("prior", F.round("prior", 6))
    return model.weights.df.drop("n").join(F.broadcast(prior), "topic_id")  # one topic, one row


@query("verdict_stream", LATEST_SQL)
def verdict_stream(t: Tables) -> DataFrame:
    """The events as a stream of files, four at a time; equal to the batch result."""
    landed = spool(verdict_events(t).repartition(16, "article_id"), "events")
    arriving = (
        t.spark.readStream.schema(landed.df.schema).option("maxFilesPerTrigger", 4).parquet(landed.path)
    )
    folder = new_dir(t.spark, "verdicts")
    verdicts.stream_verdicts(arriving, f"{folder}/table", f"{folder}/progress", ["article_id"]).awaitTermination()
    return verdicts.read_verdicts(t.spark, f"{folder}/table", ["article_id"]).drop("ts")
