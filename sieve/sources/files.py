"""Whole files as rows, and the two text formats of a review: topics and judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.functions.text import after_prefix, has_suffix, normal_key, path_part, strip

TOPIC_FOLDER, JUDGMENT_FOLDER = "topics", "qrels"


def scan_files(spark: SparkSession, *paths: str, suffixes: list[str] | None = None) -> DataFrame:
    """One row per file below ``paths``: path, content. Files of other suffixes are not opened."""
    reader = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True)
    if suffixes:
        reader = reader.option("pathGlobFilter", "*{" + ",".join(suffixes) + "}")
    files = reader.load(list(paths)).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )
    return files.filter(has_suffix(F.col("path"), suffixes)) if suffixes else files


def in_folder(files: DataFrame, folder: str) -> DataFrame:
    """Files whose parent folder has this name."""
    return files.filter(path_part(F.col("path"), -2) == folder)


def _unix_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def parse_topics(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topic rows, and the files without topic, title or objective.

    The last line with a tag counts. The objective is everything from its line on, lines joined by
    a blank and the tag taken out wherever it occurs.
    """
    lines = files.withColumn("_lines", F.split(strip(_unix_lines(F.col("content"))), "\n"))
    bare = F.transform("_lines", strip)

    def tagged(tag: str) -> Column:
        hits = F.filter(bare, lambda line: line.startswith(tag))
        return after_prefix(F.try_element_at(hits, F.lit(-1)), tag)

    one, many = "Objective:", "Objectives:"
    is_start = lambda i: F.element_at(bare, i).startswith(one) | F.element_at(bare, i).startswith(many)
    start = F.try_element_at(F.filter(F.sequence(F.lit(1), F.size("_lines")), is_start), F.lit(-1))
    parsed = lines.select(
        "path",
        "content",
        tagged("Topic:").alias("topic_id"),
        tagged("Title:").alias("topic_title"),
        start.alias("_start"),
        "_lines",
    )
    block = F.array_join(F.slice("_lines", F.col("_start"), F.size("_lines")), " ")
    tag = F.when(strip(F.element_at("_lines", F.col("_start"))).startswith(many), many).otherwise(one)
    parsed = parsed.withColumn(
        "topic_objective", F.when(F.col("_start").isNotNull(), F.replace(block, tag, F.lit("")))
    )
    whole = F.col("topic_id").isNotNull() & F.col("topic_title").isNotNull() & F.col("_start").isNotNull()
    missing = F.concat_ws(
        ", ",
        F.when(F.col("topic_id").isNull(), "no topic"),
        F.when(F.col("topic_title").isNull(), "no title"),
        F.when(F.col("_start").isNull(), "no objective"),
    )
    topics = parsed.filter(whole).select("topic_id", "topic_title", "topic_objective")
    return topics, parsed.filter(~whole).select("path", "content", missing.alias("reason"))


def parse_judgments(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Judgment rows from text lines (column ``value``), and the lines that are none.

    Four columns between any white space: topic, unused, article id, grade. Blank lines vanish.
    """
    text = strip(F.col("value"))
    fields = lines.filter(text != "").select("value", F.split(text, r"\s+").alias("_f"))
    parsed = fields.select(
        "value",
        F.col("_f")[0].alias("topic_id"),
        normal_key(F.get("_f", F.lit(2))).alias("pid"),
        F.get("_f", F.lit(3)).try_cast("int").alias("relevance"),
        (F.size("_f") == 4).alias("_four"),
    )
    good = F.col("_four") & F.col("pid").rlike(r"^\d+$") & F.col("relevance").isNotNull()
    rows = parsed.filter(good).select("topic_id", "pid", "relevance")
    return rows, parsed.filter(~F.coalesce(good, F.lit(False))).select("value")


def read_judgments(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Judgments of all files below ``paths`` that lie in a judgment folder, line by line, so a
    large file is split among tasks."""
    lines = (
        spark.read.format("text").option("recursiveFileLookup", True).load(list(paths))
        .select("value", F.col("_metadata.file_path").alias("path"))
    )
    return parse_judgments(in_folder(lines, JUDGMENT_FOLDER))


def judged_ids(judgments: DataFrame) -> DataFrame:
    """Judgments without their grade: whatever was judged, relevant or not."""
    return judgments.select("topic_id", "pid")


def read_topics(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    return parse_topics(in_folder(scan_files(spark, *paths), TOPIC_FOLDER))
