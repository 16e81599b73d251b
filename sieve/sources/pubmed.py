"""Article XML, plain or gzip."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.functions.text import shard_name, strip

_ARTICLE = "Article struct<ArticleTitle string, Abstract struct<AbstractText array<string>>>"
_SCHEMA = (
    f"MedlineCitation struct<PMID struct<_VALUE string>, {_ARTICLE}>, PMID struct<_VALUE string>, {_ARTICLE}, "
    "_corrupt_record string"
)
_END = "</PubmedArticle>"
_BEGIN = "<PubmedArticle"
_TAG = r"</?[A-Za-z][^<>]*>"


def _text(inner: Column, compat: bool) -> Column:
    """Text of an element whose inner markup came as one string: up to the first child tag as
    ``compat``, otherwise all of it without the tags. Empty is null."""
    # (?s) lets the cut run over line ends; a decoded "<" that starts no tag stays. Most texts hold no "<" at all.
    cut = F.regexp_replace(inner, f"(?s){_TAG}.*$", "") if compat else F.regexp_replace(inner, _TAG, "")
    inner = F.when(inner.contains("<"), cut).otherwise(inner)
    return F.when(inner != "", inner)


def _pieces(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(file, piece): the files cut behind every record, so that one broken record cannot take others along.

    A gzip file that breaks off gives the pieces before the break.
    """
    return (
        spark.read.option("lineSep", _END).option("ignoreCorruptFiles", True)
        .text([paths] if isinstance(paths, str) else list(paths))
        .select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("piece"))
    )


def _records(pieces: DataFrame) -> DataFrame:
    """Adds ``lost``, what lies before the record in its piece (a record that was never closed), the
    record itself and ``r``, its parsed form; the piece behind the last record has none."""
    # One pass over the piece: what begins at its last record, and whether others begin before.
    cut = pieces.withColumn("_parts", F.split("piece", rf"{_BEGIN}(?=[\s>])"))
    last = F.element_at("_parts", -1)
    before = F.substring("piece", F.lit(1), F.length("piece") - F.length(last) - len(_BEGIN))
    cut = cut.select(
        "file", F.when(F.size("_parts") > 1, F.concat(F.lit(_BEGIN), last, F.lit(_END))).alias("record"),
        F.when(F.size("_parts") > 2, before).alias("lost"),
    )
    options = {"ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    # Behind a generator a filter on the parsed record stays, so that a record is parsed once.
    return cut.select("file", "record", "lost", F.explode(F.array(F.from_xml("record", _SCHEMA, options))).alias("r"))


def read_articles(spark: SparkSession, paths: str | Sequence[str], compat: bool = False, stripped: bool = False,
                  partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, rejected).

    Articles have pid, title and abstract of every PubmedArticle: the first id, the first title, and all
    sections of the abstract with a blank between them (``compat``: the first section). Rejected has
    (file, reason, content): records that do not parse or are never closed, files that break off and
    files in which nothing can be read. All other records are kept. One gzip file is one task, so
    name ``partitions`` to spread what follows.
    """
    parsed = _records(_pieces(spark, paths))
    # The reader drops the separator, so a record that its file cuts off shows by not parsing.
    parses = F.col("r").isNotNull() & F.col("r._corrupt_record").isNull()
    parsed = parsed.withColumn("whole", parses)
    unread = F.col("record").isNotNull() & ~F.col("whole")
    r = "r."
    pid = F.coalesce(F.col(f"{r}MedlineCitation.PMID._VALUE"), F.col(f"{r}PMID._VALUE"))
    title = F.coalesce(F.col(f"{r}MedlineCitation.Article.ArticleTitle"), F.col(f"{r}Article.ArticleTitle"))
    sections = F.coalesce(
        F.col(f"{r}MedlineCitation.Article.Abstract.AbstractText"), F.col(f"{r}Article.Abstract.AbstractText")
    )
    cut = strip if stripped else (lambda c: c)
    plain = lambda c: cut(_text(c, compat))
    abstract = plain(F.get(sections, F.lit(0))) if compat else F.array_join(
        F.filter(F.transform(F.coalesce(sections, F.array().cast("array<string>")), plain), lambda x: x.isNotNull() & (x != "")), " "
    )
    out = parsed.filter("whole").select(
        strip(pid).alias("pid"), F.nullif(plain(title), F.lit("")).alias("title"), F.nullif(abstract, F.lit("")).alias("abstract")
    )
    row = lambda reason, content: F.struct(F.lit(reason).alias("reason"), content.alias("content"))
    lost = F.when(F.col("lost").isNotNull(), row("record without end", F.col("lost")))
    bad = F.when(unread, row("record does not parse", F.col("record")))
    rejected = parsed.select("file", F.inline(F.array_compact(F.array(lost, bad))))
    files = spark.read.format("binaryFile").load([paths] if isinstance(paths, str) else list(paths))
    files = files.select(F.col("_metadata.file_path").alias("file"))
    closed = _pieces(spark, paths).filter(F.col("piece").rlike(r"</[A-Za-z][^<>]*>\s*$") & ~F.col("piece").contains(_BEGIN))
    breaks = files.join(closed.select("file"), "file", "left_anti").select(
        "file", F.lit("file breaks off").alias("reason"), F.lit(None).cast("string").alias("content")
    )
    return (out.repartition(partitions) if partitions else out), rejected.unionByName(breaks)


def shards(spark: SparkSession, first: int = 1, last: int = 1274) -> DataFrame:
    """Names of the shards of a yearly release."""
    return spark.range(first, last + 1).select(
        F.col("id").alias("shard"), shard_name(F.col("id")).alias("name")
    )


def read_shards(spark: SparkSession, folder: str, names: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Articles of the shards that ``names`` lists (column ``name``), such as a draw; a file list is metadata."""
    paths = [f"{folder}/{r['name']}" for r in names.select("name").distinct().orderBy("name").collect()]
    return read_articles(spark, paths, **options)


def sweep(spark: SparkSession, folder: str, pattern: str = "pubmed25n*.xml.gz", **options) -> tuple[DataFrame, DataFrame]:
    """All articles of all shards in ``folder``, and what was rejected."""
    return read_articles(spark, f"{folder}/{pattern}", **options)
