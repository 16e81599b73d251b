"""The registry, the test tables as topics, judgments and articles, and shared SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.session import apply_defaults
from sieve.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Expressions, not Columns: a Column needs a running session.
ARTICLE_COLUMNS = (
    "cast(doc_id as string) as pid", "substring_index(text, '\\n', 1) as title", "text as abstract",
)


class Tables:
    """documents and labels seen as a review: a document is an article, its language (or source)
    the topic, ``toxic`` the relevance, and unlabelled documents are articles nobody judged."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    def articles(self, *more: str) -> DataFrame:
        return self.table("documents").selectExpr(*ARTICLE_COLUMNS, *more)

    def texts(self, *more: str) -> DataFrame:
        """The articles, for work on every token."""
        return spread(self.table("documents")).selectExpr(*ARTICLE_COLUMNS, *more)

    def judgments(self, topic: str = "lang") -> DataFrame:
        docs = self.table("documents").select("doc_id", F.col(topic).alias("topic_id"))
        return self.table("labels").join(docs, "doc_id").select(
            "topic_id", F.col("doc_id").cast("string").alias("pid"), F.col("toxic").alias("relevance"), "quality"
        )

    def citations(self, topic: str = "lang", relevance: str = "toxic") -> DataFrame:
        return (
            spread(self.table("documents"))
            .join(self.table("labels"), "doc_id")
            .selectExpr(f"{topic} as topic_id", *ARTICLE_COLUMNS, f"{relevance} as relevance")
        )


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(Tables(apply_defaults(spark), folder))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def rounded(col: str | Column, digits: int = 6) -> Column:
    """Doubles are compared after rounding: two engines add in different orders."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


# ---- SQL shared by the oracles -------------------------------------------------------------

TOKEN_SQL = r"([\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x0b\x1c-\x1f\x85])"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN_SQL}', 1)"


def citations_sql(topic: str = "lang", relevance: str = "toxic") -> str:
    return f"""citations AS (
  SELECT d.{topic} AS topic_id, CAST(d.doc_id AS VARCHAR) AS pid, split_part(d.text, chr(10), 1) AS title,
         d.text AS abstract, l.{relevance} AS relevance
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


ARTICLES_SQL = """articles AS (
  SELECT CAST(doc_id AS VARCHAR) AS pid, split_part(text, chr(10), 1) AS title, text AS abstract, lang, source
  FROM documents)"""

BALANCED_SQL = """class_sizes AS (
  SELECT topic_id, count(*) FILTER (WHERE relevance = 0) AS n_neg,
         count(*) FILTER (WHERE relevance = 1) AS n_pos FROM citations GROUP BY topic_id),
balanced AS (
  SELECT c.topic_id, c.pid, c.title, c.abstract, c.relevance
  FROM (SELECT *, row_number() OVER (PARTITION BY topic_id, relevance ORDER BY md5('42:' || pid), pid) AS rn
        FROM citations) c JOIN class_sizes s ON c.topic_id = s.topic_id
  WHERE rn <= least(n_neg, n_pos))"""

SPLIT_SQL = """class_counts AS (
  SELECT topic_id, relevance, count(*) AS n_c FROM balanced GROUP BY topic_id, relevance),
topic_counts AS (
  SELECT topic_id, CAST(sum(n_c) AS BIGINT) AS n, (CAST(sum(n_c) AS BIGINT) * 25 + 99) // 100 AS n_test
  FROM class_counts GROUP BY topic_id),
shares AS (
  SELECT c.topic_id, relevance, (n_test * n_c) // n AS whole, (n_test * n_c) % n AS rest, n_test
  FROM class_counts c JOIN topic_counts t ON c.topic_id = t.topic_id),
quotas AS (
  SELECT topic_id, relevance, whole + CASE WHEN
      row_number() OVER (PARTITION BY topic_id ORDER BY rest DESC, relevance)
      <= n_test - sum(whole) OVER (PARTITION BY topic_id) THEN 1 ELSE 0 END AS quota
  FROM shares),
split AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.topic_id, b.relevance
              ORDER BY md5('42:' || pid), pid) <= quota AS is_test
  FROM balanced b JOIN quotas q ON b.topic_id = q.topic_id AND b.relevance = q.relevance)"""

MODEL_SQL = f"""train_tokens AS (
  SELECT topic_id, relevance, unnest(list_concat({tokens_sql('lower(title)')}, {tokens_sql('lower(abstract)')})) AS token
  FROM split WHERE NOT is_test),
token_counts AS (
  SELECT topic_id, token, count(*) FILTER (WHERE relevance = 1) AS c_pos,
         count(*) FILTER (WHERE relevance = 0) AS c_neg FROM train_tokens GROUP BY topic_id, token),
token_totals AS (
  SELECT topic_id, sum(c_pos) AS p, sum(c_neg) AS n, count(*) AS v FROM token_counts GROUP BY topic_id),
weights AS (
  SELECT c.topic_id, token,
         round(ln((c_pos + 1) / CAST(p + v AS DOUBLE)) - ln((c_neg + 1) / CAST(n + v AS DOUBLE)), 6) AS weight,
         c_pos, c_neg
  FROM token_counts c JOIN token_totals t ON c.topic_id = t.topic_id),
priors AS (
  SELECT topic_id, ln(count(*) FILTER (WHERE relevance = 1)
                      / CAST(count(*) FILTER (WHERE relevance = 0) AS DOUBLE)) AS prior
  FROM split WHERE NOT is_test GROUP BY topic_id)"""

LONG_SQL = f"""long_tokens AS (
  SELECT topic_id, pid, 'title' AS field, unnest({tokens_sql('title')}) AS token,
         generate_subscripts({tokens_sql('title')}, 1) - 1 AS pos FROM split WHERE is_test
  UNION ALL
  SELECT topic_id, pid, 'abstract', unnest({tokens_sql('abstract')}),
         generate_subscripts({tokens_sql('abstract')}, 1) - 1 FROM split WHERE is_test),
attributions AS (
  SELECT l.topic_id, l.pid, field, pos, l.token, coalesce(weight, 0) AS value
  FROM long_tokens l LEFT JOIN weights w ON l.topic_id = w.topic_id AND lower(l.token) = w.token)"""

SCORES_SQL = """scores AS (
  SELECT s.topic_id, s.pid, s.relevance AS label, prior + coalesce(total, 0) AS logit,
         1 / (1 + exp(-(prior + coalesce(total, 0)))) AS prob
  FROM split s LEFT JOIN (SELECT topic_id, pid, sum(value) AS total FROM attributions GROUP BY topic_id, pid) a
       ON s.topic_id = a.topic_id AND s.pid = a.pid
  LEFT JOIN priors p ON s.topic_id = p.topic_id WHERE is_test)"""

VERDICTS_SQL = """verdicts AS (
  SELECT topic_id, pid, CASE WHEN prob >= 0.5 THEN 'Relevant' WHEN prob < 0.5 THEN 'Irrelevant'
         ELSE 'Error' END AS verdict FROM scores)"""

SCREEN_SQL = (citations_sql(), BALANCED_SQL, SPLIT_SQL)
TRAIN_SQL = (*SCREEN_SQL, MODEL_SQL)
SCORE_SQL = (*TRAIN_SQL, LONG_SQL, SCORES_SQL)


def with_sql(parts, select: str) -> str:
    return "WITH " + ",\n".join([parts] if isinstance(parts, str) else parts) + "\n" + select
