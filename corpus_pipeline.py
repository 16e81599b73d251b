"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again for the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.llm import language, minhash, mixing, pseudonyms
from sieve.llm.bpe import round_trip
from sieve.llm.common import prepared
from sieve.llm.queries import PSEUDONYM_KEY, tokenizer
from sieve.operators.spool import spool


SIMILARITY = 80  # per cent of shared five-word shingles from which documents are near copies


OWN = ("doc_id", "text", "lang", "source")


def folded(docs: DataFrame) -> DataFrame:
    """The columns the stages work on, and all others in one, so that no name of theirs meets one a stage uses."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    return docs.select(*OWN, *([F.struct(*others).alias("_others")] if others else []))


def unfolded(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    return found.select(*[F.col(c) if c in OWN else F.col("_others")[c].alias(c) for c in docs.columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; the others go, and so do those without letters (null and empty texts too)."""
    prepared(spark)
    rows = folded(docs)
    model = language.fit_texts(rows, "lang")
    found = language.identified(rows, model, declared=F.col("lang"), host=F.col("source"))
    return unfolded(found.filter("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: the one with the smallest id, also where ids repeat or are null."""
    prepared(spark)
    return unfolded(minhash.deduplicated(folded(docs), SIMILARITY, single=True), docs)


def protect_persons(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced in the texts; ``n_chars`` follows the text. Every row stays, a null text stays null."""
    prepared(spark)
    found = unfolded(pseudonyms.pseudonymised(folded(docs), PSEUDONYM_KEY, count="_n_values"), docs)
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return found


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of each document as the target of its source demands; texts without words are not taken into account."""
    prepared(spark)
    rows = folded(docs)
    return unfolded(mixing.emitted(mixing.planned(rows), rows.columns), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, digested, and the check that they decode to the text."""
    return round_trip(folded(docs), tokenizer(prepared(spark)), keep=["doc_id", "lang", "source"])


STAGES = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_copies),
    ("PII", protect_persons),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

# Language ID, MinHash and the tokenizer cannot be said in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name.replace(" ", "-")).df
    return STAGES[-1][1](spark, docs, sf_dir)
