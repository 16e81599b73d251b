"""What several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.operators.spool import Spooled, spool
from sieve.session import apply_defaults

# Words are runs of anything but these six characters (fixed by the contracts of the queries).
SPACE = r"\x20\x09-\x0D"

# Python workers get texts in batches; texts may be long, so a batch holds few of them.
BATCH_ROWS = 128


def prepared(spark: SparkSession) -> SparkSession:
    """The session with the settings the operators of this package count on."""
    apply_defaults(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of words in a text that is not null, without building the words one by one in Python."""
    pieces = F.size(F.split(text, f"[{SPACE}]+"))
    led = text.rlike(f"^[{SPACE}]").cast("int")
    ended = text.rlike(f"[{SPACE}]\\z").cast("int")
    return F.when(text == "", 0).otherwise(pieces - led - ended).cast("bigint")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


__all__ = [
    "BATCH_ROWS", "SPACE", "Spooled", "documents", "free_name", "lower_ascii", "prepared", "spool", "text_or_empty",
    "word_count",
]
