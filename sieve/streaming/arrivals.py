"""Article chunk files that arrive over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sieve.functions.text import null_if_missing
from sieve.sources.tables import _CSV


def arriving_chunks(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """Rows of the CSV files below ``folder``, each file once."""
    rows = (
        spark.readStream.options(**_CSV)
        .option("recursiveFileLookup", True)
        .option("maxFilesPerTrigger", files_per_batch)
        .schema(schema)
        .csv(folder)
    )
    return rows.select(*[null_if_missing(F.col(f.name)).alias(f.name) for f in schema])


def collect_chunks(chunks: DataFrame, table: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append what has arrived to a Parquet table and stop; run again for what comes later.

    Copies of an article are settled when the table is read (``one_per_pid``), so the stream keeps
    no state that grows with the ids seen.
    """
    return (
        chunks.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
