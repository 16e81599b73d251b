"""Distinct counts kept as sketches, one per chunk of arriving rows, so that a new chunk needs no second look at the old ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PRECISION = 14  # 2**14 registers: a standard error of 0.8 per cent


def add_chunk(rows: DataFrame, path: str, chunk: int, column: str, keys: Sequence[str] = (), precision: int = PRECISION) -> None:
    """Store what ``rows`` say about the distinct values of ``column`` per group. Adding a chunk again replaces it.

    A null value is none; a group of nulls only has a sketch that counts 0. Tasks make the sketches, so only they are shuffled.
    """
    sketch = F.hll_sketch_agg(F.col(column).cast("string"), precision).alias("sketch")
    rows.groupBy(*keys).agg(sketch).write.mode("overwrite").parquet(f"{path}/chunk={chunk}")


def stream_chunks(rows: DataFrame, path: str, checkpoint: str, column: str, keys: Sequence[str] = (), **trigger) -> StreamingQuery:
    """A sketch for every batch of a stream; a batch that is repeated after a failure replaces its own."""
    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(lambda batch, number: add_chunk(batch, path, number, column, keys))
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def distinct_estimate(spark: SparkSession, path: str, keys: Sequence[str] = (), name: str = "n") -> DataFrame:
    """Distinct values per group over all chunks, from the sketches alone; with fewer ``keys`` than stored, of the union."""
    merged = spark.read.parquet(path).groupBy(*keys).agg(F.hll_union_agg("sketch").alias("sketch"))
    return merged.select(*keys, F.hll_sketch_estimate("sketch").alias(name))
