"""Batches for training, exported as bounded files with an index.

A file holds a run of consecutive batches of one group, in order, so a reader may start at any batch,
go on where it stopped, or fetch one batch, and opens the files that hold it and no others.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sieve.operators.spool import path_exists, publish

PER_FILE = 1024  # batches
_DONE = "complete"


def write_batches(rows: DataFrame, path: str, keys: Sequence[str] = ("topic_id",), per_file: int = PER_FILE) -> None:
    """Write ``rows`` (with ``batch_id`` and ``row_in_batch``, as ``ranking.batched`` adds them) and their index.

    Batches ``per_file`` at a time are one task's work and one file, so a large group is written by many tasks.
    A null key is a group like others. The export counts as complete when its last file is there; before
    that it cannot be read.
    """
    keys = list(keys)
    if path_exists(rows.sparkSession, path):
        raise FileExistsError(path)
    numbered = rows.withColumn("file_no", F.floor(F.col("batch_id") / per_file).cast("bigint"))
    order = [*keys, "file_no", "batch_id", "row_in_batch"]
    dealt = numbered.repartition(*keys, "file_no").sortWithinPartitions(*order)
    dealt.write.partitionBy(*keys, "file_no").parquet(f"{path}/rows")
    spark = rows.sparkSession
    stored = spark.read.schema(numbered.schema).parquet(f"{path}/rows")
    places = stored.select(*keys, "batch_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("_at"))
    index = places.groupBy(*keys, "batch_id", "file").agg(F.min("_at").alias("first_row"), F.count("*").alias("n_rows"))
    index.sort(*keys, "batch_id").write.parquet(f"{path}/index")
    publish(spark, f"{path}/{_DONE}", str(per_file))


def batch_index(spark: SparkSession, path: str) -> DataFrame:
    """keys, batch_id, file, first_row, n_rows: where each batch lies."""
    if not path_exists(spark, f"{path}/{_DONE}"):
        raise FileNotFoundError(f"no complete export in {path}")
    return spark.read.parquet(f"{path}/index")


def _same(key: dict[str, object]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in key.items()], F.lit(True))


def _rows(spark: SparkSession, path: str, files: Sequence[str]) -> DataFrame:
    """Stored rows with their keys as they were written; a folder's name alone would not tell 007 from 7."""
    index = batch_index(spark, path)
    keys = index.drop("batch_id", "file", "first_row", "n_rows").schema
    own = spark.read.parquet(f"{path}/index").schema["batch_id"]
    written = [f for f in spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").schema if f.name not in (*keys.names, "file_no")]
    schema = StructType([*written, *keys, StructField("file_no", own.dataType)])
    return spark.read.option("basePath", f"{path}/rows").schema(schema).parquet(*files)


def read_batch(spark: SparkSession, path: str, batch_id: int, **key: object) -> DataFrame:
    """The rows of one batch of the group ``key``, in order; its file alone is opened, at the batch's rows."""
    places = batch_index(spark, path).filter(_same(key) & (F.col("batch_id") == batch_id)).collect()  # one row
    if not places:
        raise LookupError(f"no batch {batch_id} of {key} in {path}")
    at = F.col("_metadata.row_index")
    inside = reduce(lambda a, b: a | b, [at.between(p["first_row"], p["first_row"] + p["n_rows"] - 1) for p in places])
    rows = _rows(spark, path, [p["file"] for p in places])
    return rows.filter(inside & (F.col("batch_id") == batch_id)).drop("file_no").orderBy("row_in_batch")


def read_from(spark: SparkSession, path: str, batch_id: int = 0, **key: object) -> DataFrame:
    """All batches of the group ``key`` from ``batch_id`` on; files before it are not opened."""
    batch_index(spark, path)
    per_file = int(spark.read.text(f"{path}/{_DONE}").first()[0])
    rows = _rows(spark, path, [f"{path}/rows"])
    return rows.filter(_same(key) & (F.col("file_no") >= batch_id // per_file) & (F.col("batch_id") >= batch_id)).drop("file_no")
