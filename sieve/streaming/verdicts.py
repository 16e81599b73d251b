"""Reviewer verdicts, as a table and as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sieve.operators.spool import children, delete, lookup

KEYS = ("topic_id", "article_id")


def latest_verdicts(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last verdict per article; of equal times the higher event_id wins.

    Works on batch and streaming input alike. State is one row per article.
    """
    newest = F.max(F.struct("ts", "event_id", "verdict")).alias("_v")
    return events.groupBy(*keys).agg(newest).select(*keys, "_v.verdict", "_v.ts", "_v.event_id")


def open_verdicts(events: DataFrame, reviewer: str = "reviewer") -> DataFrame:
    """Verdicts a reviewer still sees: turning to another topic clears those given before.

    Two grouped maxima find the current topic and when the reviewer last was on another one.
    """
    when = F.struct("ts", "event_id")
    visits = events.groupBy(reviewer, "topic_id").agg(F.max(when).alias("_last"))
    by_reviewer = visits.groupBy(reviewer).agg(F.max(F.struct("_last", "topic_id")).alias("_now"))
    current = by_reviewer.select(reviewer, F.col("_now.topic_id").alias("_topic"))
    left = visits.join(current, reviewer).filter(F.col("topic_id") != F.col("_topic"))
    left = left.groupBy(reviewer).agg(F.max("_last").alias("_left"))
    state = current.join(left, reviewer, "left")
    live = lookup(events, state, [reviewer], "inner", spread="event_id").filter(
        (F.col("topic_id") == F.col("_topic")) & (F.col("_left").isNull() | (when > F.col("_left")))
    )
    return latest_verdicts(live.drop("_topic", "_left"), (reviewer, *KEYS))


def stream_verdicts(events: DataFrame, table: str, checkpoint: str, keys: Sequence[str] = KEYS,
                    **trigger) -> StreamingQuery:
    """Keep ``table`` up to date: each batch adds the verdicts it changed.

    A batch writes its own folder and replaces it when it is repeated after a failure, so nothing
    is counted twice. ``read_verdicts`` collapses the changes.
    """

    def add(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch_id={batch}")

    return (
        latest_verdicts(events, keys)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(add)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_verdicts(spark: SparkSession, table: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return latest_verdicts(spark.read.parquet(table).drop("batch_id"), keys)


def read_open_verdicts(spark: SparkSession, table: str, reviewer: str = "reviewer") -> DataFrame:
    """``open_verdicts`` of a stream whose keys are reviewer, topic and article.

    The last verdict per article holds the last time on every topic, so clearing what came before a
    change of topic needs no more than the table.
    """
    return open_verdicts(read_verdicts(spark, table, (reviewer, *KEYS)), reviewer)


def compact_verdicts(spark: SparkSession, table: str, keys: Sequence[str] = KEYS) -> None:
    """Collapse the batches written so far into one folder and delete theirs.

    The collapsed rows are complete before anything is deleted, and reading some rows twice changes
    nothing, so readers and a broken-off run are safe. Run it between runs of the stream.
    """
    batches = sorted(int(p.rsplit("=", 1)[1]) for p in children(spark, table) if "batch_id=" in p)
    if len(batches) < 2:
        return
    target = min(0, *batches) - 1  # ids of the stream are not negative
    read_verdicts(spark, table, keys).write.mode("errorifexists").parquet(f"{table}/batch_id={target}")
    for batch in batches:
        delete(spark, f"{table}/batch_id={batch}")
