"""Open verdicts with state that is cleared inside the stream.

A reviewer's state is the current topic, the last time on any other topic, and the verdicts given on the
current topic since then. Events may come in any order: one on another topic, late or not, moves that time
on and takes out of the state what it clears, and one that is older than it changes nothing. So the state
of a reviewer never holds more than what is open, and the stream ends where ``open_verdicts`` ends on the
same events. A reviewer who is idle for ``idle`` of event time leaves the state and takes the open verdicts
along.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

CHANGE = "reviewer string, change string, topic_id string, article_id string, verdict string, ts timestamp, event_id bigint, step bigint"
_CHANGED = Row("reviewer", "change", "topic_id", "article_id", "verdict", "ts", "event_id", "step")
_NEVER = -(2**63)
_BEFORE = (-(2**62), -(2**62))


def _fields(*names: str) -> StructType:
    """A schema made without a session, which the process that sets up the state does not have."""
    text = ("topic_id", "article_id", "verdict")
    return StructType([StructField(n, StringType() if n in text else LongType()) for n in names])


class OpenVerdicts(StatefulProcessor):
    """Changes of a reviewer's open verdicts: ``set`` for a verdict that opens or is revised, ``clear`` with the
    time up to which all is cleared, ``leave`` for a reviewer who is gone. ``step`` numbers a reviewer's changes."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", _fields("topic_id", "top_ts", "top_id", "left_ts", "left_id", "step"))
        self.open = handle.getMapState("open", _fields("article_id"), _fields("verdict", "ts", "event_id"))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        """The state is read once and written once per call, for each access is a message to the JVM."""
        place = self.place.get()
        if place is not None:
            topic, *numbers, step = place
            top, left = tuple(numbers[:2]), tuple(numbers[2:])
            stored = {article: (verdict, ts, event) for (article,), (verdict, ts, event) in self.open.iterator()}
        else:
            topic, top, left, step, stored = None, _BEFORE, _BEFORE, 0, {}
        known = dict(stored)
        out: list[Row] = []
        # A null time counts as older than all others, which opens nothing.
        events = [(r["micros"] if r["micros"] is not None else _NEVER, r["event_id"], r["topic_id"], r["article_id"], r["verdict"]) for r in rows]
        for at, event, name, article, verdict in sorted(events, key=lambda e: e[:2]):
            now, moved = (at, event), False
            if now > top:
                if topic is not None and name != topic:
                    left, moved = top, True
                topic, top = name, now
            elif name != topic and now > left:
                left, moved = now, True
            if moved:
                known = {a: v for a, v in known.items() if v[1:] > left}
                step += 1
                out.append(_CHANGED(key[0], "clear", topic, None, None, *left, step))
            if name == topic and now > left and now >= (known[article][1:] if article in known else _BEFORE):
                known[article] = (verdict, *now)
                step += 1
                out.append(_CHANGED(key[0], "set", topic, article, verdict, *now, step))
        self.place.update((topic, *top, *left, step))
        if stored and not stored.keys() & known.keys():
            self.open.clear()
        else:
            for article in stored.keys() - known.keys():
                self.open.removeKey((article,))
        for article, value in known.items():
            if stored.get(article) != value:
                self.open.updateValue((article,), value)
        if self.idle_ms is not None:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(top[0] // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        topic, top_ts, top_id, _, _, step = self.place.get()
        self.place.clear()
        self.open.clear()
        yield _CHANGED(key[0], "leave", topic, None, None, top_ts, top_id, step + 1)

    def close(self) -> None:
        pass


def stream_open_verdicts(events: DataFrame, table: str, checkpoint: str, idle: str | None = None, late: str = "1 hour", **trigger) -> StreamingQuery:
    """Keep a table of changes of open verdicts. ``events``: reviewer, topic_id, article_id, verdict, ts, event_id.

    With ``idle`` (such as "30 days") a reviewer leaves the state after that much event time without events;
    ``late`` is how far events may lag behind the newest, and those that lag more are dropped by Spark then.
    """
    ms = None
    if idle is not None:
        ms = events.sparkSession.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-01 00:00:00' + INTERVAL {idle}) AS BIGINT)").first()[0]
        events = events.withWatermark("ts", late)
    # Times travel as numbers: they mean the same in every process, and cost no conversion per row.
    changes = events.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp"))).groupBy("reviewer").transformWithState(
        statefulProcessor=OpenVerdicts(ms), outputStructType=StructType.fromDDL(CHANGE.replace("ts timestamp", "ts bigint")),
        outputMode="Update", timeMode="None" if ms is None else "EventTime",
    ).withColumn("ts", F.timestamp_micros("ts"))

    def add(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{table}/batch_id={batch}")

    return (
        changes.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(add)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def read_open_changes(spark: SparkSession, table: str) -> DataFrame:
    """The verdicts that are open: reviewer, topic_id, article_id, verdict, ts, event_id.

    Of a reviewer's changes only those behind the last ``leave`` count; a ``set`` stays while it is newer than
    the last ``clear`` and on its topic.
    """
    changes = spark.read.schema(f"{CHANGE}, batch_id bigint").parquet(table)
    order = F.struct("batch_id", "step")
    last = lambda kind, *more: F.max(F.when(F.col("change") == kind, F.struct(order.alias("at"), *more)))
    marks = changes.groupBy("reviewer").agg(
        last("leave").alias("_gone"), last("clear", F.struct("ts", "event_id").alias("when"), "topic_id").alias("_cleared"))
    sets = changes.filter("change = 'set'").join(marks, "reviewer")
    behind = F.col("_gone").isNull() | (order > F.col("_gone.at"))
    cleared = F.when(F.col("_gone").isNull() | (F.col("_cleared.at") > F.col("_gone.at")), F.col("_cleared"))
    live = sets.filter(behind & (cleared.isNull() | (
        (F.struct("ts", "event_id") > cleared["when"]) & (F.col("topic_id") == cleared["topic_id"]))))
    newest = F.row_number().over(Window.partitionBy("reviewer", "article_id").orderBy(F.desc("batch_id"), F.desc("step")))
    return live.withColumn("_n", newest).filter("_n = 1").select("reviewer", "topic_id", "article_id", "verdict", "ts", "event_id")
