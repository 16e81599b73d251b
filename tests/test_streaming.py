from __future__ import annotations

import datetime as dt
import random

from sieve import schemas
from sieve.operators.spool import new_dir
from sieve.sources.tables import write_csv
from sieve.streaming import arrivals
from sieve.streaming import open_verdicts as O
from sieve.streaming import verdicts as V


def at(s):
    return dt.datetime(2025, 1, 1, 0, 0, s)


EVENTS = [
    ("t", "a", "Relevant", at(1), 1), ("t", "a", "Irrelevant", at(5), 2), ("t", "b", "Relevant", at(3), 3),
    ("t", "b", "Irrelevant", at(3), 4), ("u", "a", "Relevant", at(9), 5), ("t", "a", "Relevant", at(4), 6),
]
LATEST = {("t", "a", "Irrelevant"), ("t", "b", "Irrelevant"), ("u", "a", "Relevant")}


def test_latest(spark):
    events = spark.createDataFrame(EVENTS, schemas.VERDICT_EVENT)
    assert {tuple(r)[:3] for r in V.latest_verdicts(events).collect()} == LATEST


def test_stream_equals_batch_and_resumes(spark):
    folder = new_dir(spark, "verdicts")

    def land(part):
        spark.createDataFrame(part, schemas.VERDICT_EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")

    def run():
        stream = spark.readStream.schema(schemas.VERDICT_EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        V.stream_verdicts(stream, f"{folder}/table", f"{folder}/progress").awaitTermination()
        return {tuple(r)[:3] for r in V.read_verdicts(spark, f"{folder}/table").collect()}

    land(EVENTS[:2])
    land(EVENTS[2:4])
    assert run() == {("t", "a", "Irrelevant"), ("t", "b", "Irrelevant")}
    land(EVENTS[4:])  # one of them older than what is known
    assert run() == LATEST


def test_turning_to_another_topic_clears(spark):
    rows = [
        ("r", "t", "a", "Relevant", at(1), 1), ("r", "u", "a", "Relevant", at(2), 2),
        ("r", "t", "b", "Relevant", at(3), 3), ("r", "t", "b", "Irrelevant", at(4), 4),
        ("s", "t", "a", "Relevant", at(1), 5),
    ]
    events = spark.createDataFrame(
        rows, "reviewer string, topic_id string, article_id string, verdict string, ts timestamp, event_id long"
    )
    got = {tuple(r)[:4] for r in V.open_verdicts(events).collect()}
    assert got == {("r", "t", "b", "Irrelevant"), ("s", "t", "a", "Relevant")}


def test_chunk_files_arrive_over_time(spark):
    folder = new_dir(spark, "arrivals")
    make = lambda *r: spark.createDataFrame(r, schemas.CHUNK_CSV)

    def run():
        rows = arrivals.arriving_chunks(spark, f"{folder}/in", schemas.CHUNK_CSV)
        arrivals.collect_chunks(rows, f"{folder}/table", f"{folder}/progress").awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/table").collect())

    write_csv(make(("1", "a", "x,\ny")), f"{folder}/in/chunk_0")
    assert run() == [("1", "a", "x,\ny")]
    write_csv(make(("2", "b", "z")), f"{folder}/in/chunk_1")
    assert run() == [("1", "a", "x,\ny"), ("2", "b", "z")]


EVENT = "reviewer string, topic_id string, article_id string, verdict string, ts timestamp, event_id long"


def reviews(n, reviewers, seed):
    draw = random.Random(seed)
    out, topic = [], {}
    for i in range(n):
        who = f"r{draw.randrange(reviewers)}"
        if draw.random() < 0.15:
            topic[who] = draw.choice("tuv")
        out.append((who, topic.setdefault(who, "t"), f"a{draw.randrange(9)}", draw.choice(["Relevant", "Irrelevant"]),
                    dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i // 2, microseconds=draw.randrange(2)), i))
    return out


def land_and_run(spark, folder, parts, **options):
    for part in parts:
        spark.createDataFrame(part, EVENT).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = O.stream_open_verdicts(stream, f"{folder}/table", f"{folder}/progress", **options)
    query.awaitTermination()
    got = {tuple(r) for r in O.read_open_changes(spark, f"{folder}/table").collect()}
    return got, [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_state_is_cleared_inside_the_stream(spark):
    """In order, shuffled, and resumed with late events: always what the batch says, and no more in the state."""
    events = reviews(240, 6, 1)
    late = random.Random(2).sample(events, len(events))
    for order in (events, late):
        folder = new_dir(spark, "open")
        land_and_run(spark, folder, [order[:80], order[80:160]])
        got, _ = land_and_run(spark, folder, [order[160:], order[:5]])  # and some once more
        want = {tuple(r) for r in V.open_verdicts(spark.createDataFrame(events, EVENT)).select(
            "reviewer", "topic_id", "article_id", "verdict", "ts", "event_id").collect()}
        assert got == want and want


def test_state_shrinks_when_a_topic_is_left(spark):
    many = [("r", "t", f"a{i}", "Relevant", at(i % 50), i) for i in range(40)]
    folder = new_dir(spark, "open")
    got, full = land_and_run(spark, folder, [many])
    assert len(got) == 40
    got, after = land_and_run(spark, folder, [[("r", "u", "b", "Relevant", at(55), 99)]])
    assert {r[2] for r in got} == {"b"} and after[-1] <= full[-1] - 38


def test_idle_reviewers_leave(spark):
    day = lambda d: dt.datetime(2025, 1, 1) + dt.timedelta(days=d)
    folder = new_dir(spark, "open")
    parts = [[("idle", "t", "a", "Relevant", day(0), 1)], [("busy", "t", "a", "Relevant", day(50), 2)], [("busy", "t", "b", "Relevant", day(51), 3)]]
    got, _ = land_and_run(spark, folder, parts[:1], idle="30 days")
    assert {r[0] for r in got} == {"idle"}
    got, _ = land_and_run(spark, folder, parts[1:], idle="30 days")
    assert {r[0] for r in got} == {"busy"} and len(got) == 2
