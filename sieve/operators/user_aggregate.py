"""Aggregates that a user writes over the rows of a group, in tasks and merged.

A user gives four functions: a first state, the state after some rows, two states in one, and the
result. Tasks keep one state per group and pass it on as bytes; the states of a group, one per task
at most, are merged in two steps, so a group that holds most rows is worked on by all tasks and no
task sees more than its share of rows or a few hundred states.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HELD = 50_000  # groups a task holds before it passes their states on
FAN_IN = 128  # states that one step merges


class UserAggregate(Protocol):
    """``update`` gets the group's rows as a pandas frame of the columns asked for; the order of rows and of
    merges is not defined. A state is whatever pickle can write; its size is the user's affair."""

    def init(self) -> Any: ...

    def update(self, state: Any, rows: pd.DataFrame) -> Any: ...

    def merge(self, a: Any, b: Any) -> Any: ...

    def finish(self, state: Any) -> Any: ...


def aggregate_rows(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], aggregate: UserAggregate, returns: str, name: str = "value") -> DataFrame:
    """``keys`` and ``name``, of type ``returns``: one row per group. A null in a key is a group like others; without
    rows there are no groups."""
    keys, columns = list(keys), list(columns)
    # One text per group keeps null and types of keys whatever they are.
    slim = rows.select(F.to_json(F.struct(*keys)).alias("_key"), *columns)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[str, Any] = {}
        task = TaskContext.get().partitionId()

        def out() -> pa.RecordBatch:
            packed = [pickle.dumps(s) for s in states.values()]
            return pa.RecordBatch.from_arrays(
                [pa.array(list(states), pa.string()), pa.array([task] * len(states), pa.int32()), pa.array(packed, pa.binary())],
                names=["_key", "_task", "_state"],
            )

        for batch in batches:
            frame = batch.to_pandas()
            for key, part in frame.groupby("_key", sort=False):
                state = states[key] if key in states else aggregate.init()
                states[key] = aggregate.update(state, part[columns])
            if len(states) > HELD:
                yield out()
                states.clear()
        if states:
            yield out()

    def merged(packed: pd.Series) -> Any:
        states = [pickle.loads(p) for p in packed]
        total = states[0]
        for s in states[1:]:
            total = aggregate.merge(total, s)
        return total

    @F.pandas_udf("binary")
    def together(states: pd.Series) -> bytes:
        return pickle.dumps(merged(states))

    @F.pandas_udf(returns)
    def result(states: pd.Series) -> Any:  # noqa: ANN401
        return aggregate.finish(merged(states))

    states = slim.mapInArrow(partial, "_key string, _task int, _state binary")
    some = states.groupBy("_key", F.floor(F.col("_task") / FAN_IN).alias("_some")).agg(together("_state").alias("_state"))
    done = some.groupBy("_key").agg(result("_state").alias(name))
    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.select(*keys).dtypes)
    return done.select(F.from_json("_key", kinds).alias("_k"), name).select(*[F.col("_k")[k].alias(k) for k in keys], name)
