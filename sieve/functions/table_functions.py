"""Table functions for SQL: rows out of a value, called laterally, and rows out of the groups of a table.

Both tell their columns from their arguments. ``register`` makes them known to a session.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from sieve.operators.spool import lookup


def _name(argument: AnalyzeArgument, what: str) -> str:
    if not argument.isConstantExpression or not isinstance(argument.value, str) or not argument.value:
        raise ValueError(f"{what} must be a constant text")
    return argument.value


class SplitText:
    """``split_text(text, separator, part_column)``: one row per part, numbered from 1 in ``part_column || '_no'``.

    A null text has no rows, an empty one has one empty part.
    """

    @staticmethod
    def analyze(text: AnalyzeArgument, separator: AnalyzeArgument, part: AnalyzeArgument) -> AnalyzeResult:
        _name(separator, "the separator")
        name = _name(part, "the name of the part")
        return AnalyzeResult(StructType().add(f"{name}_no", LongType()).add(name, StringType()))

    def eval(self, text: str | None, separator: str, part: str) -> Iterator[tuple]:
        if text is not None:
            yield from enumerate(text.split(separator), 1)


class NumberedBatches:
    """``numbered_batches(TABLE(rows), group_column, order_column, size[, part_column, before_column])``: the rows with
    ``batch_id`` and ``row_in_batch`` (from 0) within each group, in order.

    Columns, partitioning and sorting follow from the arguments. A group goes through one task as a stream, row by
    row. Where the last two columns are named, each part of a group goes through a task of its own and counts on from
    the rows before it; ``parted`` adds them.
    """

    @staticmethod
    def analyze(
        rows: AnalyzeArgument, group: AnalyzeArgument, order: AnalyzeArgument, size: AnalyzeArgument,
        part: AnalyzeArgument | None = None, before: AnalyzeArgument | None = None,
    ) -> AnalyzeResult:
        schema = rows.dataType
        by, at = _name(group, "the group"), _name(order, "the order")
        if (part is None) != (before is None):
            raise ValueError("a part needs the number of rows before it")
        more = [] if part is None else [_name(part, "the part"), _name(before, "the rows before")]
        for c in (by, at, *more):
            if c not in schema.fieldNames():
                raise ValueError(f"no column {c} in {schema.fieldNames()}")
        if not size.isConstantExpression or not isinstance(size.value, int) or size.value < 1:
            raise ValueError("the size of a batch must be a constant above 0")
        out = StructType([*schema.fields]).add("batch_id", LongType()).add("row_in_batch", LongType())
        return AnalyzeResult(schema=out, partitionBy=[PartitioningColumn(c) for c in (by, *more[:1])], orderBy=[OrderingColumn(at)])

    def __init__(self):
        self.seen = None

    def eval(self, rows: Row, group: str, order: str, size: int, part: str | None = None, before: str | None = None) -> Iterator[tuple]:
        if self.seen is None:
            self.seen = 0 if before is None else rows[before]
        yield (*rows, self.seen // size, self.seen % size)
        self.seen += 1


def parted(rows: DataFrame, group: str, order: str, digits: int = 2) -> DataFrame:
    """``rows`` with ``part``, the first ``digits`` characters of the text ``order``, and ``before``, how many rows of the
    group lie in earlier parts. ``rows`` are read twice. An order that begins with a hash gives even parts."""
    rows = rows.withColumn("part", F.substring(F.col(order), 1, digits))
    sizes = rows.groupBy(group, "part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("before", F.coalesce(earlier, F.lit(0)).cast("bigint")).drop("_n")
    return lookup(rows, starts, [group, "part"], "inner", spread=order, null_safe=True)


def register(spark: SparkSession) -> None:
    """``split_text`` and ``numbered_batches`` in the session's SQL; with Arrow, every call would make a batch of its own."""
    spark.udtf.register("split_text", udtf(SplitText, useArrow=False))
    spark.udtf.register("numbered_batches", udtf(NumberedBatches, useArrow=False))
