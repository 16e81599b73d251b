"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0..n-1 in a total order, and a keyed Feistel network permutes the numbers. The
network works on a grid of a * b >= n cells with a*b - n < a; a result outside 0..n-1 goes through
the network again until it lands inside (cycle walking), so the numbers 0..n-1 are permuted among
themselves. Shard and slot follow from the permuted number by division, in both directions:
``place_of`` finds the shard and slot of a row number, ``row_at`` the row number in a slot.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import free_name
from sieve.operators.ranking import ranked
from sieve.operators.spool import spool

ROUNDS = 8
# At most a - 1 cells lie outside 0..n-1 and a walk leaves each of them once, so for n <= 4096 a walk
# ends within 64 steps; above that, a step lands outside with probability below 1/64, and a walk
# that did not end would raise an error, not give a wrong place.
WALK = 64


def grid(n: int) -> tuple[int, int]:
    """Sides (a, b) of the smallest near-square grid with at least n cells."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _round(key: str, number: Column, half: Column) -> Column:
    digest = F.md5(F.concat(F.lit(f"{key}:"), number.cast("string"), F.lit(":"), half.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("bigint")


def _network(x: Column, n: int, key: str, inverse: bool) -> Column:
    a, b = grid(n)

    def step(s: Column, i: Column) -> Column:
        sign = -1 if inverse else 1
        left = F.pmod(s["l"] + sign * _round(key, i, s["r"]), F.lit(a).cast("bigint"))
        right = F.pmod(s["r"] + sign * _round(key, i, s["l"]), F.lit(b).cast("bigint"))
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    low = F.pmod(x, F.lit(b).cast("bigint"))
    start = F.struct(((x - low) / b).cast("bigint").alias("l"), low.alias("r"))
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    rounds = F.array(*[F.lit(i) for i in order])
    return F.aggregate(rounds, start, step, lambda s: s["l"] * b + s["r"])


def permuted(df: DataFrame, number: str, n: int, out: str, key: str = "0", inverse: bool = False) -> DataFrame:
    """Adds ``out``, the place of ``number`` (0..n-1) in the permutation chosen by ``key``; null stays null."""
    first = free_name(df, "_first")
    once = df.withColumn(first, _network(F.col(number), n, key, inverse))
    again = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALK)), F.col(first),
        lambda y, _: F.when(y < n, y).otherwise(_network(y, n, key, inverse)),
    )
    walked = once.withColumn(out, F.when(F.col(first) < n, F.col(first)).otherwise(again)).drop(first)
    unfinished = F.raise_error(F.lit("cycle walk did not end")).cast("bigint")
    return walked.withColumn(out, F.when(F.col(out) >= n, unfinished).otherwise(F.col(out)))


def place_of(df: DataFrame, number: str, n: int, shards: int, key: str = "0") -> DataFrame:
    """Adds ``shard`` and ``slot`` for each row number; needs no other row."""
    place = free_name(df, "_place_in_order")
    moved = permuted(df, number, n, place, key)
    shard = F.pmod(F.col(place), F.lit(shards).cast("bigint"))
    return (
        moved.withColumn("shard", shard.cast("int"))
        .withColumn("slot", ((F.col(place) - shard) / shards).cast("bigint"))
        .drop(place)
    )


def row_at(df: DataFrame, n: int, shards: int, out: str = "row_number", key: str = "0") -> DataFrame:
    """Adds the row number that lies in (``shard``, ``slot``)."""
    place = free_name(df, "_place_in_order")
    placed = df.withColumn(place, F.col("slot").cast("bigint") * shards + F.col("shard"))
    return permuted(placed, place, n, out, key, inverse=True).drop(place)


def sharded(df: DataFrame, order: Sequence[str], shards: int = 16, key: str = "0", number: str = "row_number") -> DataFrame:
    """All rows of ``df`` with ``row_number``, ``shard`` and ``slot``; an input column of those names is replaced.

    Row numbers follow ``order`` (null first), rows that tie in it are equal copies as far as the
    result is concerned. One range sort of the given columns, so pass no texts: join them by key, or
    give their hashes. Counts of shards differ by at most one; slots run from 0 without gaps. An
    empty table gives an empty result.
    """
    keep = [c for c in df.columns if c not in (number, "shard", "slot")]
    rows = spool(ranked(df.select(*keep), list(order), name=number).withColumn(number, F.col(number) - 1), "numbered").df
    return place_of(rows, number, rows.count(), shards, key)
