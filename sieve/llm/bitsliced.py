"""Exact top-k inner products over a bit-sliced index.

The index keeps, for a block of rows, one bitmap per attribute and bit. A query's score is a weighted
sum of attributes, and the sum is made for all rows of the block at once by adding bitmaps: the bits
of a weight say at which places the attribute's slices enter, three bitmaps of one place become a sum
bitmap there and a carry bitmap one place up, until one bitmap is left per place. The best rows are
selected from the most significant slice downward; rows that tie at the boundary are settled by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.operators.spool import spool

SCALE = 256
BLOCK = 16384  # rows per block of the index
PACK = 128  # queries that meet a block in one record
TOGETHER = 4  # queries whose bitmaps are added side by side


def usable(vector: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: F.coalesce(fine(x), F.lit(False))), F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


class Block:
    """Bitmaps of one block: row 0 is empty, then all slices, then their complements."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, slices: np.ndarray, dims: int, bits: int):
        self.ids, self.known, self.dims, self.bits = ids, known, dims, bits
        words = -(-len(ids) // 64)
        flat = slices.reshape(dims * bits, words)
        self.maps = np.concatenate([np.zeros((1, words), np.uint64), flat, ~flat])
        self.all = pack_bits(np.ones((1, len(ids)), bool))[0]

    def totals(self, weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Slices of sum(weight * value) + shift for each query (row of ``weights``), lowest first, and the shifts.

        Values are stored as u = value + 2**(bits-1). A weight is written with digits 1, 0 and -1 of
        which no two neighbours differ from 0, so few slices enter; a digit -1 adds the complement of u.
        """
        half, rest = 1 << (self.bits - 1), weights.copy()
        shift = half * weights.sum(axis=1)
        first = 1 + np.arange(self.dims) * self.bits
        columns: dict[int, list[list[int]]] = {}
        j = 0
        while rest.any():
            digit = np.where(rest % 2 == 1, 2 - rest % 4, 0)
            rest = (rest - digit) // 2
            shift = shift + ((2 * half - 1) << j) * (digit < 0).sum(axis=1)
            for q in range(len(weights)):
                begins = (first + self.dims * self.bits * (digit[q] < 0))[digit[q] != 0].tolist()
                for b in range(self.bits if begins else 0):
                    columns.setdefault(j + b, [[] for _ in weights])[q].extend([x + b for x in begins])
            j += 1
        out, carried, place = [], None, 0
        empty = np.zeros((len(weights), 0, self.maps.shape[1]), np.uint64)
        while place in columns or any(p > place for p in columns) or carried is not None:
            lists = columns.get(place, [[] for _ in weights])
            wide = max(map(len, lists))
            index = np.array([x + [0] * (wide - len(x)) for x in lists], np.int64).reshape(len(lists), wide)
            here = self.maps[index] if wide else empty
            if carried is not None:
                here = np.concatenate([here, carried], axis=1)
            carries = []
            while here.shape[1] > 2:
                n = here.shape[1] // 3
                a, b, c, rest = here[:, :n], here[:, n : 2 * n], here[:, 2 * n : 3 * n], here[:, 3 * n :]
                x = a ^ b
                carries.append((a & b) | (x & c))
                here = np.concatenate([x ^ c, rest], axis=1)
            if here.shape[1] == 2:
                carries.append(here[:, :1] & here[:, 1:])
                here = here[:, :1] ^ here[:, 1:]
            out.append(here[:, 0] if here.shape[1] else np.zeros((len(weights), self.maps.shape[1]), np.uint64))
            carried = np.concatenate(carries, axis=1) if carries else None
            place += 1
        return out, shift

    def top(self, names: np.ndarray, weights: np.ndarray, k: int) -> Iterator[tuple[int, int | None, int]]:
        """(query id, row id, score) of the k best rows for each query, the query's own rows left out."""
        slices, shift = self.totals(weights)
        open_rows = np.repeat(self.all[None], len(names), axis=0)
        for q, name in enumerate(names):
            open_rows[q] &= ~pack_bits(((self.ids == name) & self.known)[None])[0]
        taken = np.zeros_like(open_rows)
        for s in reversed(slices):
            more = taken | (open_rows & s)
            count = np.bitwise_count(more).sum(axis=1)[:, None]
            open_rows = np.where(count > k, open_rows & s, np.where(count < k, open_rows & ~s, np.uint64(0)))
            taken = np.where(count > k, taken, more)
        for q, name in enumerate(names):
            rows = unpack_bits(taken[q], len(self.ids))
            if len(rows) < k:  # rows still open have equal scores: the smallest ids enter, null ids last
                ties = unpack_bits(open_rows[q], len(self.ids))
                order = np.lexsort((self.ids[ties], ~self.known[ties]))[: k - len(rows)]
                rows = np.concatenate([rows, ties[order]])
            for r in rows:
                bits = [int(s[q, r >> 6] >> np.uint64(r & 63)) & 1 for s in slices]
                score = sum(bit << p for p, bit in enumerate(bits)) - int(shift[q])
                yield int(name), int(self.ids[r]) if self.known[r] else None, score


def pack_bits(rows: np.ndarray) -> np.ndarray:
    """Booleans (n, rows) to words of 64 rows."""
    padded = np.zeros((rows.shape[0], -(-rows.shape[1] // 64) * 64), bool)
    padded[:, : rows.shape[1]] = rows
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def unpack_bits(words: np.ndarray, n: int) -> np.ndarray:
    """Places of the rows whose bit is set."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    """Vectors as a matrix; what a short one lacks is 0."""
    out = np.zeros((len(column), dims), np.int64)
    for i, v in enumerate(column.to_pylist()):
        out[i, : len(v)] = v
    return out


def index(rows: DataFrame, dims: int, bits: int, blocks: int) -> DataFrame:
    """(block, ids, known, slices): one row per block of ``rows`` (id, v)."""

    def build(table: pa.Table) -> pa.Table:
        ids = table.column("id")
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        numbers = ids.fill_null(0).to_numpy().astype(np.int64)
        shifted = _matrix(table.column("v"), dims) + (1 << (bits - 1))
        maps = [pack_bits(((shifted >> b) & 1).T.astype(bool)) for b in range(bits)]  # each (dims, words)
        slices = np.stack(maps, axis=1)
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": [numbers.tobytes()],
            "known": [known.tobytes()], "slices": [np.ascontiguousarray(slices).tobytes()],
        })

    placed = rows.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    return placed.groupBy("block").applyInArrow(build, "block int, ids binary, known binary, slices binary")


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, row_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates for each query by integer inner product.

    Components are floor(scale * x). Rows whose vector is null or holds a null or non-finite component
    take no part; a short vector counts as 0 where it ends. A candidate with the query's id is the
    query itself and left out. Ties go to the smaller id, a null id comes last. Of several queries with
    one id, the one with the smallest vector is asked; a query without an id is none. Empty tables give
    an empty result. Queries meet the index block by block; per block and query at most k rows leave.
    """
    def numbers(df: DataFrame) -> DataFrame:
        return df.filter(usable(F.col(vector))).select(
            F.col(row_id).cast("bigint").alias("id"), quantised(F.col(vector), scale).alias("v")
        )

    rows = spool(numbers(candidates), "vectors").df
    asked = spool(numbers(queries).filter("id is not null").groupBy("id").agg(F.min("v").alias("v")), "queries").df
    size = lambda df: df.agg(
        F.count("*"), F.max(F.size("v")), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))
    ).first()
    (n, wide, high), (n_asked, wide_asked, _) = size(rows), size(asked)
    dims, bits = max(wide or 0, wide_asked or 0, 1), int(high or 0).bit_length() + 1
    blocks, packs = max(1, -(-n // BLOCK)), max(1, -(-n_asked // PACK))
    built = spool(index(rows, dims, bits, blocks), "index").df

    packed = asked.withColumn("pack", F.pmod(F.xxhash64("id"), F.lit(packs)).cast("int"))
    packed = packed.groupBy("pack").agg(F.collect_list(F.struct("id", "v")).alias("asked"))  # about PACK queries
    meetings = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(built, "block")

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name: batch.column(name)[r].as_py()
                ids = np.frombuffer(get("ids"), np.int64)
                block = Block(ids, np.frombuffer(get("known"), bool), np.frombuffer(get("slices"), np.uint64), dims, bits)
                asked_here = get("asked")
                names = np.array([a["id"] for a in asked_here], np.int64)
                weights = _matrix(pa.array([a["v"] for a in asked_here], pa.list_(pa.int64())), dims)
                found = [
                    x for i in range(0, len(names), TOGETHER)
                    for x in block.top(names[i : i + TOGETHER], weights[i : i + TOGETHER], k)
                ]
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"]
                    )

    spread = meetings.repartition("block", "pack").select("asked", "ids", "known", "slices")
    found = spread.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
