"""Whitening of embeddings with exact second moments.

Vectors become whole numbers. Every dimension is shifted by its least value, so a few bit planes hold
it, and the planes of many rows are packed into words of 64 rows. The product sum of two dimensions is
the sum over pairs of their planes of the popcount of the AND, weighted by the planes' places. These
counts are exact, they add up over tasks, and they are centred as whole numbers before anything is
divided or decomposed.

Rows whose vector is null or empty, or holds null, NaN, infinite or beyond 2**56, take no part, and
neither do vectors of another length than most (of equally frequent lengths, the longest). Ids are not
looked at: rows that repeat and rows without id are whitened like others, and equal vectors count once
in the fit. An empty table gives no rows. Other columns pass through, and names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType

from sieve.llm.common import free_name
from sieve.operators.spool import spool

SCALE = 64
OFFSET = 1_000_000
LARGEST = 2.0**56  # a component beyond it has no exact whole number
ROWS = 8192  # rows whose planes are packed together
LIMB = 16  # places of the product sum that are added up in one column
COMPONENTS = 16


def whole_numbers(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """floor(scale * c) + offset for each component; null where the row takes no part."""
    fine = lambda c: F.coalesce(F.abs(c.cast("double")) <= LARGEST, F.lit(False))
    usable = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, fine)  # NaN is above every number
    return F.when(usable, F.transform(vector, lambda c: (F.floor(c.cast("double") * scale) + offset).cast("bigint")))


@dataclass(frozen=True)
class Whitening:
    """``n`` distinct vectors with sums ``sums``; ``components`` has one unit eigenvector per row, and
    ``variances`` their eigenvalues, falling. ``trace`` is that of the covariance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float | None = None

    @property
    def dims(self) -> int:
        return len(self.sums)

    def deviations(self, x: np.ndarray) -> list[int]:
        """sum((n * x - S)**2) of each row of whole numbers, exact."""
        base = [s // self.n for s in self.sums]
        rest = np.array([s - self.n * b for s, b in zip(self.sums, base)], np.int64)  # 0 <= rest < n
        step = x - np.array(base, np.int64)
        largest = int(np.abs(step).max(initial=0)) + 1
        if largest * self.n < 2**55 and self.dims <= 64:
            # Halves of 28 bits, whose squares and products add up in 64 bits.
            a = step * self.n - rest
            high, low = a >> 28, a & (2**28 - 1)
            sums = [np.einsum("ij,ij->i", p, q).tolist() for p, q in ((high, high), (high, low), (low, low))]
            return [(hh << 56) + (hl << 29) + ll for hh, hl, ll in zip(*sums)]
        return [sum((self.n * int(v) - s) ** 2 for v, s in zip(row, self.sums)) for row in x]

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened components of each row; NaN where the component has no variance."""
        base = [s // self.n for s in self.sums]
        part = np.array([(s - self.n * b) / self.n for s, b in zip(self.sums, base)])
        centred = (x - np.array(base, np.int64)).astype(np.float64) - part
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(self.variances > 0, centred @ self.components.T / np.sqrt(self.variances), np.nan)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def packed_planes(x: np.ndarray, width: int) -> np.ndarray:
    """Bit planes of whole numbers (rows, dims), none negative, as words: plane p of dimension d in row d * width + p."""
    n, dims = x.shape
    words = -(-n // 64)
    planes = np.zeros((dims * width, words * 64), bool)
    for p in range(width):
        planes[p::width, :n] = ((x >> p) & 1).T
    return np.packbits(planes, axis=1, bitorder="little").view(np.uint64)


def plane_counts(planes: np.ndarray) -> np.ndarray:
    """Popcount of the AND of every plane with every plane (upper half)."""
    out = np.zeros((len(planes), len(planes)), np.int64)
    for a in range(len(planes)):
        out[a, a:] = np.bitwise_count(planes[a] & planes[a:]).sum(axis=1, dtype=np.int64)
    return out


def _moments(dims: int, low: list[int], width: int):
    """Per task: for each pair i <= j the sum of shifted products in limbs of 16 places, and for j = -1 the sums."""
    limbs = (2 * width - 2) // LIMB + 1
    shift = np.array(low, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((dims * width, dims * width), np.int64)
        sums, seen, held = [0] * dims, 0, []

        def take(x: np.ndarray) -> None:
            nonlocal seen
            planes = packed_planes(x, width)
            counts[:] += plane_counts(planes)
            ones = np.bitwise_count(planes).sum(axis=1, dtype=np.int64)
            for d in range(dims):
                sums[d] += sum(int(ones[d * width + p]) << p for p in range(width))
            seen += len(x)

        waiting = 0
        for batch in batches:
            held.append(matrix(batch.column(0), dims) - shift)
            waiting += len(held[-1])
            if waiting >= ROWS:
                take(np.concatenate(held))
                held, waiting = [], 0
        if waiting:
            take(np.concatenate(held))
        if not seen:
            return
        full = counts + np.triu(counts, 1).T
        full = full.reshape(dims, width, dims, width)
        left, right = np.triu_indices(dims)
        out = np.zeros((limbs, len(left)), np.int64)
        for p in range(width):
            for q in range(width):
                out[(p + q) // LIMB] += full[left, p, right, q] << ((p + q) % LIMB)
        rows = {"i": left, "j": right, "n": np.zeros(len(left), np.int64)}
        rows |= {f"limb{k}": out[k] for k in range(limbs)}
        yield pa.RecordBatch.from_pydict({k: np.asarray(v, np.int64) for k, v in rows.items()})
        # With two limbs or fewer values are below 2**16, and their sums fit in one column.
        cut = 2 * LIMB if limbs > 2 else 62
        once = {"i": np.arange(dims), "j": np.full(dims, -1), "n": np.full(dims, seen)}
        once |= {f"limb{k}": np.zeros(dims, np.int64) for k in range(limbs)}
        once["limb0"] = [s % (1 << cut) for s in sums]
        if limbs > 2:
            once["limb2"] = [s >> cut for s in sums]
        yield pa.RecordBatch.from_pydict({k: np.asarray(v, np.int64) for k, v in once.items()})

    schema = ", ".join(f"{c} bigint" for c in ["i", "j", "n", *[f"limb{k}" for k in range(limbs)]])
    return run, schema, limbs


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task and length of vectors: how many, and the least and largest value of each dimension."""
    found: dict[int, list] = {}
    for batch in batches:
        column = batch.column(0)
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        for dims in np.unique(lengths):
            x = matrix(column.filter(pa.array(lengths == dims)), int(dims))
            here = [len(x), x.min(axis=0), x.max(axis=0)]
            had = found.get(int(dims))
            found[int(dims)] = here if had is None else [
                had[0] + here[0], np.minimum(had[1], here[1]), np.maximum(had[2], here[2])
            ]
    for dims, (n, low, high) in found.items():
        yield pa.RecordBatch.from_pydict({
            "dims": np.full(dims, dims, np.int64), "i": np.arange(dims), "n": np.full(dims, n, np.int64), "low": low, "high": high,
        })


def _products(model: Whitening):
    """Per task: sums and product sums of whitened values, to measure their covariance."""
    k = len(model.variances)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products, seen = np.zeros(k), np.zeros((k, k)), False
        for batch in batches:
            y = model.apply(matrix(batch.column(0), model.dims))
            sums, products, seen = sums + y.sum(axis=0), products + y.T @ y, True
        if seen:
            i, j = np.triu_indices(k)
            yield pa.RecordBatch.from_pydict({"i": i, "j": j, "value": products[i, j]})
            yield pa.RecordBatch.from_pydict({"i": np.arange(k), "j": np.full(k, -1), "value": sums})

    return run


def fit(vectors: DataFrame, x: str, k: int = COMPONENTS) -> Whitening | None:
    """Fit on the distinct arrays of whole numbers in column ``x`` (null rows left out); None where there are none.

    The driver gets one row per pair of dimensions, whatever the number of vectors.
    """
    distinct = spool(vectors.filter(F.col(x).isNotNull()).select(F.col(x).alias("x")).distinct(), "whole-vectors").df
    ranges = distinct.mapInArrow(_ranges, "dims bigint, i bigint, n bigint, low bigint, high bigint")
    ranges = spool(ranges.groupBy("dims", "i").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "ranges")
    most = ranges.df.filter("i = 0").orderBy(F.desc("n"), F.desc("dims")).first()
    if most is None:
        return None
    dims = most["dims"]
    distinct = distinct.filter(F.size("x") == dims)
    span = {r["i"]: (r["low"], r["high"]) for r in ranges.df.filter(F.col("dims") == dims).collect()}
    low = [span[d][0] for d in range(dims)]
    width = max(1, max(high - least for least, high in span.values()).bit_length())

    run, schema, limbs = _moments(dims, low, width)
    found = distinct.mapInArrow(run, schema).groupBy("i", "j").agg(
        F.sum("n").alias("n"), *[F.sum(f"limb{k}").alias(f"limb{k}") for k in range(limbs)]
    ).collect()  # dims * (dims + 3) / 2 rows
    whole = {(r["i"], r["j"]): sum(r[f"limb{k}"] << (LIMB * k) for k in range(limbs)) for r in found}
    n = next(r["n"] for r in found if r["j"] == -1)
    shifted = [whole[d, -1] for d in range(dims)]
    cov = np.zeros((dims, dims))
    for i in range(dims):
        for j in range(i, dims):
            cov[i, j] = cov[j, i] = (n * whole[i, j] - shifted[i] * shifted[j]) / (n * n)  # exact until here
    trace = sum(n * whole[d, d] - shifted[d] ** 2 for d in range(dims)) / (n * n)
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:k]
    # What rounding alone can leave of an eigenvalue that is zero.
    noise = max(values.max(initial=0.0), 0.0) * dims * np.finfo(float).eps
    kept = np.where(values[order] > noise, values[order], 0.0)
    model = Whitening(n, [s + n * b for s, b in zip(shifted, low)], kept, directions[:, order].T.copy(), trace)
    return Whitening(model.n, model.sums, model.variances, model.components, model.trace, _identity_error(distinct, model))


def _identity_error(distinct: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the measured covariance of whitened values less the identity, over components that vary."""
    varies = model.variances > 0
    if not varies.any():
        return None
    cut = Whitening(model.n, model.sums, model.variances[varies], model.components[varies], model.trace)
    found = distinct.mapInArrow(_products(cut), "i bigint, j bigint, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))
    value = {(r["i"], r["j"]): r["value"] / model.n for r in found.collect()}  # one row per pair of components
    return max(abs(v - value[i, -1] * value[j, -1] - (i == j)) for (i, j), v in value.items() if j >= 0)


def transformed(rows: DataFrame, x: str, model: Whitening | None, whitened: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """Each row whose ``x`` is not null and of the fitted length, with its whitened components (array, null where a
    component does not vary) and its deviation (decimal, exact). Columns of these names are replaced."""
    rest = [c for c in rows.columns if c.lower() not in (whitened.lower(), deviation.lower())]
    out_schema = rows.select(*rest).schema.add(whitened, ArrayType(DoubleType())).add(deviation, DecimalType(38, 0))
    if model is None:
        return rows.sparkSession.createDataFrame([], out_schema)
    fitted = rows.filter(F.col(x).isNotNull() & (F.size(x) == model.dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = matrix(batch.column(batch.schema.get_field_index(x)), model.dims)
            y = model.apply(values)
            flat = pa.array(y.ravel(), mask=np.isnan(y.ravel()))
            offsets = pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32())
            sums = [Decimal(d) if d < 10**38 else None for d in model.deviations(values)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i, c in enumerate(batch.schema.names) if c in rest],
                 pa.ListArray.from_arrays(offsets, flat), pa.array(sums, pa.decimal128(38, 0))],
                names=[*rest, whitened, deviation],
            )

    return fitted.select(*rest).mapInArrow(run, out_schema)


def whiten(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS, keep: list[str] | None = None) -> tuple[DataFrame, Whitening | None]:
    """Rows that take part with ``whitened`` and ``deviation``, and the model; ``keep`` names the other columns returned."""
    x = free_name(rows, "_x")
    keep = rows.columns if keep is None else keep
    numbers = rows.withColumn(x, whole_numbers(F.col(vector)))
    model = fit(numbers, x, k)
    return transformed(numbers.select(*keep, x), x, model).drop(x), model


def components(rows: DataFrame, vector: str = "embedding", ident: str = "vec_id", k: int = COMPONENTS) -> DataFrame:
    """One row per vector that takes part and component, numbered from 1 by falling variance."""
    found, model = whiten(rows, vector, k, [ident])
    n, trace, error = (model.n, model.trace, model.identity_error) if model else (0, 0.0, None)
    shares = [float(v) / trace if trace > 0 else None for v in (model.variances if model else [])]
    explained = F.array(*[F.lit(s).cast("double") for s in shares]) if shares else F.array().cast("array<double>")
    one = found.select(ident, F.col("deviation").try_cast("bigint").alias("deviation"), F.posexplode("whitened").alias("_at", "whitened"))
    return one.select(
        ident,
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("_at")).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )

