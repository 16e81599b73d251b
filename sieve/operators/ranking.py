"""Positions and quotas without a window over a whole group.

A topic, class or source may hold a large share of all rows, so nothing here sorts a group in
one task. Random order is the md5 of seed and id: the same rows are drawn on any cluster and
under any partitioning, which ``rand(seed)`` does not give.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.operators.spool import Spooled, lookup, spool

SEED = 42
_BUCKET_DIGITS = 3  # leading hex digits: 4 096 buckets per group
NEAR = 10_000  # rows of a group that one task may sort
PLACE_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def seeded_order(seed: int | str = SEED, id_col: str = "pid") -> Column:
    """A sort key that shuffles: md5 first, the id to settle ties. A null id sorts like an empty one."""
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat(F.lit(f"{seed}:"), ident)), F.lit(":"), ident)


def quota_cut(
    ids: DataFrame,
    keys: Sequence[str],
    quotas: Callable[[DataFrame], DataFrame],
    names: Sequence[str],
    seed: int | str = SEED,
    id_col: str = "pid",
) -> Spooled:
    """Per group, the last order key that each quota lets in: keys and, per quota, that key, how many
    of the rows with it are let in (``<quota>_copies``) and how many there are (``<quota>_rows``), for
    ids may repeat. A null in a key is a group like others.

    A histogram over the leading digits of the order says in which bucket a quota ends, and only
    that bucket is sorted. ``quotas`` adds the columns ``names`` to the histogram (keys, bucket,
    n), which has at most 4 096 rows per group. ``ids`` is read twice, for its keys and id alone.
    """
    keys = list(keys)
    slim = ids.select(*keys, seeded_order(seed, id_col).alias("_order")).withColumn(
        "bucket", F.substring("_order", 1, _BUCKET_DIGITS)
    )
    histogram = spool(slim.groupBy(*keys, "bucket").agg(F.count("*").alias("n")), "histogram").df
    ends = [F.struct(F.lit(q).alias("_quota"), F.col(q).cast("bigint").alias("_want")) for q in names]
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bucket"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    edge = (
        quotas(histogram.repartition(keys[0]))  # one shuffle serves every window below
        .withColumn("_upto", upto)
        .withColumn("_total", total)
        .select(*keys, "bucket", "n", "_upto", "_total", F.inline(F.array(*ends)))
        .withColumn("_want", F.least("_want", "_total"))
        .filter((F.col("_want") > F.col("_upto") - F.col("n")) & (F.col("_want") <= F.col("_upto")))
        .select(*keys, "bucket", "_quota", (F.col("_want") - F.col("_upto") + F.col("n")).alias("_need"))
    )
    at_edge = lookup(slim, edge, [*keys, "bucket"], "inner", spread="_order", null_safe=True)
    # Copies of an id are counted before they are shuffled, so an id of many rows is one row here.
    ids_at_edge = at_edge.groupBy(*keys, "_quota", "_need", "_order").agg(F.count("*").alias("_n"))
    upto_id = F.sum("_n").over(Window.partitionBy(*keys, "_quota").orderBy("_order"))
    last = ids_at_edge.withColumn("_upto", upto_id).filter(F.col("_need").between(F.col("_upto") - F.col("_n") + 1, F.col("_upto")))
    copies = F.col("_need") - F.col("_upto") + F.col("_n")
    of = lambda q, c: F.max(F.when(F.col("_quota") == q, c))
    cuts = [
        c for q in names
        for c in (of(q, F.col("_order")).alias(q), of(q, copies).alias(f"{q}_copies"), of(q, F.col("_n")).alias(f"{q}_rows"))
    ]
    return spool(last.groupBy(*keys).agg(*cuts), "cut")


def flag_cuts(
    rows: DataFrame, cut: Spooled, keys: Sequence[str], flags: Mapping[str, str], seed: int | str = SEED,
    id_col: str = "pid",
) -> DataFrame:
    """Adds, for each quota of ``cut``, a flag that tells whether the row is within it.

    The rows are not sorted and, while the groups are not very many, not shuffled either. Only where a
    quota ends inside the copies of an id are these copies numbered, by a hash of their content.
    """
    columns = rows.columns
    renamed = cut.df.select(*keys, *[F.col(c).alias(f"_{c}") for q in flags for c in (q, f"{q}_copies")])
    marked = lookup(rows, Spooled(renamed, cut.path, cut.bytes), list(keys), "left", spread=id_col, null_safe=True)
    marked = marked.withColumn("_order", seeded_order(seed, id_col)).withColumn("_copy", F.lit(0).cast("bigint"))
    inside_copies = reduce(lambda a, b: a | b, [F.col(f"{q}_copies") < F.col(f"{q}_rows") for q in flags])
    if not cut.df.filter(inside_copies).isEmpty():
        at_end = reduce(lambda a, b: a | b, [F.col("_order") == F.col(f"_{q}") for q in flags])
        at_end = F.coalesce(at_end, F.lit(False))
        ends = ranked(marked.filter(at_end), [F.xxhash64(*columns)], [*keys, "_order"], "_copy", spread="_copy")
        marked = marked.filter(~at_end).unionByName(ends)
    for quota, flag in flags.items():
        order, end = F.col("_order"), F.col(f"_{quota}")
        inside = (order < end) | ((order == end) & (F.col("_copy") <= F.col(f"_{quota}_copies")))
        marked = marked.withColumn(flag, F.coalesce(inside, F.lit(False)))
    return marked.select(*columns, *flags.values())


def within_cut(
    rows: DataFrame, cut: Spooled, keys: Sequence[str], quota: str, seed: int | str = SEED, id_col: str = "pid"
) -> DataFrame:
    return flag_cuts(rows, cut, keys, {quota: "_in"}, seed, id_col).filter("_in").drop("_in")


def ranked(
    rows: DataFrame,
    order: Sequence[str | Column],
    keys: Sequence[str] = (),
    name: str = "rank",
    spread: str = "pid",
) -> DataFrame:
    """Number all rows from 1 in ``order``, over the table or within each group of ``keys``.

    One range sort; the place of a row in its sorted partition plus the sizes of the partitions
    before it is its rank. Rows that tie in ``order`` follow each other by a hash of their content, and
    equal rows by their place in the input, so the sort can cut ties: a key that holds most rows is
    dealt over many tasks like any other. A null key is a group like others.
    """
    keys = list(keys)
    kept = [c for c in rows.columns if c != name]
    hashed = [c for c, kind in rows.select(*kept).dtypes if "map<" not in kind]
    tied = {"_tie": F.xxhash64(*hashed) if hashed else F.lit(0), "_from": F.monotonically_increasing_id()}
    placed = spool(
        rows.select(*kept).withColumns(tied).orderBy(*keys, *order, "_tie", "_from").drop("_tie", "_from")
        .withColumn("_place", F.monotonically_increasing_id()), "sorted"
    ).df
    placed = placed.withColumn("_part", F.shiftright("_place", PLACE_BITS))
    before = F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = (  # one row per shuffle partition
        placed.groupBy("_part")
        .agg(F.count("*").alias("_size"))
        .select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    )
    row_in_part = F.col("_place").bitwiseAND(F.lit(2**PLACE_BITS - 1))
    out = (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_before") + row_in_part + 1)
        .drop("_part", "_place", "_before")
    )
    if not keys:
        return out
    first = out.groupBy(*keys).agg(F.min(name).alias("_first"))
    out = lookup(out, first, keys, "inner", spread=spread, null_safe=True)
    return out.withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")


def shuffled(
    rows: DataFrame, keys: Sequence[str] = (), seed: int | str = SEED, id_col: str = "pid", name: str = "rank"
) -> DataFrame:
    """Number all rows from 1 in seeded order, over the table or within each group of ``keys``.

    Rows that repeat an id take numbers one after the other, and may lie in several tasks; a null key is
    a group like others.
    """
    return ranked(rows, [seeded_order(seed, id_col)], keys, name, spread=id_col)


def top_per_group(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, name: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group; tasks drop the rest before the shuffle."""
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, position).filter(F.col(name) <= n)


def row_slice(
    rows: DataFrame, order: Sequence[Column | str], start: int, stop: int, keys: Sequence[str] = ()
) -> DataFrame:
    """Rows [start, stop) by position, of the table or of each group.

    A slice near the front of each group is cut out in every task before the shuffle. One that ends beyond
    ``NEAR`` rows is found by rank, so that no task gets a whole group.
    """
    if not keys and stop <= NEAR:
        return rows.orderBy(*order).offset(start).limit(stop - start)
    if stop <= NEAR:
        return top_per_group(rows, keys, order, stop, "_rank").filter(F.col("_rank") > start).drop("_rank")
    return ranked(rows, order, keys, "_rank", spread="_rank").filter(F.col("_rank").between(start + 1, stop)).drop("_rank")


def rank_range(small: DataFrame, order: Sequence[Column | str], start: int, stop: int) -> DataFrame:
    """Rows [start, stop) with their 1-based rank; never ranks more than ``stop`` rows."""
    head = small.orderBy(*order).limit(stop)
    head = head.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return head.filter(F.col("rank") > start)


def chunked(ids: DataFrame, size: int = 300, id_col: str = "pid", start: int = 0) -> DataFrame:
    """Give each id its chunk number; ``start`` ids at the front are left out."""
    number = F.when(F.col(id_col).rlike(r"^\d{1,18}$"), F.col(id_col).try_cast("bigint"))
    placed = ranked(ids.select(id_col).distinct(), [number, id_col], name="_rank", spread=id_col)
    return placed.filter(F.col("_rank") > start).select(
        id_col, F.floor((F.col("_rank") - 1 - start) / size).cast("bigint").alias("chunk_id")
    )


def batched(
    rows: DataFrame,
    size: int = 16,
    keys: Sequence[str] = ("topic_id",),
    shuffle: bool = True,
    seed: int | str = SEED,
    id_col: str = "pid",
) -> DataFrame:
    """Give each row a batch number within its group, in shuffled or in id order."""
    if shuffle:
        placed = shuffled(rows, keys, seed, id_col, "_rank")
    else:
        placed = ranked(rows, [id_col], keys, "_rank", spread=id_col)
    return placed.withColumn("batch_id", F.floor((F.col("_rank") - 1) / size).cast("bigint")).withColumn(
        "row_in_batch", ((F.col("_rank") - 1) % size).cast("bigint")
    ).drop("_rank")


def draw_shards(shards: DataFrame, n: int = 20, seed: int | str = SEED, id_col: str = "shard") -> DataFrame:
    """``n`` shards without replacement."""
    return shards.orderBy(seeded_order(seed, id_col)).limit(n)
