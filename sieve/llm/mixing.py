"""Mixing sources to target weights.

Token counts are added up per source, every source gets a target, and its repetition rate is target
over tokens. A document is taken floor(rate) times plus once more with the probability of the
fraction, drawn from a hash of seed, id and text, so that a rerun takes the same copies. Rows that are
equal share a draw, which then says where along them the extra copies fall, so that m equal rows get
m times the fraction, rounded up or down.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import free_name, text_or_empty, word_count
from sieve.operators.ranking import ranked
from sieve.operators.spool import lookup, spool

WEIGHTS = (5.0, 2.0, 1.0)
MAX_RATE = 3.0


def source_key(source: str) -> Column:
    """A key that is never null: "s" and the name, or "~", which sorts behind all of them."""
    return F.when(F.col(source).isNull(), F.lit("~")).otherwise(F.concat(F.lit("s"), F.col(source)))


def draw(seed: str, doc_id: str, text: str = "text") -> Column:
    """A number in [0, 1) from 52 bits of md5 over seed, id and text."""
    parts = F.concat(
        F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(text_or_empty(text))
    )
    return F.conv(F.substring(F.md5(parts), 1, 13), 16, 10).cast("double") / float(2**52)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """Per source of ``sizes`` (key, source_size, n_docs): also ``target`` and ``rate``.

    Weights repeat over the sources by key. A source whose share of what is left exceeds ``max_rate``
    times its size stops there, and the others share the rest by weight, until none is above: every
    round is one aggregate over the sources, and a round that caps nobody is the last.
    """
    ordered = ranked(sizes, ["key"], name="_rank", spread="key")
    which = F.array(*[F.lit(float(w)) for w in weights])
    weighted = spool(
        ordered.withColumn("weight", F.element_at(which, ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))).drop("_rank"),
        "weighted",
    ).df
    cap = F.col("source_size") * F.lit(max_rate)
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    level, capped = None, -1
    while True:
        is_capped = F.lit(False) if level is None else F.col("weight") * F.lit(level) >= cap
        row = weighted.agg(
            F.sum(F.when(is_capped, F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(is_capped, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count(F.when(is_capped, 1)).alias("n"),
        ).first()
        if row["n"] == capped or not row["free"]:
            break
        capped, level = row["n"], (total - max_rate * row["held"]) / row["free"]
    target = F.least(cap, F.col("weight") * F.lit(level if level is not None else 0.0))
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(max_rate))).otherwise(0.0)
    return weighted.withColumn("target", target).withColumn("rate", rate)


def _numbered(df: DataFrame, place: str) -> DataFrame:
    """Adds ``place``: 1, 2, .. among equal rows. Equal rows are counted before they are shuffled, and other rows are not moved."""
    columns = df.columns
    row, times = free_name(df, "_all"), free_name(df, "_times")
    keyed = df.withColumn(row, F.xxhash64(*columns))
    repeated = spool(keyed.groupBy(row).agg(F.count("*").alias(times)).filter(F.col(times) > 1), "repeated")
    if repeated.df.isEmpty():
        return df.withColumn(place, F.lit(1).cast("bigint"))
    marked = lookup(keyed.withColumn(place, F.spark_partition_id()), repeated, [row], "left", spread=place, weight=times)
    marked = marked.drop(place)
    # The hash only brings rows together; a group holds rows that are equal in every column.
    one = marked.filter(F.col(times).isNotNull()).groupBy(*columns).agg(F.count("*").alias(times))
    again = one.withColumn(place, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(times))))
    return marked.filter(F.col(times).isNull()).select(*columns, F.lit(1).cast("bigint").alias(place)).unionByName(again.select(*columns, place))


def planned(
    df: DataFrame,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    seed: str = "mix",
    weights: Sequence[float] = WEIGHTS,
    max_rate: float = MAX_RATE,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Every row of ``df`` (or its columns ``keep``) with size, source_size, target, rate and copies.

    Input columns of these names are replaced. Texts are not shuffled while the sources' table may
    be broadcast; beyond that hot sources are salted. A null text has size 0, a null source is a
    source of its own, a source without words gets target 0 and no copies. Rows that are equal in all
    columns are dealt the extra copies one by one (``_numbered``). An empty table gives an empty result;
    long texts are counted whole.
    """
    added = ("size", "source_size", "target", "rate", "copies")
    place = free_name(df, "_place")
    sized = _numbered(df, place).withColumn("size", word_count(text_or_empty(text)))
    key, u, weight = (free_name(sized, x) for x in ("_key", "_draw", "_n_docs"))
    sized = sized.withColumn(key, source_key(source)).withColumn(u, draw(seed, doc_id, text))
    per_source = sized.groupBy(F.col(key).alias("key")).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    dim = spool(
        targets(spool(per_source, "sources").df, weights, max_rate).select(
            F.col("key").alias(key), "source_size", "target", "rate", F.col("n_docs").alias(weight)
        ),
        "targets",
    )
    columns = [c for c in (keep or df.columns) if c not in added]
    rows = lookup(sized.select(*columns, "size", key, u, place), dim, [key], "left", spread=u, weight=weight)
    whole = F.floor("rate")
    upto = lambda j: F.ceil(j * (F.col("rate") - whole) - F.col(u))
    extra = (upto(F.col(place)) - upto(F.col(place) - 1)).cast("bigint")  # for a row without equals: draw < fraction
    return rows.withColumn("copies", (whole + extra).cast("bigint")).select(*columns, *added)


def emitted(plan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row of ``plan`` as often as its ``copies`` say; a row with 0 copies goes."""
    copy = free_name(plan, "_copy")
    times = F.sequence(F.lit(1).cast("bigint"), F.col("copies"))
    return plan.filter(F.col("copies") > 0).withColumn(copy, F.explode(times)).select(*columns)
