"""Language identification by fusing evidence.

Per document, four pieces of evidence are added up as log probabilities: the text under character
n-gram models, the language declared by markup or catalogue, the suffix of the address, and a prior
of the host. The prior is smoothed hierarchically (host, then its domain, then the whole corpus) and
comes from one grouped aggregation of what the texts alone say. Declarations and suffixes count as
much as they agreed with the texts of the corpus, so wrong labels lose weight by themselves.

A document is rejected if its text gives no evidence (no letters), or if no language reaches the
wanted posterior probability.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import text_or_empty
from sieve.operators.spool import lookup, spool

SLOTS = 2**15  # hashed trigrams of bytes
SAMPLE = 5_000  # texts of each label that its model is fitted on, in expectation; whole texts, chosen by hash
HELD = 64  # labels whose counts a task holds at a time
SMOOTHING = 0.1
TEMPER = 0.2  # trigrams overlap and follow each other: each counts for a fifth
HOST_WEIGHT = 20.0  # rows of its domain that count as much as a host's own
MIN_POSTERIOR = 0.8


def _grams(text: str) -> np.ndarray:
    """Slots of the byte trigrams of letters and blanks of a lower-cased text."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    letter = (raw >= 97) & (raw <= 122) | (raw >= 128)
    raw = np.where(letter, raw, 32).astype(np.uint32)
    raw = raw[(raw != 32) | np.r_[True, raw[:-1] != 32]]  # one blank for any run without letters
    h = (raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA6B) + raw[2:] * np.uint32(0xC2B2AE35)) if len(raw) > 2 else raw[:0]
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(17)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    weights: Broadcast  # float32 array (SLOTS, languages): log probabilities

    def log_likelihoods(self, text: Column) -> Column:
        """array<float>: tempered log likelihood per language; an empty array without letters."""
        weights = self.weights

        @F.arrow_udf("array<float>")
        def score(texts: pa.Array) -> pa.Array:
            table, out = weights.value, []
            for t in texts.to_pylist():
                grams = _grams(t)
                out.append(np.float32(TEMPER) * table[grams].sum(axis=0, dtype=np.float64) if len(grams) else ())
            return pa.array([[float(v) for v in x] for x in out], pa.list_(pa.float32()))

        return score(text)


def fit_texts(docs: DataFrame, label: str, text: str = "text", sample: int = SAMPLE) -> TextModel:
    """Trigram models from about ``sample`` different texts of each label, chosen by the hash of the text.

    A label with fewer is fitted on all its texts, so no label is lost however rare it is. Copies of a text count
    once and are brought together before they are shuffled. A null label is none, a null text is empty; without
    labels there are no languages. The model takes 128 KB per label in every worker.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col(label).cast("string").alias("label"), text_or_empty(text).alias("text")).filter(F.col("label").isNotNull())
    labelled = labelled.withColumn("hash", F.xxhash64("text", F.lit("fit")))
    sizes = labelled.select("label", "hash").distinct().groupBy("label").agg(F.count("*").alias("n"))
    share = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n"))
    marked = lookup(labelled, sizes.select("label", share.alias("share")), ["label"], "inner", spread="hash")
    chosen = marked.filter(F.pmod(F.col("hash"), F.lit(10**6)) < F.col("share") * 10**6)
    chosen = chosen.groupBy("label", "hash").agg(F.first("text").alias("text")).select("label", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            return pa.RecordBatch.from_pydict({"label": list(sums), "counts": [v.tobytes() for v in sums.values()]})

        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name not in sums:
                    if len(sums) == HELD:
                        yield out()
                        sums.clear()
                    sums[name] = np.zeros(SLOTS, np.int64)
                sums[name] += np.bincount(_grams(t), minlength=SLOTS)
        if sums:
            yield out()

    @F.pandas_udf("binary")
    def added(counts: pd.Series) -> bytes:
        return sum(np.frombuffer(c, np.int64) for c in counts).tobytes()

    partial = chosen.mapInArrow(count, "label string, counts binary")
    found = {r["label"]: np.frombuffer(r["counts"], np.int64) for r in partial.groupBy("label").agg(added("counts").alias("counts")).collect()}
    names = tuple(sorted(found))
    table = np.stack([found[n] for n in names]).astype(np.float64) if names else np.zeros((0, SLOTS))
    table = np.log((table + SMOOTHING) / (table.sum(axis=1, keepdims=True) + SMOOTHING * SLOTS))
    return TextModel(names, spark.sparkContext.broadcast(np.ascontiguousarray(table.T.astype(np.float32))))


def parent_host(host: Column) -> Column:
    """The registered domain (last two labels) of a host name; a name without dots has none."""
    return F.when(host.contains("."), F.substring_index(host, ".", -2))


def identified(
    docs: DataFrame,
    model: TextModel,
    text: str | Column = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    min_posterior: float = MIN_POSTERIOR,
    keep: list[str] | None = None,
) -> DataFrame:
    """``docs`` (or its columns ``keep``) with ``language``, ``posterior`` and ``kept``.

    Added columns replace input columns of the same names. ``declared``, ``suffix`` and ``host`` are
    expressions over ``docs``; null means no such evidence. A null text counts as empty and is
    rejected with a null language and posterior 0. Rows are judged one by one: repeated rows give
    repeated results, an empty table an empty one. Ties go to the first language by name. The host
    table is broadcast if it is small enough, otherwise hot hosts are salted.
    """
    names = list(model.languages)
    k = len(names)
    if not k:  # nothing to choose from
        columns = [c for c in (keep or docs.columns) if c not in ("language", "posterior", "kept")]
        return docs.select(*columns, F.lit(None).cast("string").alias("language"), F.lit(0.0).alias("posterior"), F.lit(False).alias("kept"))
    u = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns))  # no input column begins like this
    ll, d_, s_, h_, p_ = (f"{u}{x}" for x in ("logs", "declared", "suffix", "host", "domain"))
    none = F.lit(None).cast("string")
    body = text_or_empty(text) if isinstance(text, str) else F.coalesce(text, F.lit(""))
    evidence = {d_: declared, s_: suffix, h_: host}
    scored = docs.withColumns({
        ll: model.log_likelihoods(body), **{c: none if e is None else e.cast("string") for c, e in evidence.items()}
    })
    scored = scored.withColumn(p_, parent_host(F.col(h_)))
    top = F.array_max(ll)
    said = F.when(F.size(ll) > 0, F.array_position(ll, top) - 1).cast("int")  # by the text alone

    # What the texts say, counted per host, domain, declaration and suffix: sums of one pass.
    counted = scored.select(d_, s_, h_, p_, said.alias("said")).filter("said is not null")
    levels = F.array(
        F.struct(F.lit("all").alias("kind"), F.lit("").alias("value")),
        F.struct(F.lit("host").alias("kind"), F.col(h_).alias("value")),
        F.struct(F.lit("domain").alias("kind"), F.col(p_).alias("value")),
        F.struct(F.lit("declared").alias("kind"), F.col(d_).alias("value")),
        F.struct(F.lit("suffix").alias("kind"), F.col(s_).alias("value")),
    )
    # Count equal combinations first, so what is exploded and shuffled does not grow with the rows of a host.
    combined = counted.groupBy(d_, s_, h_, p_, "said").agg(F.count("*").alias("n"))
    tally = spool(
        combined.select(F.inline(levels), "said", "n").filter("value is not null")
        .groupBy("kind", "value").agg(*[F.sum(F.when(F.col("said") == i, F.col("n")).otherwise(0)).alias(f"c{i}") for i in range(k)]),
        "evidence",
    ).df
    counts = [f"c{i}" for i in range(k)]
    row = tally.filter("kind = 'all'").select(*counts).first()
    overall = [((row[i] if row else 0) + 1.0) / (sum(row or [0]) + k) for i in range(k)]

    def prior(kind: str, column: str) -> DataFrame:
        return tally.filter(F.col("kind") == kind).select(F.col("value").alias(column), F.array(*counts).alias(f"{column}_n"))

    def agreement(kind: str, column: str) -> DataFrame:
        """log P(value | language) up to a constant: counts over what the languages have in all."""
        parts = [F.log((F.col(c) + 0.5) / F.lit(o)) for c, o in zip(counts, overall)]
        return tally.filter(F.col("kind") == kind).select(F.col("value").alias(column), F.array(*parts).alias(f"{column}_n"))

    rows = scored
    for table, column, given in (
        (prior("host", h_), h_, host), (prior("domain", p_), p_, host),
        (agreement("declared", d_), d_, declared), (agreement("suffix", s_), s_, suffix),
    ):
        if given is None:
            rows = rows.withColumn(f"{column}_n", F.lit(None).cast("array<double>"))
        else:
            size = F.aggregate(f"{column}_n", F.lit(0.0), lambda s, x: s + F.abs(x))
            dim = spool(table.withColumn(f"{u}n", size), "dim")
            rows = lookup(rows, dim, [column], "left", spread=ll, weight=f"{u}n").drop(f"{u}n")

    def smoothed(own: str, i: int, above: Column) -> Column:
        """The share of language i in a group, the text in question left out, drawn to the group above."""
        mine = F.when(said == i, 1.0).otherwise(0.0)
        total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x) - 1
        share = (F.get(own, F.lit(i)) - mine + HOST_WEIGHT * above) / (total + HOST_WEIGHT)
        return F.when(F.col(own).isNull(), above).otherwise(share)

    logs = []
    for i in range(k):
        p = smoothed(f"{h_}_n", i, smoothed(f"{p_}_n", i, F.lit(overall[i])))
        given = [F.coalesce(F.get(c, F.lit(i)), F.lit(0.0)) for c in (f"{d_}_n", f"{s_}_n")]
        logs.append(F.get(ll, F.lit(i)) + F.log(p) + given[0] + given[1])
    rows = rows.withColumn(post := f"{u}post", F.when(F.size(ll) > 0, F.array(*logs)))
    best = F.array_max(post)
    mass = F.aggregate(post, F.lit(0.0), lambda s, x: s + F.exp(x - best))
    names_column = F.array(*[F.lit(x) for x in names])
    language = F.get(names_column, (F.array_position(post, best) - 1).cast("int"))
    columns = [c for c in (keep or docs.columns) if c not in ("language", "posterior", "kept")]
    return rows.select(
        *columns,
        language.alias("language"),
        F.coalesce(1.0 / mass, F.lit(0.0)).alias("posterior"),
        F.coalesce(1.0 / mass >= min_posterior, F.lit(False)).alias("kept"),
    )
