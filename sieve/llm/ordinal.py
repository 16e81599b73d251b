"""Quality grades by ordinal regression with cumulative links.

A document has one score, a weighted sum of hashed features of its text. Ordered thresholds cut the
score into grades: P(grade >= k) = sigmoid(score - threshold_k), with the same weights for all k.
That gives an expected grade and the tail probabilities by which documents are selected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import text_or_empty
from sieve.operators.spool import lookup, spool

SLOTS = 2**18  # hashed features; the space does not depend on the vocabulary
SAMPLE = 10_000  # rated rows the model is fitted on, in expectation, chosen by hash; whole texts
EPOCHS = 30
RATE = 0.005
DECAY = 1e-4
STRENGTH = 10.0  # average rows that a feature's own are added to before its odds are judged
TOGETHER = 32  # rows per step of the fit
HELD_OUT = 5  # one rated row in five never enters the fit, so that accuracy can be measured

_LETTERS = re.compile(r"[\W_]+")
_LEXICAL = 3  # features of a word's letters: the word and two of its beginnings; a fourth is its shape


class Features:
    """Hashed features of texts; those of a word are remembered, up to a limit."""

    def __init__(self, limit: int = 400_000):
        self.known, self.limit = {}, limit

    def _word(self, word: str) -> bytes:
        """Slots of the word, of its first five and seven letters, and of its case and trailing marks."""
        import xxhash

        core = _LETTERS.sub("", word.lower())
        shape = f"{word.isupper()}{_LETTERS.findall(word)[-1:]}"[:24]
        names = (f"w{core}", f"5{core[:5]}", f"7{core[:7]}", f"s{shape}")
        slots = np.array([xxhash.xxh3_64_intdigest(name.encode("utf-8", "replace")) % SLOTS for name in names], np.int32)
        if len(self.known) >= self.limit:
            self.known.clear()
        found = self.known[word] = slots.tobytes()
        return found

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(slots, values): 1 for what occurs in the letters of words; for shapes of words, words per
        line and variety, logarithms of their shares."""
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        get, new = self.known.get, self._word
        codes = np.frombuffer(b"".join([get(w) or new(w) for w in words]), np.int32).reshape(-1, _LEXICAL + 1)
        letters = np.unique(codes[:, :_LEXICAL])
        shapes, times = np.unique(codes[:, _LEXICAL], return_counts=True)
        lines, per_line = np.unique([min(8, line.count(" ")) for line in text.split("\n")], return_counts=True)
        variety = [SLOTS + 16 + int(10 * len(set(words)) / len(words))]
        slots = np.concatenate([letters, shapes, SLOTS + lines, variety]).astype(np.int64)
        share = np.concatenate([times / len(words), per_line / per_line.sum()])
        return slots, np.concatenate([np.ones(len(letters)), np.log1p(20.0 * share), [1.0]])


WIDTH = 2**18 + 32  # hashed slots, then those of lines and variety


def contrast(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int) -> np.ndarray:
    """How far a feature's odds differ from the average at any cut between grades, squared; 0 if never seen."""
    out = np.zeros(WIDTH)
    for k in range(1, levels):
        low, high = np.zeros(WIDTH), np.zeros(WIDTH)
        for (slots, _), g in zip(rows, grades):
            (low if g < k else high)[slots] += 1
        share = min(0.999, max(0.001, float((grades < k).mean())))
        odds = np.log((low + STRENGTH * share) / (high + STRENGTH * (1 - share))) - np.log(share / (1 - share))
        out = np.maximum(out, np.abs(odds))
    return out**2


@dataclass(frozen=True)
class OrdinalModel:
    weights: Broadcast  # float64 array of SLOTS
    thresholds: tuple[float, ...]  # one fewer than grades, ascending
    grades: tuple[int, ...]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the likelihood of grades 0..levels-1; rows are taken in the given order.

    Thresholds are kept in order by learning the first one and the logarithms of the gaps.
    """
    weights = np.zeros(WIDTH)
    share = np.array([(grades < k).mean() for k in range(1, levels)]).clip(0.01, 0.99)
    first = np.log(share / (1 - share))
    free = np.concatenate([first[:1], np.log(np.diff(first).clip(0.1))])
    free_squares = np.full(levels - 1, 1e-8)
    for _ in range(EPOCHS):
        for at in range(0, len(rows), TOGETHER):
            part, y = rows[at : at + TOGETHER], grades[at : at + TOGETHER]
            sizes = np.array([len(s) for s, _ in part])
            slots, values = np.concatenate([s for s, _ in part]), np.concatenate([v for _, v in part])
            who = np.repeat(np.arange(len(part)), sizes)
            score = np.bincount(who, weights=weights[slots] * values, minlength=len(part))
            cuts = np.concatenate([[-np.inf], np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])), [np.inf]])
            upper, lower = _sigmoid(cuts[y + 1] - score), _sigmoid(cuts[y] - score)  # P(grade <= y), P(grade < y)
            p = np.maximum(upper - lower, 1e-9)
            up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
            touched, place = np.unique(slots, return_inverse=True)
            slope = np.bincount(place, weights=(up - low)[who] * values) / len(part) + DECAY * weights[touched]
            weights[touched] -= RATE * slope
            by_cut = np.zeros(levels + 1)
            np.add.at(by_cut, y + 1, -up)
            np.add.at(by_cut, y, low)
            tail = by_cut[1:-1][::-1].cumsum()[::-1] / len(part)  # a gap moves all cuts above it
            slope = tail * np.concatenate([[1.0], np.exp(free[1:])])
            free_squares += slope**2
            free -= 0.1 * slope / np.sqrt(free_squares)
    return weights, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def never_fitted(row_id: str = "doc_id") -> Column:
    """Rated rows kept apart for measuring accuracy."""
    return F.pmod(F.xxhash64(row_id, F.lit("apart")), F.lit(HELD_OUT)) == 0


def fit_ratings(
    docs: DataFrame, ratings: DataFrame, row_id: str = "doc_id", text: str = "text", grade: str = "grade", sample: int = SAMPLE
) -> OrdinalModel:
    """A model from about ``sample`` rows of ``ratings`` (row_id, grade), chosen by the hash of the id.

    Features are made where the texts lie; the bounded sample of them is fitted in one task. Ratings
    that are null or without a document do not count; two ratings of a document count as two rows.
    With fewer than two grades every document gets the one there is (0 if none).
    """
    spark = docs.sparkSession
    rated = ratings.select(row_id, F.col(grade).cast("int").alias("_grade")).filter(F.col("_grade").isNotNull() & ~never_fitted(row_id))
    n = rated.count()
    part = F.pmod(F.xxhash64(row_id, F.lit("fit")), F.lit(10**6)) < F.lit(int(10**6 * min(1.0, sample / max(n, 1))))
    chosen = spool(rated.filter(part), "ratings")
    texts = docs.select(row_id, text_or_empty(text).alias("_text"))
    rows = lookup(texts, chosen, [row_id], "inner", spread=row_id)

    def extract(batches):
        make = Features()
        for batch in batches:
            made = [make(t) for t in batch.column(0).to_pylist()]
            if made:
                yield pa.RecordBatch.from_arrays([
                    pa.array([s.astype(np.int32).tobytes() for s, _ in made], pa.binary()),
                    pa.array([v.astype(np.float32).tobytes() for _, v in made], pa.binary()), batch.column(1), batch.column(2),
                ], ["slots", "vals", "grade", "place"])

    order = F.xxhash64(row_id, "_text", "_grade")
    made = spool(rows.select("_text", "_grade", order).mapInArrow(extract, "slots binary, vals binary, grade int, place bigint"), "features").df
    grades = tuple(r["grade"] for r in made.select("grade").distinct().orderBy("grade").collect())
    if len(grades) < 2:
        return OrdinalModel(spark.sparkContext.broadcast(np.zeros(WIDTH)), (), grades or (0,))

    def learn(batches):
        held = [row for batch in batches for row in batch.to_pylist()]
        held.sort(key=lambda r: (r["place"], r["slots"], r["grade"]))
        rows = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["vals"], np.float32)) for r in held]
        levels = np.array([grades.index(r["grade"]) for r in held])
        scale = contrast(rows, levels, len(grades))
        weights, cuts = fit([(s, v * scale[s]) for s, v in rows], levels, len(grades))
        yield pa.RecordBatch.from_arrays([pa.array([(weights * scale).tobytes()]), pa.array([cuts.tolist()])], ["weights", "cuts"])

    row = made.coalesce(1).mapInArrow(learn, "weights binary, cuts array<double>").first()
    return OrdinalModel(spark.sparkContext.broadcast(np.frombuffer(bytes(row["weights"]), float)), tuple(row["cuts"]), grades)


def graded(docs: DataFrame, model: OrdinalModel, text: str = "text", keep_from: int | None = None, least: float = 0.5) -> DataFrame:
    """``docs`` with ``expected_grade``, ``at_least`` (a map from grade to tail probability) and ``kept``.

    ``kept``: the probability of grade ``keep_from`` (default: the highest) or better is ``least`` or
    more. A null text is scored like an empty one, by the thresholds alone. Input columns of the added
    names are replaced. Rows are judged one by one; an empty table gives an empty result.
    """
    weights, box = model.weights, []

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        if not box:
            box.append(Features())
        out = []
        for t in texts.to_pylist():
            slots, values = box[0](t)
            out.append(float((weights.value[slots] * values).sum()))
        return pa.array(out, pa.float64())

    made = "_" * (max(map(len, docs.columns)) + 1) + "score"
    scored = docs.withColumn(made, score(text_or_empty(text)))
    tail = {g: 1 / (1 + F.exp(F.lit(c) - F.col(made))) for g, c in zip(model.grades[1:], model.thresholds)}
    steps = [(b - a) * tail[b] for a, b in zip(model.grades, model.grades[1:])]
    expected = sum(steps, F.lit(float(model.grades[0])))
    wanted = model.grades[-1] if keep_from is None else keep_from
    reached = [g for g in model.grades if g >= wanted]
    sure = F.lit(0.0) if not reached else tail.get(reached[0], F.lit(1.0))
    tails = F.create_map(*[x for g in model.grades for x in (F.lit(g), tail.get(g, F.lit(1.0)))])
    return scored.withColumn("expected_grade", expected).withColumn("at_least", tails).withColumn("kept", sure >= least).drop(made)
