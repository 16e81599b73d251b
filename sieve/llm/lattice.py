"""Language-model scores from a subword lattice.

An existing subword vocabulary gives the pieces and, by the scores stored with them, their prior
weights. A text is a sequence of words and one end; a word with a blank in front may be cut into
pieces in many ways, and its probability is the sum over all of them, found by the forward recursion
in log space. Cuts never cross words, so a document's probability is the product over its words, and
the recursion runs once per distinct word of the corpus, not once per occurrence. The weights are
fitted to the distinct training words by expectation maximisation (expected piece counts from forward
and backward sums), with the stored scores as prior.

Each training word is one more arc through its own lattice, weighted by its discounted frequency; what
the discounts free is the weight of all cuts into pieces, which is how a word never seen gets its
probability. So what the model learns grows with the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.operators.spool import spool

ROUNDS = 3  # rounds of expectation maximisation
PRIOR = 300.0  # training pieces that the stored scores count as
END = 0.01  # share of the end of a text where no training text tells
UNIT = 1e-9  # log10 probabilities of words are summed as integers of this unit, so any order gives the same sum
HOT = 200_000  # words with more than this fraction of the tokens go to every task: fewer than HOT
HOT_BYTES = 64  # longer words do not
PENDING = 200_000  # distinct words that a task counts before it passes them on
LONG = 256  # bytes from which a word is not scored in a batch


class Lattice:
    """Pieces in a trie and their natural-log weights."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.pieces, self.weights = pieces, weights
        step: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for i, piece in enumerate(pieces):
            at = 0
            for byte in piece:
                if byte not in step[at]:
                    step[at][byte] = len(step)
                    step.append({})
                    ends.append(-1)
                at = step[at][byte]
            if piece:
                ends[at] = i
        self.step, self.ends = step, np.array(ends, np.int32)
        self.table = np.zeros((len(step), 256), np.int32)  # 0: no such piece
        for at, to in enumerate(step):
            for byte, state in to.items():
                self.table[at, byte] = state

    def _edges(self, text: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(start, end, rows, pieces) for a batch of texts, in the order of start."""
        for start in range(text.shape[1]):
            rows = np.flatnonzero(sizes > start)
            state = np.zeros(len(rows), np.int32)
            for end in range(start, text.shape[1]):
                state = self.table[state, text[rows, end]]
                live = (state > 0) & (sizes[rows] > end)
                rows, state = rows[live], state[live]
                if not len(rows):
                    break
                piece = self.ends[state]
                full = piece >= 0
                if full.any():
                    yield start, end + 1, rows[full], piece[full]

    def _batch(self, words: list[bytes], counts: np.ndarray | None, sums: np.ndarray | None) -> np.ndarray:
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max())
        text = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        forward = np.full((len(words), width + 1), -np.inf)
        forward[:, 0] = 0.0
        edges = []
        for start, end, rows, piece in self._edges(text, sizes):
            gain = self.weights[piece]
            forward[rows, end] = np.logaddexp(forward[rows, end], forward[rows, start] + gain)
            if sums is not None:
                edges.append((start, end, rows, piece, gain))
        total = forward[np.arange(len(words)), sizes]
        if sums is not None:
            backward = np.full((len(words), width + 1), -np.inf)
            backward[np.arange(len(words)), sizes] = 0.0
            for start, end, rows, piece, gain in reversed(edges):
                after = gain + backward[rows, end]
                backward[rows, start] = np.logaddexp(backward[rows, start], after)
                share = np.exp(forward[rows, start] + after - total[rows]) * counts[rows]
                sums += np.bincount(piece, weights=share, minlength=len(sums))
        return total

    def _one(self, word: bytes, count: float, sums: np.ndarray | None) -> float:
        """The same for a long word, place by place."""
        n, weights = len(word), self.weights
        forward = [-math.inf] * (n + 1)
        forward[0] = 0.0
        edges = []
        for start in range(n):
            at = 0
            for end in range(start, n):
                at = self.step[at].get(word[end])
                if at is None:
                    break
                piece = int(self.ends[at])
                if piece >= 0:
                    forward[end + 1] = float(np.logaddexp(forward[end + 1], forward[start] + weights[piece]))
                    if sums is not None:
                        edges.append((start, end + 1, piece))
        if sums is not None:
            backward = [-math.inf] * (n + 1)
            backward[n] = 0.0
            for start, end, piece in reversed(edges):
                after = weights[piece] + backward[end]
                backward[start] = float(np.logaddexp(backward[start], after))
                sums[piece] += math.exp(forward[start] + after - forward[n]) * count
        return forward[n]

    def log_probabilities(
        self, words: list[bytes], counts: np.ndarray | None = None, sums: np.ndarray | None = None
    ) -> np.ndarray:
        """Natural log of each word's marginal probability; with ``sums``, adds the expected pieces of all words."""
        out = np.zeros(len(words))
        spaced = [b" " + w for w in words]
        order = sorted(range(len(words)), key=lambda i: len(spaced[i]))
        at = 0
        while at < len(order):
            if len(spaced[order[at]]) > LONG:
                i = order[at]
                out[i] = self._one(spaced[i], 1.0 if counts is None else float(counts[i]), sums)
                at += 1
                continue
            take = at + 1  # words of like length, so little of the batch is padding
            while take < len(order) and take - at < 4096 and len(spaced[order[take]]) <= min(LONG, len(spaced[order[at]]) + 2):
                take += 1
            rows = order[at:take]
            out[rows] = self._batch([spaced[i] for i in rows], None if counts is None else counts[rows], sums)
            at = take
        return out


def load_vocabulary(path: str) -> tuple[list[bytes], np.ndarray]:
    """Pieces of a SentencePiece model as bytes (a blank for its word mark), all single bytes, and their
    prior weights: a stored log probability as it is, a stored merge rank r as 1 / (r + 10)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weights = {bytes([b]): 0.0 for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            weights[model.id_to_piece(i).replace("▁", " ").encode()] = model.get_score(i)
    pieces = sorted(weights)
    scores = np.array([weights[p] for p in pieces])
    if scores.min() < -1000:  # ranks of merges, written as 0, -1, -2, ...
        scores = -np.log(10.0 - scores)
        single = np.array([len(p) == 1 for p in pieces])
        scores[single] = np.minimum(scores[single], -math.log(1e5))
    return pieces, scores - np.logaddexp.reduce(scores)


def is_held_out(doc_id: str = "doc_id") -> Column:
    """Documents whose crc32 of the id as text leaves 2 when divided by 7; an id that is null counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _words(text: str | None) -> list[bytes]:
    """Bytes, so that A-Z alone are lowered and the six ASCII blanks alone separate."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(docs: DataFrame, held: Column, text: str = "text") -> DataFrame:
    """(word, c, c_all): occurrences in training documents and in all, with words counted in tasks before the shuffle."""

    def count(batches):
        train, every = Counter(), Counter()

        def flush():
            names = list(every)
            out = pa.RecordBatch.from_arrays(
                [pa.array(names, pa.binary()), pa.array([train[w] for w in names], pa.int64()), pa.array([every[w] for w in names], pa.int64())],
                ["word", "c", "c_all"],
            )
            train.clear()
            every.clear()
            return out

        for batch in batches:
            for t, is_held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _words(t)
                every.update(words)
                if not is_held:
                    train.update(words)
            if len(every) > PENDING:
                yield flush()
        if every:
            yield flush()

    counted = docs.select(F.col(text), held).mapInArrow(count, "word binary, c bigint, c_all bigint")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("c_all").alias("c_all"))


def _larger(batches: Iterator[pa.RecordBatch], rows: int = 32_768) -> Iterator[pa.RecordBatch]:
    """Words come in small batches, fit for texts; the recursion works on many at once."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def fitted(words: DataFrame, pieces: list[bytes], prior: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Log weights of the pieces, from the distinct training words of ``words`` (word, c)."""
    spark = words.sparkSession
    weights = prior
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((pieces, weights))

        def expect(batches, shared=shared):
            lattice = Lattice(*shared.value)
            sums = np.zeros(len(lattice.pieces))
            for batch in _larger(batches):
                lattice.log_probabilities(batch.column(0).to_pylist(), np.ones(batch.num_rows), sums)
            used = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(sums[used])], ["piece", "n"])

        found = words.filter("c > 0").select("word").mapInArrow(expect, "piece int, n double")
        sums = np.zeros(len(pieces))
        for r in found.groupBy("piece").agg(F.sum("n").alias("n")).collect():  # at most a row per piece
            sums[r["piece"]] = r["n"]
        weights = np.log(sums + PRIOR * np.exp(prior)) - math.log(sums.sum() + PRIOR)
    return weights


def scored(docs: DataFrame, vocabulary: str, held: Column | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row of ``docs``.

    ``score`` is the log10 probability of the whole text under the lattice model, ``base_score`` that
    under smoothed word frequencies, both learned from the rows that are not ``held``. A null text is
    empty: its only token is the end. Rows that repeat an id are scored one by one. With no training
    row, the lattice model is the prior. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    held = F.coalesce(is_held_out(doc_id) if held is None else held, F.lit(False))
    counts = spool(word_counts(docs, held, text), "words").df
    ends = docs.select(held.alias("held")).filter("not held").count()
    times = lambda k: F.count(F.when(F.col("c") == k, 1))
    n, v, tokens, once, twice = counts.agg(
        F.sum("c"), F.count(F.when(F.col("c") > 0, 1)), F.sum("c_all"), times(1), times(2)
    ).first()
    n, v, tokens = (n or 0) + ends, v + (ends > 0), tokens or 0
    discount = min(0.95, max(0.05, once / (once + 2 * twice) if once else 0.5))
    open_share = discount * v / n if n else 1.0  # what the discounts free
    pieces, prior = load_vocabulary(vocabulary)
    shared = spark.sparkContext.broadcast((pieces, fitted(counts, pieces, prior)))
    end = max(ends - discount, 0.0) / max(n, 1) + open_share * END
    base_of = lambda c: (F.log10((c + 1) / F.lit(float(n + v + 1))) / UNIT).cast("bigint")

    def weigh(batches):
        lattice = Lattice(*shared.value)
        for batch in _larger(batches):
            cut = lattice.log_probabilities(batch.column(0).to_pylist()) + math.log(open_share * (1 - END))
            seen = np.maximum(batch.column(1).to_numpy() - discount, 0.0) / max(n, 1)
            whole = np.log(seen, out=np.full(len(seen), -np.inf), where=seen > 0)
            logs = np.logaddexp(whole, cut) / math.log(10)
            scores = pa.array(np.rint(logs / UNIT).astype(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], ["word", "c", "c_all", "score"])

    weighed = spool(
        counts.mapInArrow(weigh, "word binary, c bigint, c_all bigint, score bigint").withColumn("base", base_of(F.col("c"))),
        "weighed",
    ).df
    known = F.when(F.col("c") > 0, 1).otherwise(0).cast("bigint")
    # Fewer than HOT words can each have more than that share of the tokens, and each is short.
    hot_rows = weighed.filter((F.col("c_all") * HOT > tokens) & (F.octet_length("word") <= HOT_BYTES))
    hot = spark.sparkContext.broadcast(
        {bytes(r["word"]): (r["score"], r["base"], r["known"]) for r in hot_rows.select("word", "score", "base", known.alias("known")).collect()}
    )
    at_end = (round(math.log10(end) / UNIT), round(math.log10((ends + 1) / (n + v + 1)) / UNIT), int(ends > 0))

    id_type = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {id_type}, held_out boolean, row bigint, word binary, times bigint, score bigint, base bigint, seen bigint"

    def spread(batches):
        """Per document one row with what the hot words add up to, and one for each of its other words."""
        table = hot.value

        def packed(out, id_kind):
            kinds = (id_kind, pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "held_out", "row", "word", "times", "score", "base", "seen"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        for batch in batches:
            out, id_kind = [], batch.column(0).type
            for name, is_held, row, t in zip(*[c.to_pylist() for c in batch.columns]):
                words = _words(t)
                score, base, seen = at_end
                for word, times in Counter(words).items():
                    entry = table.get(word)
                    if entry is None:
                        out.append((None, None, row, word, times, None, None, None))
                    else:
                        score, base, seen = score + times * entry[0], base + times * entry[1], seen + times * entry[2]
                # A blank in front is in no word: this row meets nothing in the join and lies anywhere.
                out.append((name, is_held, row, b" %d" % row, len(words) + 1, score, base, seen))
                if len(out) > 50_000:
                    yield packed(out, id_kind)
                    out = []
            if out:
                yield packed(out, id_kind)

    rows = docs.select(F.col(doc_id), held, F.monotonically_increasing_id(), F.col(text))
    parts = rows.mapInArrow(spread, schema)
    met = parts.join(weighed.select("word", F.col("score").alias("s"), F.col("base").alias("b"), known.alias("k")), "word", "left")
    whole = F.col("score").isNotNull()
    add = lambda own, other: F.sum(F.coalesce(F.col(own), F.col("times") * F.col(other)))
    sums = met.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max(F.when(whole, F.col("times"))).alias("n_tokens"),
        add("seen", "k").alias("n_known"), add("base", "b").alias("base"), add("score", "s").alias("score"),
    )
    return sums.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") * UNIT).alias("base_score"), (F.col("score") * UNIT).alias("score"),
    )
