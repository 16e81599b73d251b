"""Op 1."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from sieve.llm import lattice
from tests.llm.edge import empty, rows, table

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(word, weights):
    """Sum over all ways to cut a word into pieces."""
    return 1.0 if not word else sum(math.exp(weights[word[:k]]) * brute(word[k:], weights) for k in range(1, len(word) + 1) if word[:k] in weights)


def test_marginals_and_expected_pieces():
    pieces, prior = lattice.load_vocabulary(PATH)
    assert np.logaddexp.reduce(prior) == pytest.approx(0) and all(bytes([b]) in pieces for b in range(256))
    model, weights = lattice.Lattice(pieces, prior), dict(zip(pieces, prior))
    words = [b"the", b"thtion", "éaux".encode(), b"x", b"onthe.", b"\xff\x00"]
    got = model.log_probabilities(words)
    assert got == pytest.approx([math.log(brute(b" " + w, weights)) for w in words])
    counts, sums, one_by_one = np.array([1.0, 2, 3, 1, 1, 1]), np.zeros(len(pieces)), np.zeros(len(pieces))
    model.log_probabilities(words, counts, sums)
    for w, c in zip(words, counts):
        model._one(b" " + w, c, one_by_one)
    assert sums == pytest.approx(one_by_one)
    lengths = np.array([len(p) for p in pieces])
    assert sums @ lengths == pytest.approx(sum(c * (len(w) + 1) for w, c in zip(words, counts)))  # every byte is in one piece


def test_long_words_are_scored_like_short_ones(monkeypatch):
    pieces, prior = lattice.load_vocabulary(PATH)
    model = lattice.Lattice(pieces, prior)
    words = [b"interthermentation" * 3, b"a" * 60]
    batch = model.log_probabilities(words)
    monkeypatch.setattr(lattice, "LONG", 5)
    assert model.log_probabilities(words) == pytest.approx(batch)
    assert np.isfinite(model.log_probabilities([b"xyz" * 5000])).all()


def check(got, data):
    counts, ends = Counter(), 0
    for name, text in data:
        if zlib.crc32(str("" if name is None else name).encode()) % 7 != 2:
            counts.update((text or "").encode().lower().split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + (ends > 0)
    want = []
    for name, text in data:
        words = (text or "").encode().lower().split()
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words) + math.log10((ends + 1) / (n + v + 1))
        known = sum(counts[w] > 0 for w in words) + (ends > 0)
        want.append((str(name), zlib.crc32(str("" if name is None else name).encode()) % 7 == 2, len(words) + 1, known, n, round(base, 4)))
    have = [(str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got]
    assert sorted(have) == sorted(want)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_edge_rows(spark):
    got = lattice.scored(table(spark), PATH).collect()
    check(got, [(r[0], r[1]) for r in rows()])
    assert lattice.scored(empty(spark), PATH).count() == 0


def test_score_is_the_lattice_and_the_discounted_word(spark, monkeypatch):
    data = [(i, "the cat sat on the mat " * (1 + i % 3) + f"zq{i}") for i in range(40)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lattice.scored(df, PATH).collect()}
    check(list(got.values()), data)
    monkeypatch.setattr(lattice, "HOT", 3)  # nearly all words go through the join
    assert {r["doc_id"]: r["score"] for r in lattice.scored(df.repartition(3), PATH).collect()} == {k: r["score"] for k, r in got.items()}
    train = [t.split() for i, t in data if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()) + len(train), len(counts) + 1
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    discount = min(0.95, once / (once + 2 * twice))
    pieces, prior = lattice.load_vocabulary(PATH)
    weights = prior
    for _ in range(lattice.ROUNDS):
        sums = np.zeros(len(pieces))
        lattice.Lattice(pieces, weights).log_probabilities([w.encode() for w in counts], np.ones(len(counts)), sums)
        weights = np.log(sums + lattice.PRIOR * np.exp(prior)) - math.log(sums.sum() + lattice.PRIOR)
    free, table_ = discount * v / n, dict(zip(pieces, weights))
    for i in (0, 1, 13):
        want = math.log10((len(train) - discount) / n + free * lattice.END)
        for w in data[i][1].split():
            want += math.log10(max(counts[w] - discount, 0) / n + free * (1 - lattice.END) * brute(b" " + w.encode(), table_))
        assert got[i]["score"] == pytest.approx(want, abs=1e-5)
