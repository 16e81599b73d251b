"""Op 8."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sieve.llm import bpe
from tests.llm.edge import TEXTS, empty, table

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return bpe.Coder(ranks, public_tokenizers.PATTERN), library


def test_random_texts_as_the_library(both):
    own, library = both
    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\xa0", "　", "\x1c", "\x85", "a", "th", "ing", "'s", "'ll", "'", "1", "23", "é", "ß", "!", "?!", "the", "漢", "😀"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 15))) for _ in range(4000)]
    texts += ["".join(draw.choices("abcdetionsh", k=draw.randint(1, 80))) for _ in range(1000)]
    texts += [f"a{chr(c)}1 {chr(c)}{chr(c)}!" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    for t in texts:
        ids = own.encode(t)
        assert ids == library.encode_ordinary(t), t
        assert own.decode(ids) == t.encode()


def test_small_memories_change_nothing(both, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    own = bpe.Coder(bpe.load_ranks(PATH), public_tokenizers.PATTERN)
    text = "the thinthon, erthing! other words of ththe same " * 3
    assert own.encode(text) == both[1].encode_ordinary(text)


def test_edge_rows(spark, both):
    vocabulary = bpe.Vocabulary(spark, PATH, public_tokenizers.PATTERN)
    df = bpe.decoded(bpe.encoded(table(spark), vocabulary), vocabulary)
    for r in df.select("text", "ids", "bytes").collect():
        assert r["ids"] == both[1].encode_ordinary(r["text"] or "") and bytes(r["bytes"]) == (r["text"] or "").encode()
    digests = bpe.round_trip(table(spark), vocabulary, keep=["doc_id"])
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = table(spark).select(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).collect()
    assert sorted(r["decoded_sha256"] for r in digests.collect()) == sorted(r[0] for r in want)
    assert bpe.round_trip(empty(spark), vocabulary, keep=["doc_id"]).count() == 0
    assert bpe.decoded(spark.createDataFrame([(None,)], "ids array<int>"), vocabulary).first()["bytes"] is None
    assert any(t and len(t) > 20_000 for t in TEXTS)
