"""The pipeline, stage by stage, and every query of this package."""

from __future__ import annotations

import hashlib
import re

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from sieve.llm import bpe, mixing, pseudonyms
from sieve.llm.queries import ORACLES, PSEUDONYM_KEY, QUERIES
from tests.llm.test_minhash import brute, shingles
from tests.llm.test_sharding_mixing import brute_targets
from tests.oracle import compare, duck

SF = entry.SMOKE_DIR


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, name):
    assert name in entry.queries()
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare(df, duck(SF), ORACLES[name]) is None
    else:
        table, each = {"page_languages": ("pages", 1), "op11_whitened_embeddings": ("embeddings", 16)}.get(name, ("documents", 1))
        assert df.count() == each * spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_one_query_per_operator():
    numbers = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in entry.queries()) if m)
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_stages(spark):
    """Each stage on what the one before kept, against a plain version."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = [(10**6, "", "en", "src0", 0), (10**6 + 1, None, "en", None, None), (10**6 + 2, "1 2 3 ... !!", "fr", "src1", 12)]
    docs = docs.union(spark.createDataFrame(bad, docs.schema))
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF)
        after = made.collect()
        if name == "language ID":
            kept = {r["doc_id"] for r in after}
            assert kept == {r["doc_id"] for r in before if r["doc_id"] < 10**6}
        elif name == "near-dedup":
            ids = [(r["doc_id"], r["text"]) for r in before]
            assert {r["doc_id"] for r in after} == {i for i, _, c in brute(ids, corpus_pipeline.SIMILARITY) if i == c}
        elif name == "PII":
            own = pseudonyms.Pseudonyms(PSEUDONYM_KEY)
            assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in after} == {
                r["doc_id"]: (t := own.apply(r["text"])[0], len(t)) for r in before
            }
        elif name == "mixing sources":
            sizes, words = {}, {r["doc_id"]: len(r["text"].encode().split()) for r in before}
            for r in before:
                sizes[r["source"]] = sizes.get(r["source"], 0) + words[r["doc_id"]]
            target, times = brute_targets(sizes), {}
            for r in after:
                times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
            for r in before:
                rate = target[r["source"]] / sizes[r["source"]]
                u = int(hashlib.md5(f"mix:{r['doc_id']}:{hashlib.md5(r['text'].encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2**52
                assert times.get(r["doc_id"], 0) == int(rate) + (u < rate - int(rate))
        else:
            ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
            library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            text = {r["doc_id"]: r["text"] for r in before}
            assert len(after) == len(before)
            for r in after:
                ids = library.encode_ordinary(text[r["doc_id"]])
                assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
                assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
            break
        assert made.columns == docs.columns and made.schema.simpleString() == docs.schema.simpleString()
        docs, before = spark.createDataFrame(after, docs.schema), after
    assert shingles("a b") == {(b"a", b"b")}


def test_run_on_nothing_and_on_edges(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
    some = docs.limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (1, " ", "en", None, 1), (7, "x" * 30_000, "en", "s", 2)], docs.schema)
    some.union(some.limit(5)).union(odd).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "odd")).count() > 0


@pytest.mark.parametrize("name", ["op2_feistel_shards", "op4_spot_signatures", "op9_source_mix"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
    assert mixing.planned(spark.range(3).select(F.lit("a b").alias("text"), F.lit("s").alias("source"), F.col("id").alias("doc_id"))).count() == 3


def test_near_dedup_leaves_one_row_of_repeated_ids(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    nobody = spark.createDataFrame([(None, "one two three four five six", "en", "s", 1)] * 3, docs.schema)
    once = corpus_pipeline.drop_near_copies(spark, docs, SF).count()
    assert corpus_pipeline.drop_near_copies(spark, docs.union(docs).union(docs.limit(7)).union(nobody), SF).count() == once + 1


INTERNAL = (
    "size rate copies target source_size language posterior Kept kept_ _n_values _gone_id _gone_hash _row node sig bands bucket "
    "_key _draw _place _all _times _n_docs key u v root component_id text_hash n_shingles rep best _others _made _logs _tie _from"
).split()


def test_stages_leave_columns_alone_that_they_do_not_own(spark):
    """Names that stages and operators use themselves, in columns of the documents, with values that tell."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    docs = docs.unionByName(docs.limit(4)).select("*", *[
        F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")).alias(name) if i % 2 else (F.col("doc_id") * (i + 3)).alias(name)
        for i, name in enumerate(INTERNAL)
    ])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.schema.simpleString() == docs.schema.simpleString(), name
        rows = after.collect()
        assert rows, name
        for r in rows:
            for i, c in enumerate(INTERNAL):
                assert r[c] == (f"{c} of {r['doc_id']}" if i % 2 else r["doc_id"] * (i + 3)), (name, c)
        docs = spark.createDataFrame(rows, docs.schema)
    assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()
