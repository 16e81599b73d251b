"""Plans that must not regress: what is pushed down, pruned, broadcast, and kept out of one task."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sieve.operators import attribution as A
from sieve.operators import corpus as C
from sieve.operators import ranking as K
from sieve.operators.encoding import word_counts
from sieve.operators.spool import lookup, shared_dir, spool
from sieve.queries.base import Tables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_filter_reaches_the_scan(t):
    rows = C.not_null(t.table("labels"), "toxic").select("doc_id")
    assert "PushedFilters: [IsNotNull(toxic)]" in plan(rows)


def test_only_needed_columns_are_read(t):
    text = plan(t.judgments().groupBy("topic_id").count())
    assert "ReadSchema: struct<doc_id:bigint,lang:string>" in text and "text" not in text.split("ReadSchema")[1][:60]


def test_left_join_with_null_filter_becomes_inner(t):
    joined = C.judged_articles(t.judgments().select("topic_id", "pid"), t.articles())
    assert "Inner" in plan(joined) and "LeftOuter" not in plan(joined)


def test_misfits_are_an_anti_join(t):
    assert "LeftAnti" in plan(C.misfits(t.articles(), t.judgments()))


def test_top_k_is_cut_before_the_shuffle(t):
    rows = t.table("events").selectExpr("event_type as topic_id", "event_id", "value")
    text = plan(K.top_per_group(rows, ["topic_id"], [F.desc("value"), "event_id"], 5))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_slices_and_limits_do_not_sort_everything(t):
    assert "TakeOrderedAndProject" in plan(K.row_slice(t.table("events"), ["event_id"], 10, 25))


def test_counts_are_partial_first(t):
    text = plan(word_counts(t.articles(), "abstract"))
    assert "partial_count" in text and "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_ranks_have_no_window_over_the_rows(t, spark):
    rows = t.table("documents").selectExpr("lang as topic_id", "cast(doc_id as string) as pid")
    for df in (K.shuffled(rows), K.ranked(rows, ["pid"])):
        text = plan(df)
        # The one single-partition window is over bucket or partition sizes.
        for part in text.split("SinglePartition")[1:]:
            assert "documents.parquet" not in part.split("Window")[0].split("Join")[0]


def test_lookup_goes_by_stored_size(t, spark):
    rows = t.table("events").select("user_id", F.col("event_id").cast("string").alias("pid"))
    dim = spool(rows.groupBy("user_id").agg(F.count("*").alias("n")))
    assert dim.path.startswith(shared_dir(spark)) and dim.bytes > 0
    assert "BroadcastHashJoin" in plan(lookup(rows, dim, ["user_id"]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        salted = lookup(rows, dim, ["user_id"], weight="n")
        text = plan(salted)
        assert "SortMergeJoin" in text and "_salt" in text
        assert salted.columns == ["user_id", "pid", "n"]
        assert salted.filter("n is not null").count() == rows.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sampled_attributions_tokenise_once(t):
    rows = t.articles("lang as topic_id").withColumn("text", F.col("abstract"))
    text = plan(A.sampled_attributions(rows, lambda c: F.length(c).cast("double")))
    assert text.count("regexp_extract_all") == 1


def test_a_cluster_without_shared_folder_is_refused(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())
