"""Balanced samples, negative samples and splits, each the same on every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sieve.functions.numeric import ceil_share
from sieve.operators.corpus import misfits, not_null, one_per_pid
from sieve.operators.ranking import SEED, flag_cuts, quota_cut, shuffled, within_cut
from sieve.operators.spool import spool


CLASS = ["topic_id", "relevance"]


def _with_size(histogram: DataFrame) -> DataFrame:
    return histogram.withColumn("size", F.sum("n").over(Window.partitionBy(*CLASS)))


def _keep_quota(sized: DataFrame, strict: bool) -> DataFrame:
    """keep: the size of the topic's smaller class."""
    of_class = lambda c: F.coalesce(
        F.max(F.when(F.col("relevance") == c, F.col("size"))).over(Window.partitionBy("topic_id")), F.lit(0)
    )
    sized = sized.withColumn("n_neg", of_class(0)).withColumn("n_pos", of_class(1))
    if strict and sized.filter("n_neg < n_pos").limit(1).count():
        raise ValueError("a topic has fewer irrelevant than relevant rows")
    return sized.withColumn("keep", F.least("n_neg", "n_pos")).withColumn("size", F.least("size", "keep"))


def _test_quota(sized: DataFrame, percent: int) -> DataFrame:
    """test: each class's share of ceil(N * percent / 100), by largest remainder."""
    topic = Window.partitionBy("topic_id")
    once = F.row_number().over(Window.partitionBy(*CLASS).orderBy("bucket")) == 1  # one row per class
    per_class = lambda c: F.sum(F.when(F.col("_once"), F.col(c))).over(topic)
    shares = (
        sized.withColumn("_once", once)
        .withColumn("_total", per_class("size"))
        .withColumn("_n_test", ceil_share(F.col("_total"), percent))
        .withColumn("_whole", F.expr("_n_test * size div greatest(_total, 1)"))
        .withColumn("_rest", F.expr("_n_test * size % greatest(_total, 1)"))
    )
    place = F.dense_rank().over(topic.orderBy(F.desc("_rest"), "relevance"))
    left_over = F.col("_n_test") - per_class("_whole")
    return shares.withColumn("test", F.col("_whole") + (place <= left_over).cast("bigint"))


def _known_classes(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("relevance").isin(0, 1))


def undersample(rows: DataFrame, seed: int | str = SEED, strict: bool = False) -> DataFrame:
    """Per topic as many irrelevant as relevant rows, drawn without replacement. Rows that repeat an
    id count one by one; a null topic is a topic like others.

    Where the irrelevant rows are fewer, the relevant ones are cut to their number; ``strict``
    raises instead. Grades other than 0 and 1 belong to neither class.
    """
    rows = _known_classes(rows)
    cut = quota_cut(rows, CLASS, lambda h: _keep_quota(_with_size(h), strict), ["keep"], seed)
    return within_cut(rows, cut, CLASS, "keep", seed)


def stratified_split(rows: DataFrame, seed: int | str = SEED, test_percent: int = 25) -> DataFrame:
    """Adds ``is_test``: per topic ceil(N * percent / 100) rows, each class by its share.

    Shares are rounded down and the rows left over go to the largest remainders, ties to the
    lower label.
    """
    cut = quota_cut(rows, CLASS, lambda h: _test_quota(_with_size(h), test_percent), ["test"], seed)
    return flag_cuts(rows, cut, CLASS, {"test": "is_test"}, seed)


def balanced_split(
    rows: DataFrame, seed: int | str = SEED, test_percent: int = 25, strict: bool = False
) -> DataFrame:
    """``undersample`` and then ``stratified_split``, with one histogram for both.

    ``cut_topics`` names the topics whose relevant rows are cut; ``strict`` refuses them. Both draw from the front of the same seeded order. All is decided on keys and ids; the texts
    are read once, to write the result.
    """
    rows = _known_classes(rows)
    ids = spool(rows.select("pid", *CLASS), "ids").df

    def both(histogram: DataFrame) -> DataFrame:
        return _test_quota(_keep_quota(_with_size(histogram), strict), test_percent)

    cut = quota_cut(ids, CLASS, both, ["keep", "test"], seed)
    flagged = flag_cuts(rows, cut, CLASS, {"keep": "_keep", "test": "is_test"}, seed)
    return spool(flagged.filter("_keep").drop("_keep"), "split").df


def cut_topics(rows: DataFrame) -> DataFrame:
    """Topics with fewer irrelevant than relevant rows, and how many relevant ones balancing drops."""
    sizes = rows.groupBy("topic_id").agg(
        F.count_if(F.col("relevance") == 0).alias("n_neg"), F.count_if(F.col("relevance") == 1).alias("n_pos")
    )
    return sizes.filter("n_neg < n_pos").withColumn("dropped", F.col("n_pos") - F.col("n_neg"))


def sample_negatives(
    positives: DataFrame, articles: DataFrame, seed: int | str = SEED, exclude: DataFrame | None = None
) -> DataFrame:
    """Positives plus as many articles nobody judged, each put under the topic of a positive.

    The k-th positive and the k-th drawn misfit, in two independent seeded orders, are paired, so
    every topic gets exactly as many negatives as it has positives. Only ids are ordered and
    paired; the texts are fetched for the drawn ids alone, one article per id.
    """
    texts = ("title", "abstract", "relevance")
    # Ids and topic columns once, for the count, the exclusion and the hosts.
    ids = spool(positives.select(*[c for c in positives.columns if c not in texts]), "positives").df
    judged = [ids] if exclude is None else [ids, exclude]
    pool = misfits(not_null(articles, "pid"), *judged).select("pid").distinct().withColumn("_all", F.lit(1))
    n = ids.count()
    cut = quota_cut(pool, ["_all"], lambda h: h.withColumn("draw", F.lit(n)), ["draw"], f"{seed}:misfit")
    drawn = spool(within_cut(pool, cut, ["_all"], "draw", f"{seed}:misfit").select("pid"), "misfits").df
    if drawn.count() < n:
        raise ValueError("not enough misfit articles for the positives")

    # A pid may be relevant to several topics, so the order of the hosts runs over both.
    host = F.concat_ws("\t", "pid", "topic_id")
    hosts = shuffled(
        ids.select(host.alias("_host"), *[c for c in ids.columns if c != "pid"]), seed=f"{seed}:host", id_col="_host", name="_k"
    ).drop("_host")
    guests = shuffled(drawn, seed=f"{seed}:misfit", name="_k")
    found = one_per_pid(not_null(articles, "abstract").join(drawn, "pid", "left_semi"))
    negatives = hosts.join(guests, "_k").drop("_k").join(found, "pid").withColumn("relevance", F.lit(0))
    return positives.unionByName(negatives)
