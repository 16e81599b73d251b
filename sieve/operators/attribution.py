"""What each token adds to a score, as a long table: topic, article, field, position, token, value."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.functions.numeric import sigmoid
from sieve.functions.text import SPACE, is_word, lower_tokens, tokens
from sieve.operators.encoding import long_tokens, term_rows
from sieve.operators.model import CLASS_NAMES, TokenModel, from_units, units, verdict, weigh
from sieve.operators.ranking import PLACE_BITS, SEED, quota_cut, top_per_group, within_cut
from sieve.operators.spool import broadcast_limit, lookup, spool

_ARTICLE = ["topic_id", "pid"]


def attributions(rows: DataFrame, model: TokenModel, carry: Sequence[str] = ()) -> DataFrame:
    """Title and abstract explained separately. Values of an article add up to logit - prior,
    what the text itself says against an empty one."""
    return weigh(long_tokens(rows, carry=carry), model).withColumnRenamed("weight", "value")


def judged_tokens(rows: DataFrame, model: TokenModel) -> DataFrame:
    """The long table with each article's verdict: the lists of the records taken apart again, so the
    verdict travels with the article and no token is shuffled for it."""
    records = explanation_records(rows, model)

    def entries(field: str) -> Column:
        parts = F.arrays_zip(F.col(f"{field}_expl.tokens").alias("token"), F.col(f"{field}_expl.scores").alias("pair"))
        return F.transform(parts, lambda p, i: F.struct(
            F.lit(field).alias("field"), i.cast("bigint").alias("pos"), p["token"].alias("token"), F.get(p["pair"], F.lit(1)).alias("value")
        ))

    none = F.array().cast("array<struct<field: string, pos: bigint, token: string, value: double>>")
    both = F.concat(*[F.coalesce(entries(f), none) for f in ("title", "abstract")])
    return records.select(*_ARTICLE, "verdict", F.inline(both))


def background_attributions(rows: DataFrame, model: TokenModel, background: DataFrame, n: int = 100,
                            seed: int | str = f"{SEED}:background") -> DataFrame:
    """Attribution relative to the mean of at most ``n`` background articles per topic.

    A token found x times gets weight * (x - mean x). Background tokens that the article lacks
    share one row with a null token, so the values add up to f(article) - f(background mean)
    without a row for each of them.
    """
    # Which articles is decided on ids alone; the texts of the few that are drawn are fetched where they lie.
    cut = quota_cut(background, ["topic_id"], lambda h: h.withColumn("draw", F.lit(n)), ["draw"], seed)
    sample = within_cut(background, cut, ["topic_id"], "draw", seed)
    words = F.concat(*[lower_tokens(F.coalesce(F.col(f), F.lit(""))) for f in ("title", "abstract")])
    sizes = sample.groupBy("topic_id").agg(F.count("*").alias("_docs"))
    counts = sample.select("topic_id", F.explode(words).alias("token")).groupBy("topic_id", "token").count()
    means = lookup(counts, sizes, ["topic_id"], "inner", spread="token").select(
        "topic_id", "token", (F.col("count") / F.col("_docs")).alias("mean")
    )
    dim = model.weights.df.join(means, ["topic_id", "token"], "left").select(
        "topic_id", "token", "weight", "n", (F.col("weight") * F.coalesce("mean", F.lit(0.0))).alias("_base")
    )
    dim = spool(dim.withColumnRenamed("n", "_n"), "background")
    whole = dim.df.groupBy("topic_id").agg(F.sum("_base").alias("_whole"))

    terms = term_rows(rows, words, _ARTICLE).filter("token is not null")
    valued = lookup(terms, dim, ["topic_id", "token"], "left", weight="_n").select(
        *_ARTICLE, "token", "n",
        (F.coalesce("weight", F.lit(0.0)) * F.col("n") - F.coalesce("_base", F.lit(0.0))).alias("value"),
        F.coalesce("_base", F.lit(0.0)).alias("_base"),
    )
    own = F.struct("token", "n", "value")
    per_article = lookup(
        valued.groupBy(*_ARTICLE).agg(F.collect_list(own).alias("_own"), F.sum("_base").alias("_seen")),
        whole, ["topic_id"], "left",
    )
    rest = F.struct(
        F.lit(None).cast("string").alias("token"), F.lit(0).cast("bigint").alias("n"),
        (F.col("_seen") - F.coalesce("_whole", F.lit(0.0))).alias("value"),
    )
    return per_article.select(*_ARTICLE, F.inline(F.concat("_own", F.array(rest))))


def sampled_attributions(rows: DataFrame, score_text: Callable[[Column], Column], permutations: int = 4,
                         groups: int = 8, seed: int | str = SEED, text: str = "text",
                         keys: Sequence[str] = ("topic_id", "pid")) -> DataFrame:
    """Attributions from a scoring function alone, by sampled permutations.

    The whole text is cut into at most ``groups`` runs of tokens (single tokens in short texts).
    For each permutation the runs are put back one at a time and every change of the score goes
    to the run that caused it, so per permutation the changes add up to f(text) - f(empty). Work
    grows with length * permutations * groups, spread over (article, permutation).
    """
    keys = list(keys)
    content = F.coalesce(F.col(text), F.lit(""))
    words = rows.filter(content.rlike(f"[^{SPACE}]")).select(*keys, tokens(content).alias("_w"))
    run = F.ceil(F.size("_w") / groups).cast("int")
    starts = F.sequence(F.lit(1), F.size("_w"), F.col("_run"))
    runs = F.transform(starts, lambda at: F.array_join(F.slice("_w", at, F.col("_run")), " "))
    cut = words.withColumn("_run", run).withColumn("_runs", runs).select(*keys, "_runs")

    # The outer explodes keep Catalyst from testing the arrays for emptiness, which would cut the
    # text a second time.
    ident = F.concat_ws(":", F.lit(str(seed)), *keys, F.col("perm").cast("string"))
    numbered = F.sequence(F.lit(0), F.size("_runs") - 1)
    shuffled = F.array_sort(
        F.transform(numbered, lambda g: F.struct(F.md5(F.concat(ident, F.lit(":"), g.cast("string"))), g.alias("g")))
    )
    drawn = cut.withColumn("perm", F.explode_outer(F.sequence(F.lit(1), F.lit(permutations))))
    drawn = drawn.withColumn("_order", F.transform(shuffled, lambda e: e["g"]))
    steps = drawn.withColumn("_step", F.explode_outer(F.sequence(F.lit(0), F.size("_runs"))))
    present = F.slice("_order", 1, F.col("_step"))
    kept = F.filter("_runs", lambda r, i: F.array_contains(present, i))
    added = F.when(F.col("_step") > 0, F.try_element_at("_order", F.col("_step")))
    scored = steps.select(
        *keys, "perm", "_step", added.alias("part"),
        F.when(F.col("perm") == 1, F.get("_runs", added)).alias("_text"),
        score_text(F.array_join(kept, " ")).alias("_score"),
    )
    previous = F.lag("_score").over(Window.partitionBy(*keys, "perm").orderBy("_step"))  # <= groups + 1 rows
    changes = scored.withColumn("_change", F.col("_score") - previous).filter(F.col("_step") > 0)
    values = changes.groupBy(*keys, "part").agg(F.avg("_change").alias("value"), F.max("_text").alias("_text"))
    return values.select(*keys, "part", "value", F.split("_text", " ").alias("tokens"))


def run_attributions(rows: DataFrame, score_text: Callable[[Column], Column], rounds: int = 4, width: int = 2,
                     text: str = "text", keys: Sequence[str] = ("topic_id", "pid")) -> DataFrame:
    """Attributions from a scoring function alone, finer where the score depends on the text: keys, lo, hi, value, tokens.

    The whole text is one run of tokens, worth f(text) - f(empty). In every round the ``width`` runs of each
    row with the largest values are halved. A half is worth the mean of what it changes beside its other half
    and without it, alone and within the rest of the text; what the two then lack of their run's value they
    share. So values add up to f(text) - f(empty) after any number of rounds, single tokens of a text of two
    have their Shapley values, an additive score gives every run its own, and enough rounds end at tokens.

    A round scores 4 * ``width`` texts a row. Rows may repeat their keys; a text without tokens has no runs.
    """
    keys = list(keys)
    content = F.coalesce(F.col(text), F.lit(""))
    words = rows.filter(content.rlike(f"[^{SPACE}]")).select(*keys, tokens(content).alias("_w")).filter(F.size("_w") > 0)
    joined = lambda *parts: F.array_join(F.concat(*parts), " ")

    def run(lo: Column, hi: Column, value: Column, alone: Column, without: Column) -> Column:
        return F.struct(*[c.alias(n) for c, n in ((lo, "lo"), (hi, "hi"), (value, "value"), (alone, "alone"), (without, "without"))])

    def written(df: DataFrame, runs: Column) -> DataFrame:
        """The rows after a round; as one text, tokens (which have no blanks) take half the room of an array."""
        found = spool(df.select(*keys, joined(F.col("_w")).alias("_w"), "_f0", "_f1", runs.alias("_runs")), "runs", "zstd").df
        return found.withColumn("_w", F.split("_w", " "))

    # A row's texts are scored side by side in the row, so no text is ever shuffled; each round is written once.
    f1, f0 = F.col("_f1"), F.col("_f0")
    state = words.withColumns({"_f0": score_text(F.lit("")), "_f1": score_text(joined(F.col("_w")))})
    state = written(state, F.array(run(F.lit(0), F.size("_w"), f1 - f0, f1, f0)))
    for _ in range(rounds):
        first = F.transform(F.filter("_runs", lambda r: r["hi"] - r["lo"] > 1), lambda r: F.struct(
            (-F.round(F.abs(r["value"]), 9)).alias("size"), r["lo"].alias("at"), r.alias("run")))
        split = state.withColumn("_split", F.transform(F.slice(F.array_sort(first), 1, width), lambda e: e["run"]))
        middle = lambda r: F.floor((r["lo"] + r["hi"]) / 2).cast("int")

        def four(r: Column) -> list[Column]:
            n, part = F.size("_w"), lambda lo, hi: F.slice("_w", lo + 1, hi - lo)
            lo, mid, hi = r["lo"], middle(r), r["hi"]
            zero = F.lit(0)
            return [
                joined(part(lo, mid)), joined(part(mid, hi)), joined(part(zero, lo), part(mid, n)), joined(part(zero, mid), part(hi, n))]

        at = lambda i: F.get("_split", F.lit(i))
        # Where fewer runs are left to halve, the score sees an empty text and nobody looks at the result.
        scores = {
            f"_s{4 * i + k}": score_text(F.coalesce(text, F.lit(""))) for i in range(width) for k, text in enumerate(four(at(i)))}
        split = split.withColumns(scores).withColumn("_s", F.array(*scores))

        def halves(r: Column, i: Column) -> Column:
            a, b, no_a, no_b = (F.get("_s", i * 4 + k) for k in range(4))
            alone, without, none, full = r["alone"], r["without"], F.col("_f0"), F.col("_f1")
            left = ((a - none) + (alone - b) + (no_b - without) + (full - no_a)) / 4
            right = ((b - none) + (alone - a) + (no_a - without) + (full - no_b)) / 4
            rest = (r["value"] - left - right) / 2
            return F.array(
                run(r["lo"], middle(r), left + rest, a, no_a), run(middle(r), r["hi"], right + rest, b, no_b))

        made = F.flatten(F.transform("_split", halves))
        kept = F.filter("_runs", lambda r: ~F.exists("_split", lambda x: x["lo"] == r["lo"]))
        state = written(split, F.concat(kept, made))
    out = state.select(*keys, "_w", F.explode("_runs").alias("_r"))
    return out.select(
        *keys, F.col("_r.lo").alias("lo"), F.col("_r.hi").alias("hi"), F.col("_r.value").alias("value"),
        F.slice("_w", F.col("_r.lo") + 1, F.col("_r.hi") - F.col("_r.lo")).alias("tokens"),
    )


def token_values(runs: DataFrame, keys: Sequence[str] = ("topic_id", "pid")) -> DataFrame:
    """keys, pos, token, value of every token; tokens of a run that was not halved share its value."""
    each = runs.select(*keys, "lo", (F.col("value") / F.size("tokens")).alias("value"), F.posexplode("tokens").alias("_at", "token"))
    return each.select(*keys, (F.col("lo") + F.col("_at")).cast("bigint").alias("pos"), "token", "value")


def _importance(decision: Column, value: Column) -> Column:
    """Smaller is more important: by score for Relevant, against it for Irrelevant, else by size."""
    return F.when(decision == "Relevant", -value).when(decision == "Irrelevant", value).otherwise(-F.abs(value))


def top_words(long: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` most telling words of each article (column ``verdict``), once per spelling in
    lower case; equal values in reading order."""
    first = F.struct(
        _importance(F.col("verdict"), F.col("value")).alias("key"),
        F.when(F.col("field") == "title", 0).otherwise(1).alias("field_no"),
        "pos", "token", "value",
    )
    words = long.filter(is_word(F.col("token")))
    per_spelling = words.groupBy(*_ARTICLE, "verdict", F.lower("token").alias("_w")).agg(F.min(first).alias("_f"))
    rows = per_spelling.select(*_ARTICLE, "verdict", "_f.*")
    best = top_per_group(rows, _ARTICLE, ["key", "field_no", "pos"], n)
    return best.select(*_ARTICLE, "verdict", F.col("rank").cast("bigint").alias("rank"), "token", "value")


def top_contributions(long: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` tokens with the largest absolute value, words or not, repeats included."""
    field_no = F.when(F.col("field") == "title", 0).otherwise(1)
    best = top_per_group(long, _ARTICLE, [F.abs("value").desc(), field_no, "pos"], n)
    return best.select(*_ARTICLE, F.col("rank").cast("bigint").alias("rank"), "token", "value")


_BLOCK_BYTES = 32 << 20  # stored articles, at most about, that share a table of words
_WEIGHTS = "struct<values: array<double>, total: bigint>"
_WEIGHTS_TYPE = pa.struct([("values", pa.list_(pa.float64())), ("total", pa.int64())])

_Words = dict[str, tuple[pa.Array, np.ndarray, np.ndarray]]  # topic: its words, their weights, the weights in whole units


def _runs(names: pa.Array, repeats: np.ndarray | None = None) -> Iterator[tuple[str, np.ndarray]]:
    """Each name and the places where it stands (with ``repeats``, where it would stand if repeated so often); null is none."""
    coded = names.dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    codes = codes if repeats is None else np.repeat(codes, repeats)
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(coded.dictionary) + 1))
    for name, lo, hi in zip(coded.dictionary.to_pylist(), ends, ends[1:]):
        yield name, order[lo:hi]


def _words_by_topic(words: pa.Table) -> _Words:
    """``words``: topic_id, token, weight, units."""
    words = words.combine_chunks()
    topic, token, weight, units = (c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in words.columns)
    weight, units = weight.to_numpy(), units.to_numpy()
    return {name: (token.take(pa.array(at)), weight[at], units[at]) for name, at in _runs(topic)}


def _weights_in(known: _Words, topics: pa.Array, keys: pa.Array) -> pa.Array:
    """The weight of every token of a row, in its order, and their sum; what a topic does not know weighs nothing."""
    flat, lengths = keys.flatten(), pc.list_value_length(keys).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    values, whole = np.zeros(len(flat)), np.zeros(len(flat), np.int64)
    for name, at in _runs(topics, lengths):
        if name in known and len(at):
            words, weight, units = known[name]
            found = pc.index_in(flat if len(at) == len(flat) else flat.take(pa.array(at)), value_set=words)
            hit, place = found.is_valid().to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy()
            values[at], whole[at] = np.where(hit, weight[place], 0.0), np.where(hit, units[place], 0)
    upto = np.concatenate([[0], np.cumsum(whole)])
    listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
    return pa.StructArray.from_arrays([listed, pa.array(upto[ends[1:]] - upto[ends[:-1]])], ["values", "total"])


def _weights_from(known: Broadcast) -> Callable[..., Column]:
    @F.arrow_udf(_WEIGHTS)
    def found(topics: pa.Array, keys: pa.Array) -> pa.Array:
        return _weights_in(known.value, topics, keys)

    return found


def _weights_behind() -> Callable[..., Column]:
    """For rows in the order of their blocks, in each the words first; a word's own row gets null."""

    @F.arrow_udf(_WEIGHTS)
    def found(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        block, words, known = None, [], None
        for blocks, topics, keys, token, weight, units in batches:
            of, is_word, out = blocks.to_numpy(), token.is_valid().to_numpy(zero_copy_only=False), []
            starts = np.flatnonzero(np.diff(of, prepend=-1) | np.diff(is_word, prepend=False)) if len(of) else []
            for lo, hi in zip(starts, [*starts[1:], len(of)]):
                if of[lo] != block:
                    block, words, known = of[lo], [], None
                if is_word[lo]:
                    words.append(pa.table([c.slice(lo, hi - lo) for c in (topics, token, weight, units)], ["topic_id", "token", "weight", "units"]))
                    out.append(pa.nulls(hi - lo, _WEIGHTS_TYPE))
                    continue
                if known is None:
                    known = _words_by_topic(pa.concat_tables(words)) if words else {}
                    words = []
                out.append(_weights_in(known, topics.slice(lo, hi - lo), keys.slice(lo, hi - lo)))
            yield pa.concat_arrays(out) if out else pa.nulls(0, _WEIGHTS_TYPE)

    return found.asNondeterministic()


def explanation_records(rows: DataFrame, model: TokenModel) -> DataFrame:
    """One raw explanation per row (topic_id, pid, title, abstract), with its verdict.

    A list is as long as the text. The values and the topic's prior add up to the logit, so the texts
    are weighed once for explanation and verdict together. Rows that repeat their keys are explained one by one.

    A model within the broadcast limit goes to all tasks, and nothing is written or shuffled. Of a larger one, each
    block of articles gets the words that occur in it: a word travels once per block, a text once to its block's words.
    """
    fields = ("title", "abstract")
    rows = rows.select(*_ARTICLE, *fields)
    words = {f"_{f}": tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields}
    keys = F.transform(F.concat(*words), F.lower)
    spark = rows.sparkSession
    if model.weights.bytes <= broadcast_limit(spark):
        known = model.weights.df.select("topic_id", "token", "weight", units(F.col("weight")).alias("units")).toArrow()
        weights = _weights_from(spark.sparkContext.broadcast(_words_by_topic(known)))
        listed = rows.withColumns(words).withColumn("_w", weights("topic_id", keys))
    else:
        stored = spool(rows.withColumn("_row", F.monotonically_increasing_id()), "articles", "zstd")  # written, so the number stays
        blocks = max(4 * spark.sparkContext.defaultParallelism, stored.bytes // _BLOCK_BYTES)
        in_block = max(1, stored.df.count() // blocks)
        place = F.col("_row").bitwiseAND(F.lit(2**PLACE_BITS - 1))
        rows = stored.df.withColumn("_block", F.col("_row") - place % in_block).drop("_row")  # by its first row
        each = rows.select("_block", "topic_id", F.explode(F.concat(*words.values())).alias("token"))
        terms = each.withColumn("token", F.lower("token")).distinct()
        found = weigh(terms, model, F.col("token"), spread="_block").filter("weight != 0")
        found = found.select("_block", "topic_id", "token", "weight", units(F.col("weight")).alias("units"))
        behind = rows.unionByName(found, allowMissingColumns=True).repartition(4 * blocks, "_block")  # few tasks get two
        behind = behind.sortWithinPartitions("_block", F.col("token").isNull()).withColumns(words)
        weights = _weights_behind()("_block", "topic_id", keys, "token", "weight", "units")
        listed = behind.withColumn("_w", weights).filter("_w is not null").drop("_block", "token", "weight", "units")

    def explanation(names: str, first: Column) -> Column:
        values = F.slice("_w.values", first, F.size(names))
        return F.struct(
            F.col(names).alias("tokens"), F.transform(values, lambda v: F.array(-v, v)).alias("scores"),
            F.array(*[F.lit(c) for c in CLASS_NAMES]).alias("classes"),
        )

    known = F.size("_w.values") > 0
    logit = F.col("prior") + from_units(F.col("_w.total"))
    return lookup(listed, model.priors, ["topic_id"], "left").select(
        *_ARTICLE, *fields, verdict(sigmoid(logit)).alias("verdict"),
        F.when(known, explanation("_title", F.lit(1))).alias("title_expl"),
        F.when(known, explanation("_abstract", F.size("_title") + 1)).alias("abstract_expl"),
    )
