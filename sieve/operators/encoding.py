"""Vocabulary and fixed-length encodings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieve.functions.text import lower_tokens
from sieve.operators.ranking import ranked
from sieve.operators.spool import Spooled, lookup, spool

# Reserved ids; learnt tokens follow.
PAD, UNKNOWN, START, SEPARATOR = 0, 1, 2, 3
FIRST_ID = 4

Tokenizer = Callable[[Column], Column]


def long_tokens(rows: DataFrame, fields: Sequence[str] = ("title", "abstract"), carry: Sequence[str] = (),
                tokenizer: Tokenizer | None = None) -> DataFrame:
    """One row per token: topic_id, pid, field, pos (from 0), token. One pass for all fields."""
    from sieve.functions.text import tokens

    tokenizer = tokenizer or tokens

    def entries(field: str) -> Column:
        found = tokenizer(F.coalesce(F.col(field), F.lit("")))
        return F.transform(
            found, lambda t, i: F.struct(F.lit(field).alias("field"), i.alias("pos"), t.alias("token"))
        )

    return rows.select("topic_id", "pid", *carry, F.inline(F.concat(*[entries(f) for f in fields])))


def term_lists(rows: DataFrame, words: Column, keep: Sequence[str], name: str = "terms") -> DataFrame:
    """``keep`` and the different tokens of each text as an array of (token, n). Tokens are counted
    inside the row by sorting them, so nothing is shuffled."""
    listed = rows.select(*keep, F.sort_array(words).alias("_s"))
    entry = F.transform("_s", lambda t, i: F.struct(t.alias("token"), i.alias("at")))
    starts = F.filter(entry, lambda e: (e["at"] == 0) | (F.get("_s", e["at"] - 1) != e["token"]))
    end = lambda i: F.coalesce(F.get("_f", i + 1)["at"], F.size("_s"))
    terms = F.transform(
        "_f", lambda e, i: F.struct(e["token"].alias("token"), (end(i) - e["at"]).cast("bigint").alias("n"))
    )
    return listed.withColumn("_f", starts).select(*keep, terms.alias(name))


def term_rows(rows: DataFrame, words: Column, keep: Sequence[str]) -> DataFrame:
    """One row per different token of each text: ``keep``, token, n. A text without tokens keeps
    one row with nulls."""
    return term_lists(rows, words, keep, "_terms").select(*keep, F.inline_outer("_terms"))


def word_counts(rows: DataFrame, *fields: str, min_count: int = 1, tokenizer: Tokenizer = lower_tokens,
                keys: Sequence[str] = ()) -> DataFrame:
    words = F.concat(*[tokenizer(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    counts = rows.select(*keys, F.explode(words).alias("token")).groupBy(*keys, "token")
    return counts.agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def vocabulary(counts: DataFrame, max_size: int | None = None) -> DataFrame:
    """Stable ids by (count descending, token): token, n, token_id."""
    order = [F.desc("n"), "token"]
    if max_size is not None:
        counts = counts.orderBy(*order).limit(max_size)
    placed = ranked(counts, order, name="_rank", spread="token")
    return placed.select("token", "n", (F.col("_rank") + FIRST_ID - 1).alias("token_id"))


def heaviest_words(rows: DataFrame, *fields: str, size: int, tracked: int = 1 << 17, tokenizer: Tokenizer = lower_tokens) -> DataFrame:
    """The ``size`` most frequent words with their counts (ties by word), without a count of all words.

    Every task keeps a summary of ``tracked`` words at most, in which frequent ones cannot be missing, and the
    summaries are merged. Only the words found there are then counted exactly, so the long tail is never shuffled. A
    word outside can be as frequent as ``2 * 3.5 / tracked`` of all words; where the last of the result is not above
    that, all words are counted after all. So the result is exact either way.
    """
    words = F.concat(*[tokenizer(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    tokens = rows.select(F.explode(words).alias("token"))
    summary = tokens.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(token, {tracked}, {tracked})").alias("top"))
    summary = spool(summary, "summary").df  # one row of bounded size
    candidates = spool(summary.select(F.explode("top.item").alias("token")), "candidates")
    counts = lookup(tokens, Spooled(candidates.df.withColumn("_one", F.lit(1)), candidates.path, candidates.bytes), ["token"], "inner", spread="token")
    counts = counts.groupBy("token").agg(F.count("*").alias("n"))
    best = spool(counts.orderBy(F.desc("n"), "token").limit(size), "heaviest").df
    total = summary.first()["n"]
    row = best.agg(F.count("*").alias("words"), F.min("n").alias("least")).first()
    if row["words"] == size and row["least"] > 7.0 * total / tracked:
        return best
    return word_counts(rows, *fields, tokenizer=tokenizer).orderBy(F.desc("n"), "token").limit(size)


def _keep_longest_first(a: Column, b: Column, room: int) -> tuple[Column, Column]:
    """How many tokens two texts keep when the longer is cut first, ties from the second."""
    fits = a + b <= room
    keep_a = F.when(fits, a).otherwise(F.least(a, F.greatest(F.lit((room + 1) // 2), F.lit(room) - b)))
    return keep_a, F.when(fits, b).otherwise(F.lit(room) - keep_a)


def _encode(rows: DataFrame, segments: list[Column], vocab: DataFrame | Spooled, max_length: int,
            keys: Sequence[str]) -> DataFrame:
    """Ids of the (already cut) token lists with markers, masks and padding.

    Only tokens that fit are exploded, so a group never holds more than ``max_length`` rows.
    """
    if not isinstance(vocab, Spooled):
        vocab = spool(vocab, "vocabulary")
    entry = lambda s: lambda t, i: F.struct(F.lit(s).alias("s"), i.alias("i"), t.alias("token"))
    entries = F.concat(*[F.transform(words, entry(s)) for s, words in enumerate(segments)])
    tokens = rows.select(*keys, F.inline_outer(entries))
    known = lookup(tokens, vocab, ["token"], "left", spread=keys[-1], weight="n")
    ident = F.when(F.col("token").isNotNull(), F.coalesce(F.col("token_id"), F.lit(UNKNOWN)).cast("int"))
    placed = F.when(ident.isNotNull(), F.struct("s", "i", ident.alias("id")))
    grouped = known.groupBy(*keys).agg(F.sort_array(F.collect_list(placed)).alias("_ids"))

    marker = lambda m: F.array(F.lit(m))
    ids, kinds = marker(START), F.array_repeat(F.lit(0), 1)
    ids_of = lambda s: F.transform(F.filter("_ids", lambda e: e["s"] == s), lambda e: e["id"])
    for s in range(len(segments)):
        part = ids_of(s)
        ids = F.concat(ids, part, marker(SEPARATOR))
        kinds = F.concat(kinds, F.array_repeat(F.lit(s), F.size(part) + 1))
    pad = lambda col: F.concat(col, F.array_repeat(F.lit(PAD), max_length - F.size(col)))
    return grouped.select(*keys, ids.alias("_x"), kinds.alias("_k")).select(
        *keys,
        pad(F.col("_x")).alias("input_ids"),
        pad(F.array_repeat(F.lit(1), F.size("_x"))).alias("attention_mask"),
        pad(F.col("_k")).alias("token_type_ids"),
    )


def encode_pairs(rows: DataFrame, vocab: DataFrame | Spooled, max_length: int = 350,
                 keys: Sequence[str] = ("topic_id", "pid"), tokenizer: Tokenizer = lower_tokens) -> DataFrame:
    """title and abstract as one sequence: START title SEPARATOR abstract SEPARATOR PAD..."""
    empty = F.lit("")
    cut = rows.select(
        *keys, "relevance",
        tokenizer(F.coalesce("title", empty)).alias("_t"), tokenizer(F.coalesce("abstract", empty)).alias("_a"),
    )
    keep_t, keep_a = _keep_longest_first(F.size("_t"), F.size("_a"), max_length - 3)
    segments = [F.slice("_t", 1, keep_t), F.slice("_a", 1, keep_a)]
    out = _encode(cut, segments, vocab, max_length, ["relevance", *keys])
    return out.withColumnRenamed("relevance", "label").withColumn("label", F.col("label").cast("float"))


def encode_texts(rows: DataFrame, vocab: DataFrame | Spooled, max_length: int = 128, text: str = "text",
                 keys: Sequence[str] = ("topic_id", "pid"), tokenizer: Tokenizer = lower_tokens) -> DataFrame:
    cut = F.slice(tokenizer(F.coalesce(F.col(text), F.lit(""))), 1, max_length - 2)
    return _encode(rows, [cut], vocab, max_length, list(keys)).drop("token_type_ids")


def batch_offsets(rows: DataFrame, size: Column, keys: Sequence[str] = ("topic_id", "batch_id")) -> DataFrame:
    """Where each example starts in the flat token list of its batch."""
    before = Window.partitionBy(*keys).orderBy("row_in_batch").rowsBetween(Window.unboundedPreceding, -1)
    sized = rows.withColumn("n_tokens", size)
    return sized.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def flat_batches(rows: DataFrame, tokens: str = "tokens", keys: Sequence[str] = ("topic_id", "batch_id")) -> DataFrame:
    """One record per batch: labels, the tokens of all examples in a row, and their offsets."""
    example = F.struct("row_in_batch", "relevance", F.col(tokens).alias("tokens"), "offset")
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(example)).alias("_b"))
    return grouped.select(
        *keys,
        F.col("_b.relevance").alias("labels"),
        F.flatten(F.col("_b.tokens")).alias("tokens"),
        F.col("_b.offset").alias("offsets"),
    )
