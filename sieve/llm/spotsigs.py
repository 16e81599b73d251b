"""Document fingerprints from spot signatures.

Common words are anchors; an anchor and the chain of content words that follow it make one spot
signature, and a document's fingerprint is the set of its signatures. Anchors are frequent in prose
and rare in lists, so the fingerprint follows what a document says; ``whole`` also covers what lies far from any anchor. Two fingerprints are compared by
Jaccard; sets whose sizes alone keep them below a threshold are never compared, because sets are
partitioned by length, and within a partition only sets that share one of their rarest signatures meet.

Everything is DataFrame expressions: the j-th anchor at word p has p - j content words before it, so
its chain is a slice of the content words and no loop over words is needed.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.llm.common import text_or_empty
from sieve.operators.ranking import ranked
from sieve.operators.spool import lookup, spool

# Frequent function words of English, French, German and Spanish.
ANCHORS = (
    "the", "a", "an", "and", "or", "of", "to", "in", "is", "are", "was", "were", "be", "been", "that", "it", "for", "on", "with",
    "as", "at", "by", "this", "from", "not", "but", "have", "has", "had", "you", "they", "we",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "est", "dans", "pour", "par", "sur", "au", "aux",
    "ne", "pas", "il", "elle", "ce", "se",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "ein", "eine", "nicht", "auf", "sich", "dem", "für", "im", "sie", "er",
    "el", "los", "las", "y", "una", "por", "con", "para", "es", "del", "no", "su", "al", "lo", "como",
)
CHAIN = 3  # content words per signature
RUN = "~"  # stands for the anchor within a long run of content words
START = "^"  # the begin of a text is an anchor too, so every text with a content word has a signature


def _is_anchor(word: Column) -> Column:
    return word.isin(*ANCHORS)


def with_signatures(df: DataFrame, text: str, out: str, whole: bool = False) -> DataFrame:
    """Adds ``out``, the sorted set of 32-bit signature hashes of a text that is not null.

    Words are runs of letters and digits, lower-cased. A chain at the end of a text may be shorter. With
    ``whole``, each content word that the chain of the last anchor does not reach begins a chain of its own,
    so that every word of a text counts, however few anchors it has.
    """
    words, content, anchors = f"_{out}_words", f"_{out}_content", f"_{out}_anchors"
    split = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    df = df.withColumn(words, split).withColumn(content, F.filter(words, lambda w: ~_is_anchor(w)))

    def signature(anchor: Column, first: Column) -> Column:
        return F.hash(anchor, *[F.get(F.col(content), first + i) for i in range(CHAIN)])

    places = F.array_compact(F.transform(words, lambda w, i: F.when(_is_anchor(w), i)))
    df = df.withColumn(anchors, places)
    at_anchors = F.transform(anchors, lambda p, j: signature(F.get(F.col(words), p), p - j))
    at_start = F.when(F.size(content) > 0, F.array(signature(F.lit(START), F.lit(0)))).otherwise(F.array().cast("array<int>"))
    parts = [at_anchors, at_start]
    if whole:

        def beyond(place: Column, i: Column) -> Column:
            before = place - i  # anchors before the i-th content word
            first = F.when(before == 0, 0).otherwise(F.get(F.col(anchors), before - 1) - (before - 1))
            return F.when(i - first >= CHAIN, signature(F.lit(RUN), i))

        others = F.array_compact(F.transform(words, lambda w, i: F.when(~_is_anchor(w), i)))
        parts.append(F.array_compact(F.transform(others, beyond)))
    df = df.withColumn(out, F.array_sort(F.array_distinct(F.concat(*parts))))
    return df.drop(words, content, anchors)


def fingerprint(signatures: Column) -> Column:
    """The set as text: eight hexadecimal digits per signature, in the set's order."""
    low = lambda s: s.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.lower(F.hex(low(s))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets; two empty sets are alike."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, 1.0).otherwise(shared / either)


def beside_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", whole: bool = False) -> DataFrame:
    """Each document next to the one after it in descending order of the id, and to its edited text.

    Returns doc_id, n_chars, next_doc_id, text, edited, signatures, edited_signatures, next_signatures.
    The edited text has the last third of the characters replaced by the first as many of the next
    document; the document after the last is the first. A null text is empty, a null id comes last,
    documents with the same id follow each other by the hash of their text, and rows that agree in id
    and text are one document in the order and give one row each, with equal values; they are worked on
    once. An empty table gives no rows, and long texts are read whole.

    Texts are shuffled once, and signatures are made behind the shuffle. What a document passes on is its
    signatures, four bytes each, and at most a third of the receiver's length.
    """
    ident = F.coalesce(F.col(doc_id).cast("string"), F.lit("~"))
    body = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"), ident.alias("_ident"))
    body = body.withColumn("key", F.concat("_ident", F.lit(":"), F.hex(F.xxhash64("text")))).drop("_ident")
    slim = body.select("key", "doc_id", (F.char_length("text") / 3).cast("bigint").alias("wants"))
    slim = slim.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("wants").alias("wants"), F.count("*").alias("copies"))
    order = spool(ranked(slim, [F.col("doc_id").desc_nulls_last(), "key"], name="place", spread="key"), "order").df
    n = order.count()
    after = order.select(
        F.col("key").alias("taker"), F.col("wants").alias("taker_wants"), (F.col("place") % max(n, 1) + 1).alias("place")
    )
    route = spool(order.select("key", "place", "copies").join(after, "place").select("key", "taker", "taker_wants", "copies"), "route").df

    full = _once_each(body, route).join(route.hint("merge"), "key")
    passed = with_signatures(full, "text", "signatures", whole).select(
        F.col("taker").alias("key"),
        F.col("doc_id").alias("next_doc_id"),
        F.substring("text", F.lit(1), F.col("taker_wants").cast("int")).alias("_head"),
        F.col("signatures").alias("next_signatures"),
    )
    both = full.select("key", "doc_id", "text", "copies").join(passed.hint("merge"), "key")
    stays = F.char_length("text") - F.floor(F.char_length("text") / 3)
    both = both.withColumn("edited", F.concat(F.substring("text", F.lit(1), stays.cast("int")), F.col("_head")))
    both = with_signatures(with_signatures(both, "text", "signatures", whole), "edited", "edited_signatures", whole)
    found = both.select(
        "doc_id", F.char_length("text").cast("bigint").alias("n_chars"), "next_doc_id", "text", "edited", "signatures",
        "edited_signatures", "next_signatures", "copies",
    )
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copies")


def _once_each(body: DataFrame, route: DataFrame) -> DataFrame:
    """One row for each key of ``body``; every task hands on one row per key at most, so that repeated rows are not gathered."""
    repeated = spool(route.filter("copies > 1").select("key", "copies"), "repeated")
    if repeated.df.isEmpty():
        return body
    rows = body.withColumn("_spread", F.spark_partition_id())
    rows = lookup(rows, repeated, ["key"], "left", spread="_spread", weight="copies").drop("_spread")
    again = rows.filter("copies is not null").groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return rows.filter("copies is null").drop("copies").unionByName(again)


def near_pairs(sets: DataFrame, percent: int = 80, key: str = "key", signatures: str = "signatures") -> DataFrame:
    """(a, b, similarity): all pairs of different sets whose Jaccard reaches ``percent``, a < b.

    ``sets`` has one row per document; documents with equal sets are represented by the smallest key.
    Sets are partitioned by length so that sizes too far apart never meet: a set lies in its own
    partition and visits the next. Within one, two sets meet only over one of the rarest signatures
    that any pair above the threshold must share. Empty sets pair with nothing.
    """
    share = percent / 100
    reps = spool(
        sets.filter(F.size(signatures) > 0).groupBy(F.col(signatures).alias("s")).agg(F.min(key).alias("k"))
        .withColumn("n", F.size("s")).withColumn("part", F.floor(F.log(F.col("n").cast("double")) / log(1 / share)).cast("int")),
        "sets",
    ).df
    each = reps.select("k", "n", "part", F.explode("s").alias("sig"))
    counts = each.groupBy("sig").agg(F.count("*").alias("times"))
    ranked_sigs = each.join(counts, "sig").groupBy("k", "n", "part").agg(F.array_sort(F.collect_list(F.struct("times", "sig"))).alias("r"))
    keep = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    prefix = spool(ranked_sigs.select("k", "n", "part", F.explode(F.slice("r", F.lit(1), keep.cast("int"))).alias("r")), "prefixes").df
    home = prefix.select("k", "n", "part", F.col("r.sig").alias("sig"))
    visit = home.unionByName(home.withColumn("part", F.col("part") + 1)).select(
        F.col("k").alias("k2"), F.col("n").alias("n2"), "part", "sig"
    )
    close = F.least("n", "n2") * 100 >= F.greatest("n", "n2") * percent
    met = home.join(visit, ["part", "sig"]).filter((F.col("k") != F.col("k2")) & close)
    pairs = met.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()
    side = lambda name: reps.select(F.col("k").alias(name), F.col("s").alias(f"s_{name}"))
    joined = reduce(lambda df, name: df.join(side(name), name), ["a", "b"], pairs)
    return joined.withColumn("similarity", likeness(F.col("s_a"), F.col("s_b"))).select("a", "b", "similarity").filter(
        F.col("similarity") * 100 >= percent
    )
