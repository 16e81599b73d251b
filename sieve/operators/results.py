"""Raw explanations to what a reviewer reads. Every step but the last works inside one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieve.functions.numeric import as_double
from sieve.functions.text import is_word
from sieve.operators.attribution import _importance
from sieve.schemas import TOKEN_SCORE

# Topics with a description on the reading page (fixed values).
TOPIC_DESCRIPTIONS = {
    "CD011975": "Title: First trimester serum tests for Down's syndrome screening ",
    "CD012599": "Title: First and second trimester serum tests with and without first trimester "
    "ultrasound tests for Down's syndrome screening ",
    "CD010213": "Title: Imaging modalities for characterising focal pancreatic lesions ",
    "CD009925": "Title: Second trimester serum tests for Down's Syndrome screening ",
    "CD011984": "Title: Urine tests for Down's syndrome screening",
    "CD012010": "Title: Serum amylase and lipase and urinary trypsinogen and amylase for diagnosis "
    "of acute pancreatitis",
    "CD012165": "Title: Endometrial biomarkers for the non-invasive diagnosis of endometriosis",
}

_PARTS = f"array<{TOKEN_SCORE.simpleString()}>"


def class_index(classes: Column, target: str = "Relevant") -> Column:
    """1-based place of the class to explain: its name, else LABEL_1 (for Relevant), else the
    second of two; null when none fits."""
    place = lambda name: F.nullif(F.array_position(classes, name), F.lit(0).cast("bigint"))
    choices = [place(target)]
    if target == "Relevant":
        choices.append(place("LABEL_1"))
    choices.append(F.when(F.size(classes) == 2, F.lit(2).cast("bigint")))
    return F.coalesce(*choices)


def checked(explanation: Column) -> Column:
    """The explanation, or an empty one when tokens and scores do not match."""
    sizes_match = F.size(explanation["tokens"]) == F.size(explanation["scores"])
    usable = explanation["tokens"].isNotNull() & explanation["scores"].isNotNull() & sizes_match
    names = F.coalesce(explanation["classes"], F.array().cast("array<string>"))
    kept = F.struct(explanation["tokens"].alias("tokens"), explanation["scores"].alias("scores"), names.alias("classes"))
    nothing = F.struct(
        F.array().cast("array<string>").alias("tokens"), F.array().cast("array<array<double>>").alias("scores"),
        F.array().cast("array<string>").alias("classes"),
    )
    return F.when(usable, kept).otherwise(nothing)


def parts(explanation: Column, index: Column) -> Column:
    """Token and score of the chosen class; 0.0 where a score is missing or no number."""
    pairs = F.arrays_zip(explanation["tokens"].alias("t"), explanation["scores"].alias("s"))
    listed = F.transform(
        pairs,
        lambda p: F.struct(
            p["t"].alias("token"), as_double(F.try_element_at(p["s"], index.cast("int"))).alias("value")
        ),
    )
    return F.when(index.isNull(), F.array().cast(_PARTS)).otherwise(listed)


def ordered_words(all_parts: Column, verdict: Column) -> Column:
    """The words among the parts in the order the verdict asks for, ties in reading order."""
    words = F.filter(all_parts, lambda p: is_word(p["token"]))
    entry = F.transform(
        words,
        lambda p, i: F.struct(
            _importance(verdict, p["value"]).alias("key"), i.alias("pos"), p.alias("part"),
            F.lower(p["token"]).alias("w"),
        ),
    )
    return F.array_sort(entry)


def first_words(ordered: str, n: int = 5) -> Column:
    """First ``n`` words that differ by more than case. ``ordered`` names a column, so that the
    sort behind it is not repeated for each of the ``n`` steps."""

    def add_next(chosen: Column, _step: Column) -> Column:
        fresh = F.filter(ordered, lambda e: ~F.exists(chosen, lambda c: c["w"] == e["w"]))
        return F.concat(chosen, F.slice(fresh, 1, 1))

    chosen = F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.slice(ordered, 1, 0), add_next)
    return F.transform(chosen, lambda e: e["part"])


def article_results(raw: DataFrame, target: str = "Relevant", n: int = 5) -> DataFrame:
    """Raw explanation records to explained articles; other columns pass through."""
    shaped = raw.withColumn("_t", checked(F.col("title_expl"))).withColumn("_a", checked(F.col("abstract_expl")))
    classes = F.when(F.size("_t.classes") > 0, F.col("_t.classes")).otherwise(F.col("_a.classes"))
    shaped = (
        shaped.withColumn("_i", class_index(classes, target))
        .withColumn("title", F.coalesce("title", F.lit("N/A")))
        .withColumn("abstract", F.coalesce("abstract", F.lit("")))
        .withColumn("verdict", F.coalesce("verdict", F.lit("N/A")))
        .withColumn("explained_title_parts", parts(F.col("_t"), F.col("_i")))
        .withColumn("explained_abstract_parts", parts(F.col("_a"), F.col("_i")))
    )
    both = F.concat("explained_title_parts", "explained_abstract_parts")
    return (
        shaped.withColumn("_words", ordered_words(both, F.col("verdict")))
        .withColumn("top_words", first_words("_words", n))
        .drop("_t", "_a", "_i", "_words", "title_expl", "abstract_expl")
    )


def topic_pages(articles: DataFrame, page_size: int = 15) -> DataFrame:
    """Nested topic results: topic_name, page, articles, and the same as JSON.

    ``articles`` has topic_id, position (from 0) and the article columns. A page holds a bounded
    run of articles, as a result file does; all pages together hold every article, and a topic of
    any size is never gathered in one place.
    """
    fields = ["title", "abstract", "verdict", "explained_title_parts", "explained_abstract_parts", "top_words"]
    page = F.floor(F.col("position") / page_size).cast("bigint")
    listed = F.sort_array(F.collect_list(F.struct("position", F.struct(*fields).alias("article"))))
    nested = articles.groupBy(F.col("topic_id").alias("topic_name"), page.alias("page")).agg(listed.alias("_l"))
    nested = nested.select("topic_name", "page", F.col("_l.article").alias("articles"))
    return nested.withColumn("json", F.to_json(F.struct("topic_name", "articles")))


def highlight(value: Column, max_value: float = 0.5) -> Column:
    """Colour and strength behind a token: red for, green against, nothing close to zero."""
    strength = F.least(F.abs(value) / max_value, F.lit(1.0)) * 0.6 + 0.1
    colour = (
        F.when(value > 0.001, F.lit("red")).when(value < -0.001, F.lit("green")).otherwise(F.lit("transparent"))
    )
    return F.struct(
        colour.alias("colour"), F.when(colour == "transparent", F.lit(0.0)).otherwise(strength).alias("alpha")
    )


def rebuilt_text(token_parts: Column, default: Column) -> Column:
    """Tokens as text, a blank before each later one that starts with an ASCII word character."""
    spaced = F.transform(
        token_parts,
        lambda p, i: F.when((i > 0) & p["token"].rlike("^[A-Za-z0-9_]"), F.concat(F.lit(" "), p["token"])).otherwise(
            p["token"]
        ),
    )
    return F.when(F.coalesce(F.size(token_parts), F.lit(0)) > 0, F.array_join(spaced, "")).otherwise(default)


def shown_verdict(verdict: Column, invert: bool = False) -> Column:
    if not invert:
        return verdict
    return (
        F.when(verdict == "Relevant", F.lit("Irrelevant")).when(verdict == "Irrelevant", F.lit("Relevant")).otherwise(verdict)
    )


def word_colour(value: Column) -> Column:
    return F.when(value > 0, F.lit("darkred")).otherwise(F.lit("darkgreen"))


def verdict_colour(verdict: Column) -> Column:
    return F.when(verdict == "Relevant", F.lit("green")).otherwise(F.lit("red"))
