"""Text expressions. Each takes and returns a Column and runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java's \w and \s know ASCII only, so the Unicode classes are spelt out.
WORD = r"\p{L}\p{N}_"
SPACE = r"\s\p{Z}\x0b\x1c-\x1f\x85"
TOKEN = rf"([{WORD}]+|[^{WORD}{SPACE}])"
# The same white space as single characters (fixed values).
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Texts that a CSV field may use for "no value" (fixed values).
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def strip(text: Column) -> Column:
    """Cut white space of any kind off both ends (``trim`` cuts blanks only)."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def tokens(text: Column) -> Column:
    """Words, and every other mark that is not white space as a token of its own."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def lower_tokens(text: Column) -> Column:
    return tokens(F.lower(text))


def token_count(text: Column) -> Column:
    return F.size(tokens(text))


def is_word(token: Column) -> Column:
    """Has a Latin letter; words of other scripts only do not count."""
    return token.rlike("[a-zA-Z]")


def after_prefix(line: Column, prefix: str) -> Column:
    """What follows ``prefix``, stripped; null when the line does not start with it."""
    return F.when(line.startswith(prefix), strip(F.substring(line, len(prefix) + 1, 2**31 - 1)))


def has_suffix(text: Column, suffixes: list[str]) -> Column:
    found = F.lit(False)
    for suffix in suffixes:
        found = found | text.endswith(suffix)
    return found


def path_part(path: Column, n: int) -> Column:
    """The n-th part of a path; -1 is the file, -2 its folder."""
    return F.try_element_at(F.split(path, "/"), F.lit(n))


def between(name: Column, prefix: str, suffix: str) -> Column:
    """Cut a fixed prefix and suffix; null when either is missing."""
    fits = name.startswith(prefix) & name.endswith(suffix)
    inner = F.substr(name, F.lit(len(prefix) + 1), F.length(name) - len(prefix) - len(suffix))
    return F.when(fits, inner)


def base_id(name: Column) -> Column:
    """``CD012010_1`` -> ``CD012010``: the part before the first underscore."""
    return F.substring_index(name, "_", 1)


def shard_name(number: Column, pattern: str = "pubmed25n%s.xml.gz") -> Column:
    return F.format_string(pattern, F.lpad(number.cast("string"), 4, "0"))


def normal_key(key: Column) -> Column:
    """An id as text: ``007`` and ``7.0`` become ``7``; null stays null and matches nothing."""
    digits = r"^0*(\d+?)(?:\.0+)?$"
    text = strip(key.cast("string"))
    return F.when(text.rlike(digits), F.regexp_extract(text, digits, 1)).otherwise(text)


def null_if_missing(text: Column, missing: tuple[str, ...] = NULL_TOKENS) -> Column:
    return F.when(~text.isin(*missing), text)


def joined(*texts: Column, null_as: str | None = None) -> Column:
    """Texts joined by a blank. Nulls are left out, or written as ``null_as``."""
    if null_as is not None:
        texts = tuple(F.coalesce(t, F.lit(null_as)) for t in texts)
    return F.concat_ws(" ", *texts)


def screening_text(title: Column, abstract: Column) -> Column:
    """What a verdict is based on: title, blank, abstract, stripped; empty when both are."""
    empty = F.lit("")
    return strip(F.concat(F.coalesce(title, empty), F.lit(" "), F.coalesce(abstract, empty)))


def abbreviate(text: Column, width: int = 70, dots: str = "...") -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit(dots))).otherwise(
        text
    )


def list_label(title: Column, position: Column, width: int = 70) -> Column:
    """Abbreviated title; an article without one is named by its 1-based position."""
    fallback = F.concat(F.lit("Article "), position.cast("string"))
    return F.when(F.length(title) > 0, abbreviate(title, width)).otherwise(fallback)
