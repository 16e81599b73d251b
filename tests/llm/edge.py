"""Small tables with everything that tends to break: nulls, empty and long texts, ties, repeats, clashing names."""

from __future__ import annotations

LONG = "word " * 3000 + "x" * 20_000
TEXTS = [
    "The cat sat on the mat and looked at the moon for a long time",
    "the cat sat on the mat and looked at the moon for a long time",
    "  \t\n ",
    "",
    None,
    LONG,
    "short",
    "Être ou ne pas être, telle est la question \U0001f600 漢字 \x1c\x85\xa0 a'll 12 ½",
    "Call +1 (212) 555-0147 or mail jo.doe7@example.org, card 4111 1111 1111 1111, on 2024-02-29.",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, kept string, ids int, _key int, node int, rate int"


def rows() -> list[tuple]:
    """Ids 0.. and then repeated rows, a repeated id with another text, null ids, null everything."""
    out = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i % 4 else None, 1, "a", "b", 1, 2, 3, 4) for i, t in enumerate(TEXTS)]
    out += [out[0], out[0], (1, "another text under the same id", "en", "s1", 1, "a", "b", 1, 2, 3, 4)]
    out += [(None, TEXTS[0], None, "s1", None, None, None, None, None, None, None)]
    out += [(None,) * 11]
    return out


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def empty(spark):
    return table(spark, [])
