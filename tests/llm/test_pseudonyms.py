"""Op 10."""

from __future__ import annotations

import random

import pytest

from sieve.llm.pseudonyms import Feistel, Pseudonyms, luhn_digit, pseudonymised
from tests.llm.edge import empty, rows, table

KEY = b"k"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_ring_is_a_permutation_without_fixed_points(n):
    f = Feistel(KEY, "t", n)
    images = [f.turn(x) for x in range(n)]
    assert sorted(images) == list(range(n)) and [f.turn(y, back=True) for y in images] == list(range(n))
    assert n == 1 or all(x != y for x, y in enumerate(images))


VALUES = [
    "4111111111111111", "4111-1111-1111-1111", "4111 1111 1111 1111", "378282246310005", "+1 (212) 555-0147", "+44 20 7946 0958",
    "(212) 555-0147", "212-555-0147", "123-45-6789", "192.168.3.14", "2024-02-29", "12/31/1999", "31/12/1999", "31.12.1999",
    "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "jo.doe7@example.org", "é.ü9@mail7.example.com",
]


@pytest.mark.parametrize("value", VALUES)
def test_value_changes_keeps_its_format_and_comes_back(value):
    p, back = Pseudonyms(KEY), Pseudonyms(KEY, back=True)
    text, n = p.apply(f"see {value}, or ({value})")
    assert n == 2 and value not in text and back.apply(text) == (f"see {value}, or ({value})", 2)
    new = text[4 : text.index(", or")]
    assert text == f"see {new}, or ({new})"  # equal values, equal pseudonyms
    shape = lambda s: [("d" if c.isdigit() else "a" if c.isalpha() else c) for c in s]
    if value.count(".") != 3:  # addresses keep four numbers, not their lengths
        assert shape(new) == shape(value)
    assert Pseudonyms(b"other").apply(value)[0] != p.apply(value)[0]


def test_one_number_in_two_formats_stays_one_number():
    p = Pseudonyms(KEY)
    digits = lambda s: "".join(c for c in p.apply(s)[0] if c.isdigit())
    assert digits("4111111111111111") == digits("4111-1111-1111-1111")
    assert digits("+1 (212) 555-0147") == digits("+12125550147")


def test_cards_stay_valid():
    p, draw = Pseudonyms(KEY), random.Random(1)
    for _ in range(200):
        body = "".join(draw.choices("0123456789", k=15))
        new, n = p.apply(body + luhn_digit(body))
        assert n == 1 and luhn_digit(new[:-1]) == new[-1]


@pytest.mark.parametrize("text", [
    "4111111111111112", "version 4.0. and 3.1.2", "1.2.3.4.5", "300.1.1.1", "token 681c09b8e90e7e8c9575180f595f646cf2969054",
    "2023-02-29", "000-12-3456", "a@b", "@", "x" * 100 + "@example.org", "DE00370400440532013000", "(see 12) + 5", "",
])
def test_what_is_not_valid_stays(text):
    assert Pseudonyms(KEY).apply(text) == (text, 0)


def test_neighbours():
    text, n = Pseudonyms(KEY).apply("7536784127813050 4845168114407329 was.91@mail6.example.com+1 (017) 555-7713%%%")
    assert n == 4 and Pseudonyms(KEY, back=True).apply(text)[1] == 4


@pytest.mark.parametrize("value, after", [
    ("+33 1 42 68 53 00", ""), ("+33 1 42 68 53 00", " 2024-02-29"), ("+33.1.42.68.53.00", " call"), ("+33\u00a01\u00a042\u00a068\u00a053\u00a000", "."),
    ("+7 495 123-45-67", ", office"), ("+7 (495) 123-45-67", ""), ("+49 (0)30 1234567", ""), ("212.555.0147", "."), ("212 555 0147", " now"),
    ("(212) 555 0147", ""), ("+44 20 7946 0958", " 2024 report"), ("+44 20 7946 0958", " 4111 1111 1111 1111"),
    ("+33 1 42 68 53 00", " 4111 1111 1111 1111"), ("BE68 5390 0754 7034", " THE"), ("BE68 5390 0754 7034", " OK"),
    ("BE68 5390 0754 7034", " 2024"), ("BE68539007547034", " 2024 OK 12"), ("DE89 3704 0044 0532 0130 00", " AND"), ("XX07 5390 0754 7034", " THE"),
])
def test_whole_value_goes_whatever_follows(value, after):
    text = f"tel {value}{after}"
    new, n = Pseudonyms(KEY).apply(text)
    assert n == 1 + (after.count("4111") or after.count("2024-")) and value not in new and Pseudonyms(KEY, back=True).apply(new) == (text, n)
    alone = Pseudonyms(KEY).apply(value)[0]
    assert new.startswith(f"tel {alone}") and alone[4:] != value[4:]
    assert after.count("4111") or after.count("2024-") or new == f"tel {alone}{after}"


def test_one_number_with_and_without_gaps():
    digits = lambda s: "".join(c for c in Pseudonyms(KEY).apply(s)[0] if c.isdigit())
    assert digits("+7 495 123-45-67") == digits("+74951234567") and digits("212 555 0147") == digits("212-555-0147") == digits("212.555.0147")
    assert digits("+33 1 42 68 53 00") == digits("+33142685300")


def test_long_runs_of_digits_end():
    for text in ("+" + "2" * 50_000, "+22" + " 1" * 50_000, "+44" + "-2" * 20_000 + "x", "DE89" + " 1111" * 20_000):
        Pseudonyms(KEY).apply(text)


def test_edge_rows(spark):
    data = table(spark)
    out = pseudonymised(data, KEY)
    assert out.columns == [*data.columns, "n_values"] and out.count() == len(rows())
    got = {r["text"]: r["n_values"] for r in out.collect()}
    assert got[None] == 0 and got[""] == 0 and max(got.values()) == 4
    restored = pseudonymised(out, KEY, back=True)
    assert sorted(map(str, (r["text"] for r in restored.collect()))) == sorted(map(str, (r[1] for r in rows())))
    assert pseudonymised(empty(spark), KEY).count() == 0
