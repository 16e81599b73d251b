"""Format-preserving pseudonyms for personal data.

Validated values (payment cards, bank accounts, telephone and social security numbers, network and
mail addresses, dates) are replaced by other valid values of the same format. The replacement is a
keyed permutation of all values of the format, built on a Feistel network, so equal values get equal
pseudonyms in every document and different values different ones, and whoever has the key can go
back. No value is its own pseudonym.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Callable, Iterable
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8


class Feistel:
    """A keyed permutation of 0..n-1. ``turn`` sends every number to another one (for n > 1)."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.a = n, isqrt(max(n, 1) - 1) + 1
        self.b = -(-n // self.a)
        self.base = hashlib.blake2b(tweak.encode(), key=key, digest_size=32).digest()

    def _f(self, i: int, half: int) -> int:
        data = bytes([i]) + half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
        return int.from_bytes(hashlib.blake2b(data, key=self.base, digest_size=32).digest(), "big")

    def _pass(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            if i % 2 == 0:
                left = (left + (-1 if back else 1) * self._f(i, right)) % self.a
            else:
                right = (right + (-1 if back else 1) * self._f(i, left)) % self.b
        return left * self.b + right

    def _walk(self, x: int, back: bool) -> int:
        x = self._pass(x, back)
        while x >= self.n:
            x = self._pass(x, back)
        return x

    def turn(self, x: int, back: bool = False) -> int:
        """One step on a ring through all numbers whose order the key decides."""
        return self._walk((self._walk(x, False) + (-1 if back else 1)) % self.n, True)


def luhn_digit(payload: str) -> str:
    total = 0
    for i, d in enumerate(reversed(payload)):
        v = int(d) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return str(-total % 10)


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


_DAYS = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal())
_CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
            "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7), "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)]
_CLASS_OF = {c: k for k in _CLASSES for c in k}

_CARD = r"(?<![0-9A-Za-z])(?:\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|3\d{3}(?P<gap3>[ -])\d{6}(?P=gap3)\d{5})(?![0-9A-Za-z])"
_IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
_SSN = r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])"
_IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"
_DATE = (
    r"(?<![\w./-])(?:(?:19|20)\d\d-\d\d-\d\d|\d\d?/\d\d?/(?:19|20)\d\d|\d\d?\.\d\d?\.(?:19|20)\d\d)(?![\w-]|[./]\d)"
)
_GAP = "[ .  ‑-]"
# A number abroad ends where a blank and another kind of value follow.
_PHONE = (
    rf"(?<![\w+])(?:\+1{_GAP}?(?:\(\d{{3}}\)|\d{{3}}){_GAP}?\d{{3}}{_GAP}?\d{{4}}"
    rf"|\+(?!1)(?:\d{{2,3}}|7)(?:{_GAP}?\(\d{{1,4}}\))?{_GAP}?\d{{1,14}}"
    rf"(?:(?:[.‑-]|[   ](?!{_IP}|{_DATE}))\d{{1,14}}){{0,12}}"
    rf"|\(\d{{3}}\){_GAP}?\d{{3}}{_GAP}?\d{{4}}|\d{{3}}(?P<part>{_GAP})\d{{3}}(?P=part)\d{{4}})(?!\d)"
)
_NUMBERS = {k: re.compile(p, re.ASCII) for k, p in
            [("card", _CARD), ("phone", _PHONE), ("ssn", _SSN), ("ip", _IP), ("date", _DATE)]}
_START = re.compile(r"[0-9+(]")  # where one of them can begin; almost all of a text is passed over
_ACCOUNT = re.compile(_IBAN)
# Characters of an account number with country and check digits (ISO 13616).
_LENGTHS = {
    n: names.split() for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
}
_ACCOUNTS = {
    name: re.compile(rf"[A-Z]{{2}}\d{{2}}(?: ?[0-9A-Z]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[0-9A-Z]{{{n % 4}}}" if n % 4 else "") + "(?![0-9A-Za-z])")
    for n, names in _LENGTHS.items() for name in names
}
_NAME = re.compile(r"[\w.%+-]{1,65}\Z")
_HOST = re.compile(r"@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])")


def _ends(match: re.Match, gap: str) -> list[int]:
    """Where a match ends, and where it would without its last group, its last two and so on."""
    return [match.end(), *(match.start() + g.start() for g in reversed([*re.finditer(rf"(?<=[0-9A-Z]){gap}", match[0])]))]


class Pseudonyms:
    """Replaces values; ``back=True`` gives the originals again."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self._feistel: Callable[[str, int], Feistel] = lru_cache(4096)(lambda tweak, n: Feistel(key, tweak, n))
        self._replace = lru_cache(100_000)(self._new_value)

    def _digits(self, kind: str, digits: str) -> str:
        n = len(digits)
        return f"{self._feistel(f'{kind}:{n}', 10**n).turn(int(digits), self.back):0{n}d}" if n else digits

    def _symbols(self, kind: str, text: str) -> str:
        """Letters become letters of their class and digits digits; other characters stay."""
        classes = [_CLASS_OF.get(c) for c in text]
        n, x = 1, 0
        for c, k in zip(text, classes):
            if k:
                n, x = n * len(k), x * len(k) + k.index(c)
        if n == 1:
            return text
        shape = "".join(c if k is None else str(_CLASSES.index(k)) + "\0" for c, k in zip(text, classes))
        x, out = self._feistel(f"{kind}:{shape}", n).turn(x, self.back), []
        for c, k in zip(reversed(text), reversed(classes)):
            if k:
                x, i = divmod(x, len(k))
                c = k[i]
            out.append(c)
        return "".join(reversed(out))

    @staticmethod
    def _fill(form: str, digits: str) -> str:
        """``form`` with its digits replaced one by one."""
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in form)

    def _card(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
            return None
        new = self._digits("card", d[:-1])
        while len(set(new + luhn_digit(new))) == 1:  # a repeated digit would not count as a card
            new = self._digits("card", new)
        return self._fill(s, new + luhn_digit(new))

    def _iban(self, s: str) -> str | None:
        d = s.replace(" ", "")
        if not 15 <= len(d) <= 34 or int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97 != 1:
            return None
        account = self._symbols("iban:" + d[:2], d[4:])
        it = iter(d[:2] + _iban_check(d[:2], account) + account)
        return "".join(c if c == " " else next(it) for c in s)

    def _phone(self, s: str) -> str | None:
        d = re.sub(r"\D", "", s)
        if not 8 <= len(d) <= 15:
            return None
        code = 0 if s[0] != "+" else 1 if d[0] in "17" else 2
        return self._fill(s, d[:code] + self._digits(f"phone:{d[:code] or 1}", d[code:]))

    def _ssn(self, s: str) -> str:
        new = s
        while True:
            new = self._fill(s, self._digits("ssn", re.sub(r"\D", "", new)))
            if re.fullmatch(_SSN, new):
                return new

    def _ip(self, s: str) -> str | None:
        octets = s.split(".")
        if any(len(o) > 1 and o[0] == "0" for o in octets):
            return None
        x = self._feistel("ip", 2**32).turn(int.from_bytes(bytes(map(int, octets)), "big"), self.back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def _date(self, s: str) -> str | None:
        """Days 1900-2099. With slashes, the month comes first unless the first number is above 12; a
        number of one digit may become one of two."""
        gap = re.search(r"\D", s)[0]
        a, b, c = (p for p in s.split(gap))
        day_first = gap == "." or int(a) > 12
        y, m, d = (a, b, c) if gap == "-" else (c, b, a) if day_first else (c, a, b)
        try:
            day = datetime.date(int(y), int(m), int(d)).toordinal()
        except ValueError:
            return None
        ring = self._feistel("date", _DAYS[1] - _DAYS[0] + 1)
        while True:
            day = ring.turn(day - _DAYS[0], self.back) + _DAYS[0]
            new = datetime.date.fromordinal(day)
            if gap == "-":
                return new.isoformat()
            if gap == "/" and day_first and new.day <= 12:
                continue  # it would be read the other way round
            width = lambda v, p: f"{v:02d}" if len(p) == 2 else str(v)
            first, second = (new.day, new.month) if day_first else (new.month, new.day)
            return gap.join([width(first, a), width(second, b), f"{new.year}"])

    def _mail(self, s: str) -> str:
        name, host = s.rsplit("@", 1)
        return self._symbols("mail:" + host.lower(), name) + "@" + host

    def _new_value(self, kind: str, value: str) -> str | None:
        return getattr(self, f"_{kind}")(value)

    @staticmethod
    def _mails(text: str) -> list[tuple[int, int]]:
        """Where mail addresses lie: a name of at most 64 characters, @ and a host."""
        spans, at = [], text.find("@")
        while at >= 0:
            end = spans[-1][1] if spans else 0
            name, host = _NAME.search(text, max(end, at - 65), at), _HOST.match(text, at)
            if name and host and len(name[0]) <= 64:
                spans.append((name.start(), host.end()))
            at = text.find("@", at + 1)
        return spans

    def _card_at(self, text: str, at: int) -> bool:
        v = _NUMBERS["card"].match(text, at)
        return v is not None and self._replace("card", v[0]) is not None

    def _longest(self, kind: str, text: str, at: int, ends: Iterable[int], end: int) -> tuple[int, int, str] | None:
        """The first of ``ends`` up to ``end`` at which a value that begins at ``at`` is valid."""
        for stop in ends:
            if stop <= end and (new := self._replace(kind, text[at:stop])) is not None:
                return at, stop, new
        return None

    def _numbers(self, text: str, at: int, end: int) -> tuple[int, int, str] | None:
        """The first value in [at, end): where it begins and ends, and its pseudonym."""
        low = at
        while (m := _START.search(text, at, end)) is not None:
            at = m.start()
            if at >= low + 2 and text[at - 2 : at].isupper() and (v := _ACCOUNT.match(text, at - 2)):
                own = _ACCOUNTS.get(text[at - 2 : at])
                first = own.match(text, at - 2) if own else None
                ends = [first.end()] if first else []
                if found := self._longest("iban", text, at - 2, [*ends, *_ends(v, " ")], end):
                    return found
            for kind, pattern in _NUMBERS.items():
                if v := pattern.match(text, at):
                    ends = [v.end()]
                    if kind == "phone":  # a card that follows is no part of the number
                        ends = sorted(_ends(v, _GAP), key=lambda stop: not self._card_at(text, stop + 1))
                    if found := self._longest(kind, text, at, ends, end):
                        return found
            at += 1
        return None

    def apply(self, text: str) -> tuple[str, int]:
        """The text with every value replaced, and their number."""
        out, at, found = [], 0, 0
        for start, end in [*(self._mails(text) if "@" in text else ()), (len(text), len(text))]:
            while (value := self._numbers(text, at, start)) is not None:
                out += text[at : value[0]], value[2]
                at, found = value[1], found + 1
            out.append(text[at:start])
            if start < end:
                out.append(self._replace("mail", text[start:end]))
                found += 1
            at = end
        return "".join(out) if found else text, found


def pseudonymised(
    df: DataFrame, key: bytes, text: str = "text", count: str = "n_values", back: bool = False
) -> DataFrame:
    """``df`` with ``text`` pseudonymised and ``count``, the number of values replaced.

    A null text stays null and has no values; a text without values stays as it is, to the byte. An
    input column named ``count`` is replaced. ``back=True`` with the same key restores the texts.
    """
    box: list[Pseudonyms] = []

    @F.arrow_udf("struct<text: string, n: int>")
    def run(texts: pa.Array) -> pa.Array:
        if not box:
            box.append(Pseudonyms(key, back))
        done = [(None, 0) if t is None else box[0].apply(t) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [pa.array([t for t, _ in done], pa.string()), pa.array([n for _, n in done], pa.int32())], ["text", "n"]
        )

    made = "_" * (max(map(len, df.columns)) + 1) + "made"
    out = df.withColumn(made, run(F.col(text)))
    return out.withColumn(text, F.col(f"{made}.text")).withColumn(count, F.col(f"{made}.n")).drop(made)
