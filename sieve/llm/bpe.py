"""Byte-level BPE by backtracking over longest matches.

The vocabulary's byte strings are mapped to Latin-1 and put into an Aho-Corasick automaton. A piece
of text is encoded from left to right: the longest vocabulary entry at the current place is tried
first, then its ever shorter prefixes, and when none fits the last token is taken back. A token fits
if merging could have left it next to the token before it, which is found by undoing both tokens'
merges; that answer depends on the two tokens only and is remembered. A place given up once is
never tried again, so the work is linear in the length of the piece, and the result is the one the
merges give.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieve.llm.common import free_name, text_or_empty

# White space as the tokenizer's pattern understands it: Unicode's property, which is not Python's \s.
_WS = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# White space splits alike for every piece: a run of other characters takes one blank in front.
_CHUNKS = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")

REMEMBERED = 200_000  # pieces and pairs of tokens that a worker remembers at least
CACHED_CHARS = 64  # longer chunks are encoded each time


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token's bytes and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Memory:
    """The latest entries, and those found among them again: between ``size`` and twice as many."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key: str) -> bytes | None:
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key: str, value: bytes) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Coder:
    """Encoder and decoder for one vocabulary; built once per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.size_of = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for i, b in self.bytes_of.items():
            self.size_of[i] = len(b)
        self.start_of = np.cumsum(self.size_of) - self.size_of
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(len(self.size_of))), np.uint8)
        self.words = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.words.add_word(token.decode("latin-1"), rank)
        self.words.make_automaton()
        self.lengths = {i: len(b) for i, b in self.bytes_of.items()}
        self.shorter = {i: self._longest_prefix(b) for i, b in self.bytes_of.items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.fits: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._take_apart(token, rank)
        own_space = pattern.replace(r"[^\s", f"[^{_WS}").replace(r"\S", f"[^{_WS}]").replace(r"\s", f"[{_WS}]")
        self.pieces = regex.compile(own_space)
        self.pieces_seen, self.chunks_seen = Memory(REMEMBERED), Memory(REMEMBERED // 2)

    def _longest_prefix(self, token: bytes) -> int | None:
        for end in range(len(token) - 1, 0, -1):
            if (rank := self.ranks.get(token[:end])) is not None:
                return rank
        return None

    def _take_apart(self, token: bytes, rank: int) -> None:
        """Find the two tokens whose merge gives ``token``: the pair that may stand side by side."""
        if len(token) > 1:
            for cut in range(len(token) - 1, 0, -1):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None and max(left, right) < rank and self._may_meet(left, right):
                    self.parts[rank], self.joined[left, right] = (left, right), rank
                    return
        self.parts[rank] = (rank, rank)

    def _may_meet(self, left: int, right: int) -> bool:
        """Would merging leave these two tokens next to each other? Undo the later merge and look
        whether the two tokens now at the border would have been merged before it."""
        limit = 1 << 62
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < limit:
                return False
            if left > right:
                limit, last = left, self.parts[left][1]
                if last != left:
                    left = last
                    continue
                limit, first = right + 1, self.parts[right][0]
                if first == right:
                    return True
                right = first
            else:
                limit, first = right + 1, self.parts[right][0]
                if first != right:
                    right = first
                    continue
                limit, last = left, self.parts[left][1]
                if last == left:
                    return True
                left = last

    def _fit(self, left: int, right: int) -> bool:
        fits = self.fits
        if len(fits) >= REMEMBERED:
            fits.clear()
        fit = fits[left << 32 | right] = self._may_meet(left, right)
        return fit

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens that the merges leave of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text, longest, lengths, fits = piece.decode("latin-1"), self.words.iter_long, self.lengths, self.fits.get
        # Take longest matches one after the other as long as they fit.
        matches = longest(text)
        last = next(matches)[1]
        out = [last]
        for end, token in matches:
            fit = fits(last << 32 | token)
            if fit is None:
                fit = self._fit(last, token)
            if not fit:
                break
            out.append(token)
            last = token
        else:
            return out
        # Search on from the first that does not.
        size, shorter, dead = len(piece), self.shorter, set()
        at = end + 1 - lengths[token]
        token = shorter[token]
        while True:
            while token is not None:
                end = at + lengths[token]
                if end not in dead:
                    if not out:
                        break
                    fit = fits(out[-1] << 32 | token)
                    if fit is None:
                        fit = self._fit(out[-1], token)
                    if fit:
                        break
                token = shorter[token]
            if token is None:  # nothing fits here: take the last token back and try a shorter one
                dead.add(at)
                token = out.pop()
                at -= lengths[token]
                token = shorter[token]
                continue
            out.append(token)
            at = end
            if at == size:
                return out
            token = next(longest(text, at))[1]

    def _piece(self, piece: str) -> bytes:
        """A piece's ids as packed integers."""
        ids = self.pieces_seen.get(piece)
        if ids is None:
            ids = array("i", self.encode_piece(piece.encode())).tobytes()
            if len(piece) <= CACHED_CHARS:
                self.pieces_seen.put(piece, ids)
        return ids

    def _chunk(self, chunk: str) -> bytes:
        """A chunk's ids: that of its pieces, one after the other."""
        # Latin letters alone, with or without a blank in front, are one piece.
        if chunk.isascii() and chunk.lstrip(" ").isalpha():
            return self._piece(chunk)
        ids = self.chunks_seen.get(chunk)
        if ids is None:
            ids = b"".join([self._piece(piece) for piece in self.pieces.findall(chunk)])
            if len(chunk) <= CACHED_CHARS:
                self.chunks_seen.put(chunk, ids)
        return ids

    def packed(self, text: str) -> bytes:
        """The ids of a whole text as packed 32-bit integers."""
        pieces, chunks, slow = self.pieces_seen.young.get, self.chunks_seen.young.get, self._chunk
        return b"".join([pieces(chunk) or chunks(chunk) or slow(chunk) for chunk in _CHUNKS.findall(text)])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode_all(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes begin (and the last one's end)."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size_of) or not self.size_of[ids].all()):
            raise KeyError("an id is not in the vocabulary")
        sizes = self.size_of[ids]
        places = np.concatenate([[0], np.cumsum(sizes)])
        return self.all_bytes[np.repeat(self.start_of[ids] - places[:-1], sizes) + np.arange(places[-1])].tobytes(), places

    def decode(self, ids: Iterable[int]) -> bytes:
        return self.decode_all(np.array(list(ids), np.int64))[0]


_coders: dict[object, Coder] = {}


def coder(key: object, ranks: dict[bytes, int], pattern: str) -> Coder:
    """One coder per vocabulary and Python worker."""
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(ranks, pattern)
    return _coders[key]


class Vocabulary:
    """A rank file read by the driver and broadcast: its size is fixed and does not grow with the data."""

    def __init__(self, spark: SparkSession, path: str, pattern: str):
        self.key = path
        self.shared = spark.sparkContext.broadcast((load_ranks(path), pattern))

    def coder(self) -> Coder:
        return coder(self.key, *self.shared.value)


def encoded(df: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds ``out``, the token ids of each whole text; a null text has none, like an empty one.

    No special tokens. An input column named ``out`` is replaced.
    """

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        c = vocabulary.coder()
        packed = [c.packed(t) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, packed)], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(packed), np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))

    return df.withColumn(out, encode(text_or_empty(text)))


def decoded(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "bytes") -> DataFrame:
    """Adds ``out``, the bytes that the token ids stand for; null ids give null, an unknown id raises KeyError."""

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        c = vocabulary.coder()
        ends = np.cumsum([0, *(n or 0 for n in pc.list_value_length(lists).to_pylist())])
        raw, places = c.decode_all(lists.flatten().to_numpy())
        bounds = places[ends]
        none = lists.is_null().to_pylist()
        return pa.array([None if x else raw[a:b] for x, a, b in zip(none, bounds[:-1], bounds[1:])], pa.binary())

    return df.withColumn(out, decode(F.col(ids)))


def round_trip(df: DataFrame, vocabulary: Vocabulary, text: str = "text", keep: Iterable[str] = ()) -> DataFrame:
    """``keep`` with n_tokens, and digests of the ids and of the bytes decoded from them."""
    ids, raw = free_name(df, "_ids"), free_name(df, "_bytes")
    done = decoded(encoded(df, vocabulary, text, ids), vocabulary, ids, raw)
    return done.select(
        *keep,
        F.size(ids).cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(raw), 256).alias("decoded_sha256"),
    )
