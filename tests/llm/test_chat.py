"""Op 12."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sieve.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, part int, whole string, _long int, long int"
TEMPLATE = chat.Template()
pieces = st.lists(st.sampled_from([*chat.KNOWN_MARKS, "\\", "\\\\", "<", "[", "</", "s>", "INST]", "|im_end|>", "é", "漢", "\U0001f600", " ", "\n", "a", "\x00"]))
texts = pieces.map("".join)


@given(texts)
@settings(max_examples=400, deadline=None)
def test_escaping_is_reversible_and_hides_every_mark(text):
    escaped = TEMPLATE.escaped(pa.array([text]))[0].as_py()
    assert TEMPLATE.unescaped(escaped) == text and not any(c in escaped for c in TEMPLATE.controls)


@given(st.lists(st.tuples(texts, texts), max_size=6))
@settings(max_examples=100, deadline=None)
def test_assembled_bytes(turns):
    roles, said = ([*t] for t in zip(*turns)) if turns else ([], [])
    columns = [chat._column(pa.array(c, pa.string())) for c in (roles, said)]
    buffer, at = chat.assemble([b"<", columns[0], b"|", columns[1], b">>"], len(turns))
    want = [f"<{r}|{t}>>".encode() for r, t in turns]
    assert buffer.to_pybytes() == b"".join(want) and np.diff(at).tolist() == [len(w) for w in want]


def test_long_segments_are_copied_whole():
    said = ["x" * (chat.LONG_TEXT + 3), "", "é" * chat.LONG_TEXT, "b"]
    buffer, _ = chat.assemble([chat._column(pa.array(said)), b"."], 4)
    assert buffer.to_pybytes() == b"".join(s.encode() + b"." for s in said)


def test_overlapping_marks_are_refused():
    for marks in (("<a", "a<"), ("ab", "ba"), ("<\\>",), ("x",)):
        with pytest.raises(ValueError):
            chat.Template(marks=marks)


def brute(rows):
    out = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.md5((r[3] or "").encode()).hexdigest())
    for conv, turn, role, text in sorted(rows, key=key):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    escaped = lambda s: len(TEMPLATE.escaped(pa.array([s]))[0].as_py())
    found = []
    for conv, turns in out.items():
        said, learned = "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant")
        marks = len(TEMPLATE.opens) + len(TEMPLATE.parts) + len(TEMPLATE.closes)
        found.append((conv, len(turns), sha(said), len(learned), sha(learned), sum(escaped(r) + escaped(t) + marks for r, t in turns)))
    return sorted(found, key=str)


def data():
    roles = ["user", "assistant", "system", None, "a\nb <|im_sep|>"]
    rows = [(c, t, roles[(c + t) % 5], f"turn {t} é</s>\\ <|im_end|>" * (c % 4)) for c in range(40) for t in range(c % 7)]
    rows += [(100, t, roles[t % 2], f"{t} [INST]") for t in range(3 * chat.PART_TURNS + 5)]  # long by turns
    rows += [(101, t, roles[t % 2], "long 漢 " * 40_000) for t in range(5)]  # long by bytes
    rows += [(102, 0, "assistant", "same")] * 700 + [(103, 1, "assistant", t) for t in ("b", "a", "b", None)]
    rows += [(None, None, None, None), (None, 1, "user", "nobody"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    return rows


def test_conversations_against_brute_force(spark):
    rows = data()
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA).repartition(7)
    parts = chat.formatted(df)
    assert sorted([tuple(r) for r in chat.digests(parts).collect()], key=str) == brute(rows)
    found = parts.collect()
    long = {r["conv_id"] for r in found if not r["whole"]}
    assert long == {100, 101, 102} and all(r["n_turns"] <= chat.PART_TURNS for r in found)
    own = [r for r in found if r["conv_id"] == -1]
    assert len(own) == 1 and own[0]["formatted"] == (
        "<|im_start|>user<|im_sep|><\\/s>[\\INST] ok [\\/INST]<|im_end|><|im_start|>assistant<|im_sep|><\\/s>[\\INST] ok [\\/INST]<|im_end|>")
    assert [own[0]["formatted"][s["begin"] : s["end"]] for s in own[0]["loss"]] == ["<\\/s>[\\INST] ok [\\/INST]"]


def test_small_slices_and_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE_BYTES", 64)
    rows = [r for r in data() if r[0] is not None and r[0] < 40]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in rows], SCHEMA)
    assert sorted([tuple(r) for r in chat.digests(chat.formatted(df)).collect()], key=str) == brute(rows)


def test_nothing(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], SCHEMA))).collect() == []
