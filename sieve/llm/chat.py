"""Chat formatting by columnar byte assembly, with a loss mask, and its way back.

A batch of turns becomes one buffer: the lengths of all segments (marks, role, text) give running
offsets, the offsets give scatter indices, and marks and contents are copied to their places in a
preallocated Arrow buffer whose cuts are the formatted strings. No turn is handled by itself.

Control strings inside roles and texts are escaped: a backslash goes behind the first character of each,
and one more behind a first character that backslashes already follow, so that taking one away again
restores every text. What stands between the marks therefore never holds a control string.

A conversation is a list of turns by ``turn``; turns that tie follow each other by role and then by the
md5 of the text, turns that repeat stay. A null role or text is an empty one, a null turn comes first, a
null conversation is one conversation. Conversations of more than ``PART_TURNS`` turns or ``PART_BYTES``
bytes come in several rows, parts, whose concatenation by ``part`` is the whole: no task holds a long
conversation, and its turns are sorted in many tasks. An empty table gives no rows. Columns other than the four named are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.operators.spool import lookup

PART_TURNS = 256
PART_BYTES = 1 << 18
SLICE_BYTES = 1 << 22  # assembled at once; a single longer text is copied by itself
LONG_TEXT = 1 << 14  # bytes from which a segment is copied as a block

# Marks of widely used chat templates (fixed values). All of them are escaped in texts.
KNOWN_MARKS = (
    "<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
    "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>",
)


@dataclass(frozen=True)
class Template:
    """``opens`` role ``parts`` text ``closes``; the text of the roles in ``learned`` is under the loss mask."""

    opens: str = "<|im_start|>"
    parts: str = "<|im_sep|>"
    closes: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)
    marks: tuple[str, ...] = field(default=KNOWN_MARKS)

    def __post_init__(self):
        every = self.escapable
        if any(len(c) < 2 or "\\" in c for c in every):
            raise ValueError("a control string has two or more characters and no backslash")
        for a in every:
            for b in every:
                # Otherwise two of them could overlap in a text, and escaping one could hide the other.
                if any(b.startswith(a[i:]) or a[i:].startswith(b) for i in range(1, len(a))):
                    raise ValueError(f"control strings overlap: {a!r} and {b!r}")

    @property
    def controls(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.opens, self.parts, self.closes, *self.marks)))

    @property
    def escapable(self) -> set[str]:
        """What the pattern takes for a control string: any first character before any rest."""
        return {c[0] + d[1:] for c in self.controls for d in self.controls}

    @property
    def escaping(self) -> tuple[str, str]:
        """Pattern and replacement that escape; RE2, Java and Python read them alike."""
        return self._pattern(r"(\\*)"), r"\1\\\2\3"

    @property
    def unescaping(self) -> str:
        return self._pattern(r"\\(\\*)")

    def _pattern(self, between: str) -> str:
        """A first character, ``between`` and the rest of a control string, as three groups."""
        firsts = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rests = sorted({c[1:] for c in self.controls}, key=lambda c: (-len(c), c))
        return f"([{firsts}]){between}({'|'.join(map(re.escape, rests))})"

    def escaped(self, texts: pa.Array) -> pa.Array:
        pattern, by = self.escaping
        return pc.replace_substring_regex(texts, pattern, by)

    def unescaped(self, text: str) -> str:
        return re.sub(self.unescaping, r"\1\2\3", text) if "\\" in text else text


def assemble(segments: list[bytes | tuple[np.ndarray, np.ndarray]], n: int) -> tuple[pa.Buffer, np.ndarray]:
    """``n`` rows, each the concatenation of its segments, in one buffer, and where each row begins.

    A segment is a constant or a column: all its bytes and the n + 1 offsets of its rows.
    """
    lengths = np.empty((n, len(segments)), np.int64)
    for k, s in enumerate(segments):
        lengths[:, k] = len(s) if isinstance(s, bytes) else np.diff(s[1])
    ends = np.cumsum(lengths.ravel()).reshape(lengths.shape)
    starts = ends - lengths
    total = int(ends[-1, -1]) if n else 0
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for k, s in enumerate(segments):
        if isinstance(s, bytes):
            out[starts[:, k, None] + np.arange(len(s))] = np.frombuffer(s, np.uint8)
            continue
        source, offsets = s
        size = lengths[:, k]
        short = np.flatnonzero((size > 0) & (size < LONG_TEXT))
        if len(short):
            run = size[short]
            within = np.arange(run.sum()) - np.repeat(np.cumsum(run) - run, run)
            out[np.repeat(starts[short, k], run) + within] = source[np.repeat(offsets[short], run) + within]
        for i in np.flatnonzero(size >= LONG_TEXT):
            out[starts[i, k] : ends[i, k]] = source[offsets[i] : offsets[i + 1]]
    return buffer, np.append(starts[:, 0], total) if n else np.zeros(1, np.int64)


def _column(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow array of strings without nulls."""
    strings = strings.cast(pa.large_string())
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


PARTS = "part bigint, whole boolean, n_turns bigint, formatted string, loss array<struct<begin: bigint, end: bigint>>"


class _Formatter:
    """Turns in order (conv_id, role, text, long), cut into parts. Holds the turns of a conversation that may go on."""

    def __init__(self, template: Template):
        self.template, self.held, self.number = template, None, 0
        self.task = TaskContext.get().partitionId()  # range partitions are numbered in order

    def add(self, turns: pa.Table, last: bool = False) -> Iterator[pa.RecordBatch]:
        t = turns if self.held is None else pa.concat_tables([self.held, turns])
        self.held = None
        if not t.num_rows:
            return
        ids = t["conv_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        size = pc.add(pc.binary_length(t["text"]), pc.binary_length(t["role"])).to_numpy().astype(np.int64)
        before = np.append(0, np.cumsum(size))
        tail = int(starts[-1])
        if not last and len(t) - tail <= PART_TURNS and before[-1] - before[tail] <= PART_BYTES:
            self.held, t, starts = t.slice(tail), t.slice(0, tail), starts[:-1]
        rows = np.arange(len(t))
        first = starts[np.searchsorted(starts, rows, "right") - 1] if len(t) else rows
        # A long conversation is also cut where a part is full.
        full = ((rows - first) // PART_TURNS + (before[rows] - before[first]) // PART_BYTES) * t["long"].to_numpy()
        cuts = np.flatnonzero((rows == first) | np.append(False, full[1:] != full[:-1]))
        ends = np.append(cuts[1:], len(t))
        begin = 0
        while begin < len(cuts):  # as many parts as fit in a slice
            room = int(np.searchsorted(before[ends], before[cuts[begin]] + SLICE_BYTES, "right"))
            end = max(room, begin + 1)
            here = slice(cuts[begin], ends[end - 1])
            yield self.parts(t[here].combine_chunks(), cuts[begin:end] - cuts[begin])
            begin = end

    def parts(self, t: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        """One row per part; parts begin at the rows ``cuts``."""
        plan, n = self.template, len(t)
        role, text = (plan.escaped(t[c].combine_chunks()) for c in ("role", "text"))
        marks = [m.encode() for m in (plan.opens, plan.parts, plan.closes)]
        buffer, at = assemble([marks[0], _column(role), marks[1], _column(text), marks[2]], n)
        bounds = np.append(cuts, n)
        offsets = pa.py_buffer(at[bounds].astype(np.int32))
        formatted = pa.StringArray.from_buffers(len(cuts), offsets, buffer)
        # The mask counts code points from the beginning of the part.
        chars_role, chars_text = (pc.utf8_length(c).to_numpy().astype(np.int64) for c in (role, text))
        chars = np.append(0, np.cumsum(chars_role + chars_text + sum(len(m) for m in (plan.opens, plan.parts, plan.closes))))
        of = np.searchsorted(cuts, np.arange(n), "right") - 1
        stop = chars[1:] - len(plan.closes) - chars[cuts[of]]
        learned = np.flatnonzero(pc.is_in(t["role"].combine_chunks(), pa.array(plan.learned)).to_numpy(zero_copy_only=False))
        spans = pa.StructArray.from_arrays([pa.array((stop - chars_text)[learned]), pa.array(stop[learned])], ["begin", "end"])
        loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(learned, bounds), pa.int32()), spans)
        number = (self.task << 40) + self.number + np.arange(len(cuts))
        self.number += len(cuts)
        whole = pc.invert(t["long"].combine_chunks().take(pa.array(cuts)))
        return pa.RecordBatch.from_arrays(
            [t["conv_id"].combine_chunks().take(pa.array(cuts)), pa.array(number), whole, pa.array(np.diff(bounds)), formatted, loss],
            names=["conv_id", "part", "whole", "n_turns", "formatted", "loss"],
        )


def formatted(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as rows (conv_id, part, whole, n_turns, formatted, loss).

    ``part`` rises within a conversation, ``whole`` says that the row is all of it, ``loss`` has the code points
    of ``formatted`` under the loss mask as [begin, end). One shuffle of the turns; only conversations that are
    too long for one part may lie in several tasks.
    """
    template = template or Template()
    empty = F.lit("")
    slim = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    bytes_of = F.sum(F.octet_length("text") + F.octet_length("role"))
    sizes = slim.groupBy("conv_id").agg(F.count("*").alias("n"), bytes_of.alias("bytes"))
    long = sizes.filter((F.col("n") > PART_TURNS) | (F.col("bytes") > PART_BYTES)).select("conv_id", F.lit(True).alias("_long"))
    slim = slim.withColumn("_md5", F.md5(F.col("text").cast("binary"))).withColumn("_from", F.spark_partition_id())
    marked = lookup(slim, long, ["conv_id"], "left", spread="_md5", null_safe=True)
    # Where a conversation may be cut: nowhere, unless it is long; repeated rows of a long one are apart by their origin.
    place = [F.when(F.col("_long"), F.col(c)) for c in ("turn", "role", "_md5", "_from")]
    spread = marked.repartitionByRange("conv_id", *place)
    ordered = spread.sortWithinPartitions("conv_id", "turn", "role", "_md5", "_from").select(
        "conv_id", "role", "text", F.coalesce("_long", F.lit(False)).alias("long")
    )
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Formatter(template)
        for batch in batches:
            yield from made.add(pa.Table.from_batches([batch]))
        if made.held is not None:
            yield from made.add(made.held.slice(0, 0), last=True)

    return ordered.mapInArrow(run, f"conv_id {kind}, {PARTS}")


def read_turns(text: str, template: Template) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted string, unescaped."""
    pieces = text.split(template.closes)
    if pieces.pop():
        raise ValueError("a formatted string ends with the mark that closes a turn")
    out = []
    for piece in pieces:
        head, role_text = piece[: len(template.opens)], piece[len(template.opens) :]
        role, mark, body = role_text.partition(template.parts)
        if head != template.opens or not mark:
            raise ValueError("a turn lacks its marks")
        out.append((template.unescaped(role), template.unescaped(body)))
    return out


def digests(parts: DataFrame, template: Template | None = None) -> DataFrame:
    """What a reader of ``formatted`` gets back, one row per conversation: conv_id, n_turns, turns_sha256 (role, newline,
    text, newline for each turn), loss_chars, loss_sha256 (unescaped text under the mask), formatted_chars.

    A conversation in one part is digested where it lies. Of the others, the bytes to digest go by part to one stream
    each, because a digest of a whole depends on every byte before; a stream holds one part at a time.
    """
    template = template or Template()
    kind = parts.schema["conv_id"].dataType.simpleString()
    counts = "n_turns bigint, loss_chars bigint, formatted_chars bigint"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for whole, text, spans in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("whole", "formatted", "loss"))):
                turns = read_turns(text, template)
                said = "".join(f"{r}\n{t}\n" for r, t in turns).encode()
                learned = "".join(template.unescaped(text[s["begin"] : s["end"]]) for s in spans)
                loss = learned.encode()
                rows.append((len(turns), len(learned), len(text), hashlib.sha256(said).hexdigest() if whole else None,
                             hashlib.sha256(loss).hexdigest() if whole else None, None if whole else said, None if whole else loss))
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.binary()] * 2
            names = ["n_turns", "loss_chars", "formatted_chars", "turns_sha256", "loss_sha256", "said", "learned"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("conv_id")), batch.column(batch.schema.get_field_index("part")),
                 *[pa.array(c, t) for c, t in zip(columns, types)]], names=["conv_id", "part", *names])

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        going: list | None = None  # the conversation in several parts that is being read

        def ended() -> list[tuple]:
            return [tuple(v.hexdigest() if hasattr(v, "hexdigest") else v for v in going)] if going else []

        for batch in batches:
            types = [batch.schema.field(c).type for c in names]
            done = []
            for r in batch.to_pylist():
                if r["turns_sha256"] is not None:
                    done.append(tuple(r[c] for c in names))
                    continue
                if going is None or going[0] != r["conv_id"]:
                    done += ended()
                    going = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                going[1] += r["n_turns"]
                going[2].update(r["said"])
                going[3] += r["loss_chars"]
                going[4].update(r["learned"])
                going[5] += r["formatted_chars"]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=names)
        if going is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(ended()[0], types)], names=names)

    pieces = parts.mapInArrow(read, f"conv_id {kind}, part bigint, {counts}, turns_sha256 string, loss_sha256 string, said binary, learned binary")
    together = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return together.mapInArrow(
        chain, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
