"""Near-duplicate documents by circulant MinHash, banding, and exact Jaccard on the full shingle sets.

Two permutations make all coordinates of a signature: the first scatters the shingles, the second
is shifted by one place from coordinate to coordinate (C-MinHash). Equal shingle sets are one node.
Nodes that agree on a band meet in a bucket. Buckets are compared in blocks of bounded size, so that
a bucket may hold any share of the rows: in a block, signatures first tell which nodes have a
partner that may be similar enough, then those nodes' full sets are fetched and compared. A block
gives at most one link per node, since links within a component add nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieve.llm.components import components
from sieve.operators.spool import Spooled, lookup, spool

SHINGLE = 5
ROWS = 5  # coordinates per band
MISS = 1e-6  # probability that two sets just at the threshold agree on no band
SIGMAS = 6  # a pair is given up if its signatures agree this many standard deviations below the threshold
BLOCK = 256  # nodes of one bucket that are compared with as many others in one task
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def bands_for(percent: int) -> int:
    return ceil(log(MISS) / log(1 - (percent / 100) ** ROWS))


class Shingler:
    """Words to sets of 64-bit shingle hashes. The hashes of words are remembered, up to a limit."""

    def __init__(self, limit: int = 200_000):
        import xxhash

        self.hash, self.known, self.limit = xxhash.xxh3_64_intdigest, {}, limit

    def __call__(self, text: str) -> np.ndarray:
        """The sorted distinct hashes of all runs of five words; of the whole sequence if it is shorter."""
        words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six blanks only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.known) > self.limit:
            self.known.clear()
        known, new = self.known, self.hash
        codes = []
        for w in words:
            code = known.get(w)
            if code is None:
                code = known[w] = new(w)
            codes.append(code)
        h = np.array(codes, np.uint64)
        n = len(h) - SHINGLE + 1
        if n < 1:
            return np.array([self.hash(b" ".join(words)) ^ len(words)], np.uint64)
        s = h[:n] * _C[0]
        for i in range(1, SHINGLE):
            s += h[i : i + n] * _C[i]
        s ^= s >> np.uint64(29)
        return np.unique(s * np.uint64(0xBF58476D1CE4E5B9))


def signature(s: np.ndarray, size: int) -> np.ndarray:
    """Coordinate k is the minimum of pi(sigma(x) - k) over the set, with pi and sigma permutations of 32 bits."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)  # sigma
    out = np.full(size, 0xFFFFFFFF, np.uint32)
    shift = np.arange(size, dtype=np.uint32)[:, None]
    for i in range(0, len(x), 1024):
        h = x[None, i : i + 1024] - shift
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)  # pi
        np.minimum(out, h.min(axis=1), out=out)
    return out


def groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = list(zip(*[batch.column(k).to_pylist() for k in keys]))
        start = 0
        for i, key in enumerate(ids):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    m = len(sets)
    who = np.repeat(np.arange(m), [len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = times > 1
    number = np.cumsum(common) - 1
    keep = common[place]
    place, who = number[place[keep]], who[keep]
    out = np.zeros((m, m), np.float32)
    for low in range(0, int(common.sum()), 8192):
        here = (place >= low) & (place < low + 8192)
        part = np.zeros((m, 8192), np.float32)
        part[who[here], place[here] - low] = 1
        out += part @ part.T
    return out.astype(np.int64)


def _forest(pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The pairs that join what was apart."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _comparable(t: pa.Table, percent: int) -> np.ndarray:
    """Pairs (row, column) to compare in this block: sizes allow the threshold, and the two are rows
    of different blocks unless the group is a block with itself."""
    n = t.column("n").to_numpy().astype(np.int64)
    block = t.column("block").to_numpy()
    ok = 100 * np.minimum(n[:, None], n[None, :]) >= percent * np.maximum(n[:, None], n[None, :])
    if t.column("lo")[0] != t.column("hi")[0]:
        ok &= block[:, None] < block[None, :]
    return np.triu(ok, 1) if t.column("lo")[0] == t.column("hi")[0] else ok


def sketched(docs: DataFrame, percent: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, node, sig, bands) per row; node is null without words."""
    bands = bands_for(percent)
    size = bands * ROWS
    box: list[Shingler] = []

    @F.arrow_udf("struct<n: bigint, node: string, sig: binary, bands: array<bigint>>")
    def sketch(texts: pa.Array) -> pa.Array:
        import xxhash

        if not box:
            box.append(Shingler())
        rows = []
        for t in texts.to_pylist():
            s = box[0](t or "")
            if not len(s):
                rows.append((0, None, None, None))
                continue
            sig = signature(s, size)
            keys = [xxhash.xxh3_64_intdigest(sig[i * ROWS : (i + 1) * ROWS].tobytes(), seed=i) - 2**63 for i in range(bands)]
            # One byte of each coordinate is enough to tell how many agree; chance adds one in 256.
            rows.append((len(s), xxhash.xxh3_128_hexdigest(s.tobytes()), sig.astype(np.uint8).tobytes(), keys))
        kinds = (pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["n", "node", "sig", "bands"]
        )

    made = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), sketch(F.col(text)).alias("s"))
    return made.select("doc_id", "text_hash", F.col("s.n").alias("n_shingles"), "s.node", "s.sig", "s.bands")


def _in_blocks(nodes: DataFrame) -> DataFrame:
    """Nodes by bucket and pair of blocks: (bucket, lo, hi, block, node, n, sig, bands)."""
    short = F.xxhash64("node")  # two nodes that share it only meet in more buckets than they must
    placed = nodes.select(short.alias("id"), F.explode("bands").alias("bucket"))
    held = placed.groupBy("bucket").agg(F.count("*").alias("_size")).filter("_size > 1")
    # Most buckets hold one node; only the others' rows get their signatures back.
    kept = placed.join(held, "bucket").withColumn("_blocks", F.ceil(F.col("_size") / BLOCK).cast("int"))
    kept = kept.withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    paired = kept.select("bucket", "block", "id", other.alias("other")).select(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id"
    )
    return paired.join(nodes.select(short.alias("id"), "node", "n", "sig", "bands"), "id").drop("id")


def _by_group(df: DataFrame) -> DataFrame:
    return df.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def promising(nodes: DataFrame, percent: int) -> DataFrame:
    """(bucket, lo, hi, block, node, n): nodes with a partner in the group whose signature is near enough.

    A pair counts in the first band that its nodes agree on, and in no other.
    """
    size = bands_for(percent) * ROWS
    p = percent / 100
    least = size * p - SIGMAS * sqrt(size * p * (1 - p))

    def compare(batches):
        for t in groups(batches, ["bucket", "lo", "hi"]):
            ok = _comparable(t, percent)
            a, b = np.nonzero(ok)
            if not len(a):
                continue
            sig = np.stack([np.frombuffer(x, np.uint8) for x in t.column("sig").to_pylist()])
            near = np.zeros(len(sig), bool)
            bucket = t.column("bucket")[0].as_py()
            bands = np.array(t.column("bands").to_pylist(), np.int64)
            for i in range(0, len(a), 8192):
                x, y = a[i : i + 8192], b[i : i + 8192]
                enough = (sig[x] == sig[y]).sum(axis=1) >= least
                x, y = x[enough], y[enough]
                same = bands[x] == bands[y]
                first = bands[x, same.argmax(axis=1)] == bucket
                near[x[first]] = near[y[first]] = True
            if near.any():
                yield t.select(["bucket", "lo", "hi", "block", "node", "n"]).filter(pa.array(near)).combine_chunks().to_batches()[0]

    schema = "bucket bigint, lo int, hi int, block int, node string, n bigint"
    return _by_group(_in_blocks(nodes)).mapInArrow(compare, schema)


def shingle_sets(docs: DataFrame, wanted: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(node, items): the full sets of ``wanted`` (node, rep_id, rep_hash), as packed 64-bit hashes."""
    box: list[Shingler] = []

    @F.arrow_udf("binary")
    def full(texts: pa.Array) -> pa.Array:
        if not box:
            box.append(Shingler())
        return pa.array([box[0](t or "").tobytes() for t in texts.to_pylist()], pa.binary())

    slim = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    slim = slim.withColumn("rep_hash", F.xxhash64("_text"))
    # Shuffled at every size: what is wanted grows with the documents.
    found = slim.join(wanted.hint("merge"), (slim["rep_hash"] == wanted["rep_hash"]) & slim["_id"].eqNullSafe(wanted["rep_id"]))
    return found.select("node", full(F.col("_text")).alias("items"))


def linked(rows: DataFrame, percent: int) -> DataFrame:
    """(u, v): links among promising rows (with ``items``), as few as hold their groups together."""

    def confirm(batches):
        for t in groups(batches, ["bucket", "lo", "hi"]):
            sets = [np.frombuffer(x, np.uint64) for x in t.column("items").to_pylist()]
            ok = _comparable(t, percent)
            if not ok.any():
                continue
            n = np.array([len(s) for s in sets])
            inter = _shared(sets)
            ok &= 100 * inter >= percent * (n[:, None] + n[None, :] - inter)
            names = t.column("node").to_pylist()
            found = _forest(zip(*(x.tolist() for x in np.nonzero(ok))))
            if found:
                yield pa.RecordBatch.from_pydict({"u": [names[a] for a, _ in found], "v": [names[b] for _, b in found]})

    return _by_group(rows).mapInArrow(confirm, "u string, v string")


def _nodes_and_components(docs: DataFrame, percent: int, doc_id: str, text: str, best: bool = False) -> tuple[DataFrame, Spooled]:
    """The sketches of all rows, and (node, component_id, n_rows) for the nodes of components with several
    rows; with ``best`` also the id and text hash of the row that stands for the component."""
    base = spool(sketched(docs, percent, doc_id, text), "sketches").df
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    nodes = spool(
        base.filter("node is not null").groupBy("node").agg(
            F.min("doc_id").alias("least"), F.count("*").alias("n_rows"), F.min("n_shingles").alias("n"),
            F.min(F.struct(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))).alias("rep"),
            F.min_by("sig", "text_hash").alias("sig"), F.min_by("bands", "text_hash").alias("bands"),
            *([F.min(order).alias("best")] if best else []),
        ),
        "nodes",
    ).df
    near = spool(promising(nodes, percent), "promising").df
    wanted = near.select("node").distinct().join(nodes.select("node", "rep"), "node").select(
        "node", F.col("rep.id").alias("rep_id"), F.col("rep.hash").alias("rep_hash")
    )
    sets = shingle_sets(docs, wanted, doc_id, text).dropDuplicates(["node"])
    roots = components(linked(near.join(sets, "node"), percent))
    more = ["best"] if best else []
    grouped = nodes.select("node", "least", "n_rows", *more).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = grouped.groupBy("root").agg(
        F.min("least").alias("component_id"), F.sum("n_rows").alias("_n"), *[F.min(c).alias(c) for c in more]
    )
    dim = grouped.drop(*more).join(least.filter("_n > 1"), "root").select("node", "component_id", "n_rows", *more)
    return base, spool(dim, "components")


def clustered(docs: DataFrame, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept), one row per row of ``docs``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their sets of five-word
    shingles; component_id is the smallest doc_id that links reach. A null, empty or blank text has
    no shingles and is linked with nothing: its component is its own id. Rows that repeat an id are
    documents of their own; ``kept`` is true for all rows that hold the component's smallest id. A
    null id joins components but is never the smallest, and is kept only where all ids are null.
    """
    base, dim = _nodes_and_components(docs, percent, doc_id, text)
    out = lookup(base.select("doc_id", "text_hash", "n_shingles", "node"), dim, ["node"], "left", spread="doc_id", weight="n_rows")
    alone = F.col("n_rows").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def deduplicated(
    docs: DataFrame, percent: int = 80, doc_id: str = "doc_id", text: str = "text", single: bool = False
) -> DataFrame:
    """The rows of ``docs`` that stay: all ``kept`` rows, or with ``single`` exactly one row of each component.

    That row has the smallest id (a null one only if there is no other), then the smallest text hash,
    then the smallest hash over all columns. Rows without words are components of their own.
    """
    if single:
        base, dim = _nodes_and_components(docs, percent, doc_id, text, best=True)
        found = lookup(base.select("doc_id", "text_hash", "node"), dim, ["node"], "inner", spread="text_hash", weight="n_rows")
        stands = F.col("doc_id").eqNullSafe(F.col("best.id")) & (F.col("text_hash") == F.col("best.hash"))
        seen = found.groupBy(F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")).agg(
            F.count("*").alias("_times"), F.max(stands).alias("_stands")
        ).filter("not _stands or _times > 1")
        gone = spool(seen, "gone")
        repeated = spool(gone.df.filter("_stands").drop("_stands"), "repeated")
        gone = gone.df.select("_gone_id", "_gone_hash")
    else:
        gone = clustered(docs, percent, doc_id, text).filter("not kept").select(
            F.col("doc_id").alias("_gone_id"), F.col("text_hash").alias("_gone_hash")
        ).distinct()
        gone, repeated = spool(gone, "gone").df, None
    stay = docs.join(
        gone.hint("merge"), docs[doc_id].eqNullSafe(gone["_gone_id"]) & (F.xxhash64(docs[text]) == gone["_gone_hash"]), "left_anti"
    )
    if repeated is None or repeated.df.isEmpty():
        return stay
    rows = docs.withColumns({"_gone_id": F.col(doc_id), "_gone_hash": F.xxhash64(text), "_row": F.monotonically_increasing_id()})
    rows = lookup(rows, repeated, ["_gone_id", "_gone_hash"], "inner", spread="_row", weight="_times", null_safe=True)
    # Every task hands on one row per key at most, so copies are not gathered.
    one = rows.groupBy("_gone_id", "_gone_hash").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_one"))
    return stay.unionByName(one.select(*[F.col("_one")[c].alias(c) for c in docs.columns]))
