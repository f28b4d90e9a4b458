"""SimHash near-duplicates: a binary trie of fingerprints joined with itself.

A fingerprint has 64 majority bits over the hashes of a text's word shingles. Equal fingerprints are
one class from the start, so copies cost one row however many there are. Two fingerprints within
``bits`` differing bits agree in at least one of ``bits + 1`` blocks of their bits; a bucket holds
the fingerprints that agree in a block. A bucket of more than ``BUCKET`` fingerprints is split again
by blocks of the bits that vary in it, by the same argument, until every bucket is small: no pair is
lost and no task holds an unbounded group.

Within the buckets of a task, the trie is joined with itself: pairs of nodes go down one bit at a
time, a pair of unlike children counts one differing bit, and pairs beyond the budget are dropped.
Of the links of a bucket only a spanning forest leaves the task, which has the same components.

Cases: null, empty and blank texts have fingerprint 0 and are linked like any other; a text of
fewer words than a shingle is one shingle; repeated rows share a fingerprint; a null id never is a
component's id unless no other exists; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.components import components
from cohortloom.sources.stages import StageArea

BUCKET = 2_000  # fingerprints of a bucket that one task joins
PAIRS = 4_000_000  # pairs of fingerprints a task looks at together, at most
LEAF = 32  # node pairs of so few pairs of fingerprints are compared at once


def fingerprint(text: str | None, words: int, seed: int = 42) -> int:
    """64 bits as a signed number; a bit is set if over half of the shingle hashes have it."""
    parts = (text or "").encode().lower().split()  # A-Z only; space and \x09-\x0D
    if not parts:
        return 0
    line = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[:-1]]
    size = min(words, len(parts))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a : b - 1], seed) for a, b in zip(starts, ends[size - 1 :], strict=False)]
    count = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = np.array(hashes[at : at + (1 << 16)], dtype=np.uint64)
        count += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    value = np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0]
    return int(value.astype(np.int64))


def fingerprints(df: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp) of every row."""
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType), T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x, words) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["key", "fp"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def near_duplicates(
    df: DataFrame, words: int, bits: int, area: StageArea, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, fp, component): the smallest key among the rows reachable over links of ``bits`` bits."""
    docs = area.save(fingerprints(df, words, text, key), "fingerprints")
    classes = area.save(docs.groupBy("fp").agg(F.min(key).alias("first")), "classes")
    found = components(links(classes, bits, area), area)
    joined = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    rooted = area.save(joined, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = area.save(rooted.join(least, "root").select("fp", "component"), "components")
    return docs.join(named, "fp", "left").select(key, "fp", "component")


def links(classes: DataFrame, bits: int, area: StageArea) -> DataFrame:
    """(u, v): links of distinct fingerprints with the same components as all links."""
    masks = F.array(*(F.lit(m).cast("long") for m in _blocks(-1, bits + 1)))
    rows, parts = _keyed(classes.select("fp", F.explode(masks).alias("mask"))), []
    while True:
        rows = area.save(rows, "keys")
        varying = F.bit_or("fp").bitwiseXOR(F.bit_and("fp")).alias("varying")
        sizes = rows.groupBy("mask", "key").agg(F.count("*").alias("n"), varying)
        # Fingerprints that vary in no more bits than the budget are few, and all linked.
        large = area.save(sizes.where((F.col("n") > BUCKET) & (F.bit_count("varying") > bits)), "large")
        if large.isEmpty():
            parts.append(area.save(_joined(rows, bits), "links"))
            break
        parts.append(area.save(_joined(rows.join(large, ["mask", "key"], "left_anti"), bits), "links"))
        rows = _deeper(rows, large, bits + 1)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.distinct()


def _blocks(varying: int, blocks: int) -> list[int]:
    """The bits set in a signed number, dealt to blocks."""
    places = [i for i in range(64) if varying >> i & 1]
    values = [sum(1 << int(i) for i in c) for c in np.array_split(np.array(places, dtype=int), blocks)]
    return [v - (1 << 64) if v >> 63 else v for v in values]


def _keyed(rows: DataFrame) -> DataFrame:
    """The bits that a bucket shares: those of its mask."""
    return rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")


def _deeper(rows: DataFrame, large: DataFrame, blocks: int) -> DataFrame:
    """The rows of large buckets under longer keys: a block more of the bits that vary in them."""

    def run(batches):
        for batch in batches:
            found = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            out = [(m, k, m | block) for m, k, v in found for block in _blocks(v, blocks)]
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["mask", "key", "next"])

    paths = large.select("mask", "key", "varying").mapInArrow(run, "mask long, key long, next long")
    return _keyed(rows.join(paths, ["mask", "key"]).select("fp", F.col("next").alias("mask")))


def _joined(rows: DataFrame, bits: int) -> DataFrame:
    dealt = rows.repartition("mask", "key").sortWithinPartitions("mask", "key", "fp")

    def run(batches):
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)]))
            if sum(x.shape[1] for x in held) >= 20_000:
                table = np.concatenate(held, axis=1)
                last = np.flatnonzero((table[:2, 1:] != table[:2, :-1]).any(axis=0))
                cut = int(last[-1]) + 1 if len(last) else 0  # the last bucket may go on
                yield from _linked(table[:, :cut], bits)
                held = [table[:, cut:]]
        if held:
            yield from _linked(np.concatenate(held, axis=1), bits)

    return dealt.mapInArrow(run, "u long, v long")


def _linked(table: np.ndarray, bits: int):
    """Spanning links of the buckets of ``table``, whose rows are sorted."""
    if table.shape[1] < 2:
        return
    edge = np.flatnonzero((table[:2, 1:] != table[:2, :-1]).any(axis=0)) + 1
    lo, hi = np.concatenate([[0], edge]), np.concatenate([edge, [table.shape[1]]])
    lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
    fps = table[2].view(np.uint64)
    work = np.cumsum((hi - lo) ** 2) // PAIRS
    for part in np.unique(work):
        a, b = lo[work == part], hi[work == part]
        start, end = int(a[0]), int(b[-1])
        # Sorted by the signed number within a bucket; the trie needs the order of the bits.
        own = fps[start:end].copy()
        for x, y in zip(a - start, b - start, strict=True):
            own[x:y].sort()
        i, j = trie_join(own, a - start, b - start, bits)
        root = _forest(len(own), i, j)
        far = np.flatnonzero(root != np.arange(len(own)))
        if len(far):
            yield pa.RecordBatch.from_arrays(
                [pa.array(own[far].view(np.int64)), pa.array(own[root[far]].view(np.int64))], names=["u", "v"]
            )


def trie_join(fps: np.ndarray, lo: np.ndarray, hi: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j), i < j, of fingerprints of the same range within ``bits`` differing bits.

    ``fps`` ascends within each range [lo, hi). A trie node is a range of it; all pairs of nodes of a
    depth go down together.
    """
    a0, a1, b0, b1 = lo, hi, lo, hi
    err = np.zeros(len(lo), dtype=np.int8)
    found_i, found_j = [], []
    for depth in range(64):
        if not len(a0):
            break
        same = a0 == b0
        small = (a1 - a0) * (b1 - b0) <= LEAF
        i, j = _leaves(fps, a0[small], a1[small], b0[small], b1[small], bits)
        found_i.append(i)
        found_j.append(j)
        a0, a1, b0, b1, err, same = (x[~small] for x in (a0, a1, b0, b1, err, same))
        ones = np.concatenate([[0], np.cumsum((fps >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        kids = [
            (a0, am, b0, bm, err, None),
            (am, a1, bm, b1, err, None),
            (a0, am, bm, b1, err + 1, None),
            (am, a1, b0, bm, err + 1, ~same),  # of a node with itself, once
        ]
        kept = []
        for x0, x1, y0, y1, e, only in kids:
            ok = (x1 > x0) & (y1 > y0) & (e <= bits) & ~((x0 == y0) & (x1 - x0 < 2))
            ok = ok if only is None else ok & only
            kept.append([z[ok] for z in (x0, x1, y0, y1, e)])
        a0, a1, b0, b1, err = (np.concatenate(z) for z in zip(*kept, strict=True))
    i, j = _leaves(fps, a0, a1, b0, b1, bits)
    return np.concatenate([*found_i, i]), np.concatenate([*found_j, j])


def _leaves(fps, a0, a1, b0, b1, bits):
    wide = b1 - b0
    size = (a1 - a0) * wide
    pair = np.repeat(np.arange(len(size)), size)
    nth = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)
    i, j = a0[pair] + nth // wide[pair], b0[pair] + nth % wide[pair]
    ok = (i < j) & (np.bitwise_count(fps[i] ^ fps[j]) <= bits)
    return i[ok], j[ok]


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position of each position's component."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        left = root[i] != root[j]
        i, j = i[left], j[left]
    return root
