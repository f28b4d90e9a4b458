"""Exact substring dedup: bytes covered by long strings that occur more than once.

Every string of ``length`` bytes belongs to the anchor it holds: the leftmost of the ``GRAM``-byte
grams in it whose mixed rolling hash is smallest. Equal strings have equal anchors, so repeats meet
under their anchor's hash; the strings of one anchor at one place of a document form a segment of
neighbouring starts, and each start of the corpus lies in exactly one segment.

Spark groups numbers first (anchor hash, digest of the segment, document, place) and drops anchors
that occur once. Equal segments become one with a count: if it is over one, all of the segment
repeats. Different segments under an anchor are compared by their bytes: a task concatenates whole
anchors up to ``TEXT`` bytes, sorts the suffixes and derives the common prefixes from the
Burrows-Wheeler transform, by increasing value: intervals are extended breadth first, one byte to the
left, and each marks the row after it with the length reached, until ``length`` is reached. Rows
that are unmarked then share at least ``length`` bytes with the row before.

The equality of whole segments is that of their 128-bit digests. A bitmap of bounded size tells the
scan which segments stand for their equals, so that only their bytes are written for the comparison.

An anchor with more than ``SPLIT`` different segments is cut again with longer grams (a shorter range
of starts under each), until its groups are small or the gram is the string itself; so a task holds
bounded text however many near copies there are, and no string is left out.

Cases: null texts are empty; texts shorter than ``length`` have nothing to remove; repeated rows, also
of one id, count as occurrences of each other; rows without an id are compared like any other; an
empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.bits import BITMAP, bitmap
from cohortloom.sources.stages import StageArea

GRAM = 64
TEXT = 1 << 18
SPLIT = 250
BASE = 0x9E3779B97F4A7C55
MIX = 0xD6E8FEB86659FD93


def grams(raw: np.ndarray, size: int) -> np.ndarray:
    """Mixed rolling hash of every gram."""
    n = len(raw)
    with np.errstate(over="ignore"):
        powers = _powers(n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[:n], out=sums[1:])
        # the gram at i times BASE ** i; the factor back makes it independent of i
        value = (sums[size:] - sums[:-size]) * _inverse(n)[: n - size + 1]
        value ^= value >> np.uint64(32)
        value *= np.uint64(MIX)
        value ^= value >> np.uint64(32)
    return value


_tables: dict[str, np.ndarray] = {}


def _powers(n: int, base: int = BASE, name: str = "up") -> np.ndarray:
    if len(_tables.get(name, ())) < n + 1:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        with np.errstate(over="ignore"):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _tables[name] = np.cumprod(out, dtype=np.uint64)
    return _tables[name]


def _inverse(n: int) -> np.ndarray:
    return _powers(n, pow(BASE, -1, 1 << 64), "down")


def anchors(value: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the place of its smallest, the leftmost of equals."""
    n = len(value) - width + 1
    # Minima of runs by doubling, of places ordered by (hash, place).
    best, span = np.arange(len(value)), 1
    while 2 * span <= width:
        best = _smaller(value, best[:-span], best[span:])
        span *= 2
    return _smaller(value, best[:n], best[width - span : width - span + n])


def _smaller(value: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(value[b] < value[a], b, a)


def segments(raw: bytes, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first start and number of starts of every segment of a text."""
    if len(raw) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    value = grams(np.frombuffer(raw, dtype=np.uint8), size)
    owner = anchors(value, length - size + 1)
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return value[owner[first]].view(np.int64), first, np.diff(np.concatenate([first, [len(owner)]]))


def bwt_repeats(text: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
    """Starts of strings of ``length`` bytes that occur more than once and cross no end.

    ``ends``: the place after the last byte of each part of ``text``. Parts do not touch: each is
    followed by an end mark of its own, smaller than any byte.
    """
    n, marks = len(text) + len(ends), len(ends)
    symbol = np.empty(n, dtype=np.int64)
    mark = ends + np.arange(marks)
    is_mark = np.zeros(n, dtype=bool)
    is_mark[mark] = True
    symbol[mark] = np.arange(marks)
    symbol[~is_mark] = text.astype(np.int64) + marks
    order = _suffixes(symbol, length)
    # The transform, and the row of the suffix one to the left (last-to-first mapping).
    before = symbol[order - 1]
    sort = np.argsort(before, kind="stable")
    lf = np.empty(n, dtype=np.int64)
    lf[sort] = np.arange(n)
    char = np.where(before < marks, -1, before - marks)
    prefix = np.full(n + 1, -1, dtype=np.int32)  # common prefix of a row with the row before
    prefix[: marks + 1] = 0  # every end mark is a symbol of its own
    prefix[n] = 0
    # intervals of one symbol: those of the marks, and those of the bytes
    first = np.searchsorted(symbol[order], np.arange(256) + marks)
    last = np.concatenate([first[1:], [n]]) - 1
    used = last >= first
    lo, hi = np.concatenate([np.arange(marks), first[used]]), np.concatenate([np.arange(marks), last[used]])
    prefix[hi + 1] = 0
    # One byte intervals have prefix 0 after them; their extensions have prefix 1, and so on.
    for value in range(1, length):
        if not len(lo):
            break
        lo, hi = _extended(lo, hi, char, lf)
        new = prefix[hi + 1] < 0
        lo, hi = lo[new], hi[new]
        prefix[hi + 1] = value
    row = np.flatnonzero(prefix[:n] < 0)
    place = np.unique(np.concatenate([order[row], order[row - 1]]))
    return place - np.searchsorted(mark, place)


def _extended(lo: np.ndarray, hi: np.ndarray, char: np.ndarray, lf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of c + w for the intervals of w and every byte c before them."""
    size = hi - lo + 1
    row = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    which = np.repeat(np.arange(len(lo)), size)
    ok = char[row] >= 0
    row, key = row[ok], which[ok] * 256 + char[row[ok]]
    if not len(row):
        return row, row
    sort = np.argsort(key, kind="stable")
    key, row = key[sort], row[sort]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.concatenate([start[1:], [len(key)]]) - 1
    return lf[row[start]], lf[row[end]]


def _suffixes(symbol: np.ndarray, length: int) -> np.ndarray:
    """Places by their suffixes; order beyond ``length`` symbols does not matter."""
    n = len(symbol)
    base = int(symbol.max()) + 2
    rank, depth = symbol, 1
    if base**4 < 1 << 62:  # four symbols in one number
        after = np.concatenate([symbol + 1, np.zeros(3, dtype=np.int64)])
        rank = ((after[:n] * base + after[1 : n + 1]) * base + after[2 : n + 2]) * base + after[3 : n + 3]
        depth = 4
        order = np.argsort(rank)
        step = np.diff(rank[order], prepend=rank[order[0]]) != 0
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(step)
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:-depth] = rank[depth:] + 1
        key = rank * (rank.max() + 2) + after
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, dtype=np.int64)
        step = np.concatenate([[False], key[1:] != key[:-1]])
        rank[order] = np.cumsum(step)
        depth *= 2
        if depth > length or step[1:].all():
            return order


NUMBERS = "anchor long, digest binary, k1 long, k2 long, start int, starts int"


def _cut(raw: bytes, length: int, size: int):
    """Anchor, digest, start, number of starts and bytes of every segment."""
    anchor, first, count = segments(raw, length, size)
    body = [raw[a : a + n - 1 + length] for a, n in zip(first.tolist(), count.tolist(), strict=True)]
    return anchor, [xxhash.xxh3_128_digest(b) for b in body], first, count, body


def _numbered(docs: DataFrame, length: int) -> DataFrame:
    """A row for every segment of every document."""

    def run(batches):
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            found = [_cut(raw, length, GRAM)[:4] for raw in batch.column(2).to_pylist()]
            size = [len(f[0]) for f in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([f[0] for f in found])),
                    pa.array([d for f in found for d in f[1]], pa.binary()),
                    pa.array(np.repeat(k1, size)),
                    pa.array(np.repeat(k2, size)),
                    pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)),
                    pa.array(np.concatenate([f[3] for f in found]).astype(np.int32)),
                ],
                names=["anchor", "digest", "k1", "k2", "start", "starts"],
            )

    return docs.mapInArrow(run, NUMBERS)


BODIES = "anchor long, digest binary, a0 long, d0 binary, off int, starts int, body binary"


def _bodies(docs: DataFrame, wanted: np.ndarray, length: int) -> DataFrame:
    """The bytes of the segments whose bit is set: those that stand for their equals."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for batch in batches:
            rows = []
            for k1, k2, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if len(raw) >= length and _is_set(shared.value, _spot(b"", k1, k2, 0)):
                    for a, d, at, n, body in zip(*_cut(raw, length, GRAM), strict=True):
                        if _is_set(shared.value, _spot(d, k1, k2, int(at))):
                            rows.append((int(a), d, int(a), d, 0, int(n), body))
            yield _batch(rows)

    return docs.mapInArrow(run, BODIES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
    names = ["anchor", "digest", "a0", "d0", "off", "starts", "body"]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _spot(digest: bytes, k1: int, k2: int, start: int) -> int:
    name = digest + (k1 % (1 << 64)).to_bytes(8, "big") + (k2 % (1 << 64)).to_bytes(8, "big") + start.to_bytes(4, "big")
    return xxhash.xxh3_64_intdigest(name) % BITMAP


def _is_set(bits: np.ndarray, spot: int) -> bool:
    return bool(bits[spot >> 3] >> (7 - (spot & 7)) & 1)


def _spots(reps: DataFrame) -> DataFrame:
    """The bits of the segments and of the documents that hold them."""

    def run(batches):
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            spots = [_spot(*r) for r in rows] + list({_spot(b"", k1, k2, 0) for _, k1, k2, _ in rows})
            yield pa.RecordBatch.from_arrays([pa.array(spots, pa.int64())], names=["hash"])

    return reps.select("digest", "first.k1", "first.k2", "first.start").mapInArrow(run, "hash long")


def _finer(rows: DataFrame, length: int, size: int) -> DataFrame:
    """The segments cut again with longer grams."""

    def run(batches):
        for batch in batches:
            out = []
            for a0, d0, off, body in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 6)), strict=True):
                out += [(int(a), d, a0, d0, off + int(at), int(n), b) for a, d, at, n, b in zip(*_cut(body, length, size), strict=True)]
            yield _batch(out)

    return rows.mapInArrow(run, BODIES)


def _compared(groups: DataFrame, length: int) -> DataFrame:
    """(anchor, digest, low, high): ranges of repeated starts of different segments under an anchor.

    ``groups``: one row per anchor and digest. Whole anchors are compared together, ``TEXT`` bytes or
    one anchor at a time.
    """
    dealt = groups.select("anchor", "digest", "body").repartition("anchor").sortWithinPartitions("anchor")

    def flush(held):
        text = np.frombuffer(b"".join(h[2] for h in held), dtype=np.uint8)
        ends = np.cumsum([len(h[2]) for h in held])
        place = bwt_repeats(text, ends, length)
        which = np.searchsorted(ends, place, side="right")
        own = place - (ends - [len(h[2]) for h in held])[which]
        if not len(own):
            return
        new = np.concatenate([[True], (which[1:] != which[:-1]) | (own[1:] != own[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(own)]]) - 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([held[i][0] for i in which[first].tolist()], pa.int64()),
                pa.array([held[i][1] for i in which[first].tolist()], pa.binary()),
                pa.array(own[first].astype(np.int32)),
                pa.array((own[last] + 1).astype(np.int32)),
            ],
            names=["anchor", "digest", "low", "high"],
        )

    def run(batches):
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= TEXT and row[0] != held[-1][0]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[2])
        if held:
            yield from flush(held)

    return dealt.mapInArrow(run, "anchor long, digest binary, low int, high int")


def _ranges(rows: DataFrame, length: int, area: StageArea) -> list[DataFrame]:
    """(a0, d0, low, high): repeated starts of segments that share an anchor with different ones."""
    width, found = length - GRAM + 1, []
    while True:
        # rows: one per segment of the level above; equals among them repeat as a whole
        groups = area.save(
            rows.groupBy("anchor", "digest").agg(F.count("*").alias("n"), F.first("body").alias("body")), "groups"
        )
        sizes = area.save(groups.groupBy("anchor").agg(F.count("*").alias("d")).where("d > 1"), "sizes")
        limit = SPLIT if width > 1 else 1 << 62
        several = groups.join(sizes, "anchor")
        found_here = area.save(_compared(several.where(F.col("d") <= limit), length), "compared")
        whole = groups.where("n > 1").select("anchor", "digest", F.lit(0).alias("low"), F.lit(1 << 30).alias("high"))
        mapped = rows.join(found_here.unionAll(whole), ["anchor", "digest"])
        low, high = F.col("off") + F.col("low"), F.col("off") + F.least("high", "starts")
        found.append(area.save(mapped.select("a0", "d0", low.alias("low"), high.alias("high")), "ranges"))
        hot = sizes.where(F.col("d") > limit)
        if hot.isEmpty():
            return found
        width = max(1, width // 4)
        # Segments that repeat as a whole still take part, as one.
        once = groups.where("n = 1").join(hot, "anchor", "left_semi").select("anchor", "digest")
        alone = rows.join(once, ["anchor", "digest"], "left_semi")
        twice = groups.where("n > 1").join(hot, "anchor", "left_semi").select(
            "anchor", "digest", F.lit(None).cast("long").alias("a0"), F.lit(None).cast("binary").alias("d0"),
            F.lit(0).alias("off"), (F.octet_length("body") - length + 1).alias("starts"), "body",
        )
        rows = area.save(_finer(alone.unionAll(twice), length, length - width + 1), "finer")


def repeated_starts(docs: DataFrame, length: int, area: StageArea) -> DataFrame:
    """(k1, k2, ranges): the starts of repeated strings of each document that has any.

    ``docs``: (k1, k2, raw), the two halves of a document's name and its bytes.
    """
    numbers = area.save(_numbered(docs, length), "segments")
    repeated = area.save(numbers.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    cand = area.save(numbers.join(repeated, "anchor"), "candidates")
    least = F.min(F.struct("k1", "k2", "start", "starts")).alias("first")
    equal = area.save(cand.groupBy("anchor", "digest").agg(F.count("*").alias("n"), least), "equal")
    several = area.save(equal.groupBy("anchor").agg(F.count("*").alias("d")).where("d > 1").select("anchor"), "several")
    reps = equal.join(several, "anchor")
    bodies = _bodies(docs, bitmap(_spots(reps)), length)
    # A bit can be set by chance; equal segments are the same to the comparison.
    bodies = bodies.groupBy("anchor", "digest", "a0", "d0", "off", "starts").agg(F.first("body").alias("body"))
    parts = _ranges(area.save(bodies, "bodies"), length, area)
    whole = equal.where("n > 1").select("anchor", "digest", F.lit(0).alias("low"), F.col("first.starts").alias("high"))
    for part in parts:
        whole = whole.unionAll(part.where("a0 IS NOT NULL").select(F.col("a0").alias("anchor"), F.col("d0").alias("digest"), "low", "high"))
    ranges = area.save(whole, "repeats")
    placed = cand.join(ranges, ["anchor", "digest"]).select(
        "k1", "k2", F.struct((F.col("start") + F.col("low")).alias("low"), (F.col("start") + F.col("high")).alias("high")).alias("range")
    )
    # at most as many ranges as a document has segments and gaps between its repeats
    return area.save(placed.groupBy("k1", "k2").agg(F.collect_set("range").alias("ranges")), "placed")


def remove_repeats(df: DataFrame, length: int, area: StageArea, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all others than the results), ``kept`` (binary), ``n_bytes`` and ``spans``.

    ``spans``: maximal removed runs (start, end) of bytes.
    """
    names = [c for c in df.columns if c not in ("kept", "n_bytes", "spans")] if keep is None else keep
    row = F.struct(*names)
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    # The name of a document: two hashes of all that it is.
    named = df.select(
        row.alias("row"), F.xxhash64(row, raw).alias("k1"), F.xxhash64(raw, F.lit(1), row).alias("k2"), raw.alias("raw")
    )
    found = repeated_starts(named.select("k1", "k2", "raw"), length, area)
    joined = named.join(found.hint("merge"), ["k1", "k2"], "left").select("row", "raw", "ranges")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType(
        [T.StructField("row", named.schema["row"].dataType), T.StructField("kept", T.BinaryType()),
         T.StructField("n_bytes", T.LongType()), T.StructField("spans", span)]
    )
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            kept, size, spans = [], [], []
            for body, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                gone = merged([(r["low"], r["high"] - 1 + length) for r in ranges or ()])
                edges = [0, *(x for span in gone for x in span), len(body)]
                kept.append(b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                size.append(len(body))
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.binary()), pa.array(size, pa.int64()), pa.array(spans, kind)], names=schema.names
            )

    done = joined.mapInArrow(run, schema)
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "kept", "n_bytes", "spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs; spans that touch are one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
