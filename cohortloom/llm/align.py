"""Cross-tokenizer alignment: which tokens of two tokenizers stand for the same bytes, and how often.

Each text is encoded twice, as bytes of one blank and the text. Offsets at which tokens of both end cut
the two token rows into groups; a token of one and a token of the other are linked wherever their byte
ranges overlap, that is once between any two neighbouring token ends. The counts of all pairs of ids
come from an inverted index of bitmaps:

* Documents are numbered; 65536 numbers are a block. For each pair of ids and block the index holds
  bitmaps of the documents that have the pair: one plane for each binary digit of how many links of the
  document hold it. A bitmap is a sorted list of 16-bit places, or 8 KB of bits if that is shorter.
* Bitmaps are built from some thousand documents at a time and merged by OR. The bits of all planes
  together are the documents of a pair; the bits of plane k count for 2**k links.
* The counts of the blocks are added up, so a pair that every document holds is spread over the blocks
  and never meets in one task. The postings then carry the counts back: by block, each bitmap adds its
  pair's count to its documents, in one array of 65536 numbers.

Texts are cut at single blanks between other characters, where no token of either tokenizer can reach
across (a piece model with such a token is not cut). A task encodes and aligns each piece once and
remembers it; texts are put together from their pieces, whose ends are token ends of both.

What is shuffled is the postings, twice, at some two bytes each, and a few numbers of each document.
Memory is bounded by a block's array, by ``POSTINGS`` links at a time, and by the longest text.

Cases: a null or empty text, or one whose tokens do not give back its bytes (a tokenizer that changes
characters), has no tokens, groups and links; repeated rows are documents of their own and all count;
ties for the highest count of an id are all highest; an empty table gives an empty result; a kept
column that has the name of a result makes the result's name start with an underscore.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.periodic import slices
from cohortloom.sources.stages import StageArea

SLICE = 2_000_000  # bytes of text that are encoded together
POSTINGS = 2_000_000  # links of distinct pairs whose bitmaps a task builds together
REMEMBERED = 24_000_000  # bytes of pieces and their groups that a task remembers at most
LATIN = re.compile(r"[\t\n\r -~\u00a1-\u024f]*")  # classes that never changed
# A blank that begins a token of the first tokenizer whatever stands before it: one before a character
# that is white space in no version of Unicode. For the second, something else than a blank stands before.
CUT = re.compile("(?<=[^\\s\u2581]) (?=[!-~\u00c0-\u167f\u1681-\u180d\u1810-\u1fff\u2c00-\u2fff\u3001-\ud7ff\U00010000-\U0010ffff])")
BLOCK = 1 << 16
FULL = BLOCK // 8  # bytes of a bitmap that is no list
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
PAIR = T.StructType([T.StructField(n, T.IntegerType()) for n in ("a", "b", "links")])


@dataclass(frozen=True)
class Tokenizers:
    """The two vocabulary files, read by the driver and sent to the tasks.

    ``pattern`` is the expression by which the first tokenizer splits. With it, and if the ids follow the
    merges, Latin pieces are encoded by ranks, which gives the same ids sooner.
    """

    a: bytes  # byte-level BPE, as JSON
    b: bytes  # a piece model with byte fallback
    pattern: str | None = None

    @staticmethod
    def read(a: str, b: str, pattern: str | None = None) -> Tokenizers:
        return Tokenizers(Path(a).read_bytes(), Path(b).read_bytes(), pattern)


def byte_symbols() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for.

    Printable characters of Latin-1 are themselves, all other bytes follow from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Loaded:
    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_buffer(files.a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=files.b)
        symbols = byte_symbols()

        def plain(symbol: str | None) -> bytes:
            known = symbol is not None and all(c in symbols for c in symbol)
            return bytes(symbols[c] for c in symbol) if known else (symbol or "").encode()

        def piece(i: int) -> bytes:
            text = self.b.id_to_piece(i)
            return bytes([int(text[1:-1], 16)]) if self.b.is_byte(i) else text.replace("▁", " ").encode()

        bytes_a = [plain(self.a.id_to_token(i)) for i in range(self.a.get_vocab_size())]
        bytes_b = [piece(i) for i in range(self.b.get_piece_size())]
        self.ranked = self._by_ranks(files, bytes_a)
        # No piece reaches from another character over a blank.
        self.cuts = not any(re.search("[^▁]▁", self.b.id_to_piece(i)) for i in range(len(bytes_b)))
        self.bytes_a, self.bytes_b = (pa.array(t, pa.large_binary()) for t in (bytes_a, bytes_b))
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (bytes_a, bytes_b))
        # Ids as text with what may follow them: another id of the group, the other side, a group, nothing.
        self.most = max(len(bytes_a), len(bytes_b))
        self.shown = pa.array([f"{i}{end}" for end in (",", "|", ";", "") for i in range(self.most)], pa.large_string())

    @staticmethod
    def _by_ranks(files: Tokenizers, bytes_a: list[bytes]):
        model = json.loads(files.a)["model"]
        merges = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if files.pattern is None or any(model["vocab"][m] != 256 + i for i, m in enumerate(merges)):
            return None
        import tiktoken

        ranks = {x: i for i, x in enumerate(bytes_a[: 256 + len(merges)])}
        return tiktoken.Encoding("ranks", pat_str=files.pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both tokenizers and their number in each text."""
        spaced = [" " + t for t in texts]
        if self.ranked is None:
            found = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        else:
            by_ranks, latin = self.ranked.encode_ordinary, LATIN.fullmatch
            found = [by_ranks(t) if latin(t) else None for t in spaced]
            others = [i for i, x in enumerate(found) if x is None]
            encoded = self.a.encode_batch_fast([spaced[i] for i in others], add_special_tokens=False)
            for i, e in zip(others, encoded, strict=True):
                found[i] = e.ids
        return *_flat(found), *_flat(self.b.encode(texts, num_threads=1))

    def faithful(self, texts: list[str], a, sizes_a, b, sizes_b) -> np.ndarray:
        """Which texts the tokens of both give back."""
        raw = pa.array([" " + t for t in texts], pa.large_string()).cast(pa.large_binary())
        same = np.ones(len(texts), dtype=bool)
        for table, ids, sizes in ((self.bytes_a, a, sizes_a), (self.bytes_b, b, sizes_b)):
            joined = _joined(table.take(pa.array(ids)), _starts(sizes))
            same &= pc.equal(joined, raw).to_numpy(zero_copy_only=False)
        return same


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    return np.fromiter(chain.from_iterable(rows), dtype=np.int64, count=int(sizes.sum())), sizes


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _joined(values: pa.Array, cuts: np.ndarray) -> pa.Array:
    """Neighbouring values from cut to cut put together; a new array without nulls."""
    _, offsets, data = values.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[: len(values) + 1] if len(values) else np.zeros(1, dtype=np.int64)
    return pa.Array.from_buffers(values.type, len(cuts) - 1, [None, pa.py_buffer(ends[cuts]), data])


class _Aligner:
    """Aligns texts piece by piece and remembers the pieces."""

    def __init__(self, tools: _Loaded):
        self.tools = tools
        self.base = len(tools.bytes_b)
        self.forget()

    def forget(self) -> None:
        self.pieces = self.groups = pa.array([], pa.large_string())
        self.counts = np.zeros((len(COUNTS), 0), dtype=np.int64)
        self.same = np.zeros(0, dtype=bool)
        self.offsets = np.zeros(1, dtype=np.int64)
        self.keys, self.links = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def learn(self, pieces: pa.Array) -> None:
        counts, same, groups, sizes, keys, links = aligned(self.tools, pieces.to_pylist())
        self.pieces, self.groups = pa.concat_arrays([self.pieces, pieces]), pa.concat_arrays([self.groups, groups])
        self.counts = np.concatenate([self.counts, counts], axis=1)
        self.same = np.concatenate([self.same, same])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.keys, self.links = np.concatenate([self.keys, keys]), np.concatenate([self.links, links])

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Counts, groups and linked pairs of each text."""
        if self.pieces.nbytes + self.groups.nbytes > REMEMBERED:
            self.forget()
        cut = CUT.split if self.tools.cuts else lambda t: [t]
        parts = [cut(t) if t else [] for t in texts]
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        named = pa.array(chain.from_iterable(parts), pa.large_string(), size=int(sizes.sum())).dictionary_encode()
        new = named.dictionary.filter(pc.invert(pc.is_in(named.dictionary, value_set=self.pieces)))
        if len(new):
            self.learn(new)
        number = pc.index_in(named.dictionary, value_set=self.pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        at, row = number[named.indices.to_numpy()], np.repeat(np.arange(len(texts)), sizes)
        bad = np.zeros(len(texts), dtype=bool)
        bad[row[~self.same[at]]] = True
        at, row, sizes = at[~bad[row]], row[~bad[row]], np.where(bad, 0, sizes)
        counts = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
        np.add.at(counts, row, self.counts[:, at].T)
        lists = pa.LargeListArray.from_arrays(pa.array(_starts(sizes)), self.groups.take(pa.array(at)))
        groups = pc.binary_join(lists, pa.scalar(";", pa.large_string()))

        first, width = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        place = np.arange(width.sum()) + np.repeat(first - (np.cumsum(width) - width), width)
        whole = np.repeat(row, width) * (len(self.tools.bytes_a) * self.base) + self.keys[place]
        order = np.argsort(whole, kind="stable")
        whole, links = whole[order], self.links[place][order]
        starts = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, dtype=np.int64)
        row, key = np.divmod(whole[starts], len(self.tools.bytes_a) * self.base)
        flat = [*np.divmod(key, self.base), np.add.reduceat(links, starts) if len(starts) else links]
        entries = pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in flat], names=PAIR.names)
        offsets = _starts(np.bincount(row, minlength=len(texts)))
        return counts.T, groups.cast(pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


def aligned(tools: _Loaded, texts: list[str]) -> tuple:
    """Of each text: counts, whether both tokenizers give it back, groups, and linked pairs.

    The pairs of all texts are (number of pairs of each text, a * size of b's vocabulary + b, links).
    """
    a, sizes_a, b, sizes_b = tools.encode(texts)
    same = tools.faithful(texts, a, sizes_a, b, sizes_b)
    if not same.all():
        a, b = a[np.repeat(same, sizes_a)], b[np.repeat(same, sizes_b)]
        sizes_a, sizes_b = sizes_a * same, sizes_b * same
    rows = len(texts)
    # All texts stand one after the other; both tokenizers end a token where a text ends.
    ends_a, ends_b = np.cumsum(tools.sizes_a[a]), np.cumsum(tools.sizes_b[b])
    row_a = np.repeat(np.arange(rows), sizes_a)
    edges = np.union1d(ends_a, ends_b)
    in_a, in_b = np.searchsorted(ends_a, edges), np.searchsorted(ends_b, edges)
    last_a, last_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    if len(edges):
        shared = (ends_a[in_a] == edges) & (ends_b[in_b] == edges)
        last_a[in_a[shared]] = last_b[in_b[shared]] = True
    row = row_a[in_a]
    counts = np.stack(
        [sizes_a, sizes_b, np.bincount(row_a[last_a], minlength=rows), np.bincount(row, minlength=rows)]
    ).astype(np.int64)

    base_a, base_b = len(tools.bytes_a), len(tools.bytes_b)
    whole = np.sort((row * base_a + a[in_a]) * base_b + b[in_b])
    starts = np.flatnonzero(np.concatenate([[True], whole[1:] != whole[:-1]])) if len(whole) else np.zeros(0, dtype=np.int64)
    row, keys = np.divmod(whole[starts], base_a * base_b)
    links = np.diff(np.append(starts, len(whole)))

    # Every token's place when the groups are written out: a's ids, then b's ids of each group.
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    groups = int(last_a.sum())
    before_b = _starts(np.bincount(group_b, minlength=groups))
    before_a = _starts(np.bincount(group_a, minlength=groups))
    stop = np.zeros(len(b), dtype=bool)
    stop[np.cumsum(sizes_b)[sizes_b > 0] - 1] = True
    ending_a, ending_b = last_a.astype(np.int64), np.where(stop, 3, np.where(last_b, 2, 0))
    written = np.zeros(len(a) + len(b), dtype=np.int64)
    written[np.arange(len(a)) + before_b[group_a]] = ending_a * tools.most + a
    written[np.arange(len(b)) + before_a[group_b + 1]] = ending_b * tools.most + b
    groups = _joined(tools.shown.take(pa.array(written)), _starts(sizes_a + sizes_b))
    return counts, same, groups, np.bincount(row, minlength=rows), keys, links


def align(df: DataFrame, files: Tokenizers, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """``keep`` (all columns if not given), the counts, the groups and the linked pairs of every row."""
    kept = df.columns if keep is None else list(keep)
    outputs = [*((n, T.LongType()) for n in COUNTS), ("groups", T.StringType()), ("pairs", T.ArrayType(PAIR))]
    outputs = [(_free(n, kept), t) for n, t in outputs]
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([held.schema["kept"], *(T.StructField(n, t) for n, t in outputs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _Aligner(_Loaded(files))
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                counts, groups, pairs = aligner.rows(some.column(1).to_pylist())
                arrays = [some.column(0), *(pa.array(c) for c in counts), groups, pairs]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    found = held.mapInArrow(run, schema)
    return found.select(*(F.col("kept").getField(c).alias(c) for c in kept), *(n for n, _ in outputs))


def _free(name: str, taken: Sequence[str]) -> str:
    while name in taken:
        name = f"_{name}"
    return name


# --- The inverted index --------------------------------------------------------------------------


def _containers(places: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A bitmap of the places of each group."""
    sizes = np.diff(np.append(starts, len(places)))
    if not (sizes > FULL // 2 - 1).any():
        offsets = (2 * np.append(starts, len(places))).astype(np.int32)
        return pa.Array.from_buffers(
            pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(places.astype(np.uint16))]
        )
    return pa.array([_bitmap(places[s : s + n]) for s, n in zip(starts, sizes, strict=True)], pa.binary())


def _bitmap(places: np.ndarray) -> bytes:
    if len(places) < FULL // 2:
        return places.astype(np.uint16).tobytes()
    bits = np.zeros(BLOCK, dtype=np.uint8)
    bits[places] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def _places(bitmap: bytes) -> np.ndarray:
    if len(bitmap) < FULL:
        return np.frombuffer(bitmap, dtype=np.uint16)
    return np.flatnonzero(np.unpackbits(np.frombuffer(bitmap, dtype=np.uint8), bitorder="little"))


def _merged(bitmaps: list[bytes]) -> bytes:
    """OR of bitmaps."""
    if len(bitmaps) == 1:
        return bitmaps[0]
    if all(len(b) == FULL for b in bitmaps):
        return np.bitwise_or.reduce([np.frombuffer(b, dtype=np.uint8) for b in bitmaps]).tobytes()
    return _bitmap(np.unique(np.concatenate([_places(b) for b in bitmaps])))


def _popcount(bitmap: bytes) -> int:
    if len(bitmap) < FULL:
        return len(bitmap) // 2
    return int(np.bitwise_count(np.frombuffer(bitmap, dtype=np.uint64)).sum())


def _postings(numbered: DataFrame) -> DataFrame:
    """(a, b, block, plane, bits) of the documents that a task sees together."""
    schema = "a int, b int, block long, plane int, bits binary"

    def built(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        row, a, b, links = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((row, b, a))
        row, a, b, links = row[order], a[order], b[order], links[order]
        plane = 0
        while len(row):
            held = links >> plane & 1 == 1
            r, x, y = row[held], a[held], b[held]
            block = r >> 16
            new = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (block[1:] != block[:-1])
            starts = np.flatnonzero(np.concatenate([[True], new])) if len(r) else np.zeros(0, dtype=np.int64)
            if len(starts):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(x[starts].astype(np.int32)),
                        pa.array(y[starts].astype(np.int32)),
                        pa.array(block[starts]),
                        pa.array(np.full(len(starts), plane, dtype=np.int32)),
                        _containers(r & (BLOCK - 1), starts),
                    ],
                    names=["a", "b", "block", "plane", "bits"],
                )
            plane += 1
            more = links >> plane > 0
            row, a, b, links = row[more], a[more], b[more], links[more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten()
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            row = np.repeat(batch.column(0).to_numpy(), sizes)
            parts.append((row, *(flat.field(n).to_numpy().astype(np.int64) for n in PAIR.names)))
            size += len(row)
            if size >= POSTINGS:
                yield from built(parts)
                parts, size = [], 0
        if parts:
            yield from built(parts)

    return numbered.mapInArrow(run, schema)


def _index(postings: DataFrame) -> DataFrame:
    """(a, b, block, planes, n_docs, n_links): the merged bitmaps of each pair and block."""
    parts = postings.groupBy("a", "b", "block").agg(F.collect_list(F.struct("plane", "bits")).alias("parts"))
    schema = "a int, b int, block long, planes array<binary>, n_docs long, n_links long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat = lists.flatten()
            plane, bits = flat.field("plane").to_numpy().tolist(), flat.field("bits").to_pylist()
            start, planes, n_docs, n_links = 0, [], [], []
            for size in pc.list_value_length(lists).to_pylist():
                if size == 1 and plane[start] == 0:
                    found = [bits[start]]
                    docs = links = _popcount(found[0])
                else:
                    held: dict[int, list[bytes]] = {}
                    for i in range(start, start + size):
                        held.setdefault(plane[i], []).append(bits[i])
                    found = [_merged(held[k]) if k in held else b"" for k in range(max(held) + 1)]
                    docs = _popcount(_merged(found))
                    links = sum(_popcount(x) << k for k, x in enumerate(found))
                planes.append(found)
                n_docs.append(docs)
                n_links.append(links)
                start += size
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(planes, pa.list_(pa.binary())), pa.array(n_docs, pa.int64()), pa.array(n_links, pa.int64())],
                names=["a", "b", "block", "planes", "n_docs", "n_links"],
            )

    return parts.mapInArrow(run, schema)


def pair_scores(index: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_links, best): whether no other partner of b has more links."""
    pairs = index.groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    most = pairs.groupBy("b").agg(F.max("n_links").alias("most"))
    return pairs.join(most, "b").select("a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))


def _returned(index: DataFrame, scores: DataFrame) -> DataFrame:
    """(row, n_best, count_sum) of every document with links, from the postings of its block."""
    told = index.select("a", "b", "block", "planes").join(scores.hint("merge"), ["a", "b"])
    dealt = told.select("block", "planes", "n_links", "best").repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if sums is not None:
                place = np.flatnonzero(sums[0])
                arrays = [pa.array((now << 16) + place), pa.array(sums[1][place]), pa.array(sums[0][place])]
                yield pa.RecordBatch.from_arrays(arrays, names=["row", "n_best", "count_sum"])

        for batch in batches:
            block = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                if x == y:
                    continue
                if block[x] != now:
                    yield from done()
                    now, sums = int(block[x]), np.zeros((2, BLOCK), dtype=np.int64)
                _add(batch.slice(x, y - x), sums)
        yield from done()

    return dealt.mapInArrow(run, "row long, n_best long, count_sum long")


def _add(batch: pa.RecordBatch, sums: np.ndarray) -> None:
    """Add the counts of pairs to the documents that their planes hold."""
    lists = batch.column(1)
    planes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    parent = np.repeat(np.arange(len(planes)), planes)
    plane = np.arange(len(parent)) - np.repeat(np.cumsum(planes) - planes, planes)
    count = batch.column(2).to_numpy()[parent] << plane
    best = batch.column(3).to_numpy(zero_copy_only=False)[parent].astype(np.int64) << plane
    bits = lists.flatten().to_pylist()
    size = np.array([len(x) for x in bits], dtype=np.int64)
    short = np.flatnonzero(size < FULL)
    at = np.frombuffer(b"".join([bits[i] for i in short.tolist()]), dtype=np.uint16)
    np.add.at(sums[0], at, np.repeat(count[short], size[short] // 2))
    np.add.at(sums[1], at, np.repeat(best[short], size[short] // 2))
    for i in np.flatnonzero(size == FULL).tolist():
        at = _places(bits[i])
        sums[0][at] += count[i]
        sums[1][at] += best[i]


def scored(linked: DataFrame, area: StageArea) -> DataFrame:
    """The rows of ``align`` without their pairs, with n_best and count_sum.

    n_best: links whose pair no other partner of its second id outnumbers; count_sum: the links of the
    whole table that hold the pair, added up over the row's links. The pairs with their numbers of
    documents and links stay in the area as ``pair_scores``.
    """
    rest = [c for c in linked.columns if c != "pairs"]
    number = _free("row", linked.columns)
    rows = area.save(linked.withColumn(number, F.monotonically_increasing_id()), "aligned")
    index = area.save(_index(_postings(rows.select(F.col(number).alias("row"), "pairs"))), "pair_index")
    scores = area.save(pair_scores(index), "pair_scores")
    told = _returned(index, scores)
    results = {n: _free(n, rest) for n in ("n_best", "count_sum")}
    told = told.select(F.col("row").alias(number), *(F.col(n).alias(f) for n, f in results.items()))
    joined = rows.drop("pairs").join(told.hint("merge"), number, "left")
    return joined.select(*(f"`{c}`" for c in rest), *(F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in results.values()))
