"""Periodic runs of words, found through string synchronising sets.

A run is a stretch of consecutive words with smallest period q, of at least ``least`` words and at
least ``EXPONENT`` periods, that no neighbouring word extends. For every dyadic scale t a hash of each
window of t words is compared with those of its neighbours: a position belongs to the set of that scale
if, of the windows that start up to t words after it, its own or the last one has the smallest hash.
That depends on 2t words only, so equal stretches of text have their positions at the same places, and
every t consecutive words hold one, unless they lie in a region of a period of at most t / EXPONENT.
Windows inside such a highly periodic region are left out of the set; these regions are the runs found
at smaller scales, and the periods below ``SMALLEST`` are found directly, by comparing the words with
themselves shifted.

A run of period q has, at the scale t <= q < 2t, a position of the set among its first t words, and the
next position with the same 2t words stands exactly q words later. So the neighbours among positions of
equal context propose all periods from t to 2t; each proposal is extended to both sides by comparing
hashes of dyadic windows, and what it gives is compared word by word before it counts. Where several
periods give the same stretch, the smallest is its period. Hashes of windows have 64 bits; words are
numbered exactly.

The work for a text of n words is O(n log^2 n) in numpy over all texts of a slice at once, the longest
first, so that a scale only touches the texts that are long enough for it. Every text is searched
whole in one task: memory grows with the longest text (about 8 log2(n) bytes a word), not with the
number of texts. There is no shuffle.

Cases: words are parted by ASCII white space; a null, empty or blank text has no words, no runs and an
empty collapsed text; of tied longest runs the caller chooses; repeated rows are separate rows; an
empty table gives an empty result; a kept column that has the name of a result makes the result's name
start with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXPONENT = 4  # periods that a run has at least; the proof of completeness needs four
SMALLEST = 4  # the first scale; smaller periods are found by shifting
SLICE = 2_000_000  # bytes of text that are searched together
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
NONE = np.iinfo(np.uint64).max


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal stretches of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


class _Ladder:
    """Hashes of all windows of 2**k words, over the texts that are that long."""

    def __init__(self, codes: np.ndarray, ends: dict[int, int]):
        self.ends = ends
        self.levels = [_mixed(codes.astype(np.uint64) + np.uint64(1))]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            w = 1 << (len(self.levels) - 1)
            one = self.levels[-1][: self.ends.get(len(self.levels), 0)]
            size = max(len(one) - w, 0)
            self.levels.append(_mixed(one[:size] * np.uint64(0x9E3779B97F4A7C15) + np.roll(one, -w)[:size]))
        return self.levels[k]

    def extended(self, at: np.ndarray, by: np.ndarray, far: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The stretch around each place in which words ``by`` places apart are equal.

        The first ``far`` words from each place are known to be.
        """
        right, left = at + far, at.copy()
        for k in range(top, -1, -1):
            h, w = self.level(k), 1 << k
            if not len(h):
                continue
            last = len(h) - 1
            other = right + by
            right = right + w * ((other <= last) & (h[np.minimum(right, last)] == h[np.minimum(other, last)]))
            before = left - w
            ok = (before >= 0) & (before + by <= last)
            ok &= h[np.clip(before, 0, last)] == h[np.clip(before + by, 0, last)]
            left = left - w * ok
        return left, right


def find_runs(codes: np.ndarray, lengths: Sequence[int], least: int = 6) -> np.ndarray:
    """Rows (start, end, period) over texts that stand one after the other, the longest first.

    ``codes`` numbers the words; after each text stands a number that occurs nowhere else.
    """
    longest = lengths[0] if len(lengths) else 0
    sizes, stops = np.asarray(lengths, dtype=np.int64), np.cumsum(np.asarray(lengths, dtype=np.int64) + 1)

    def reach(n: int) -> int:
        """Where the texts of at least n words end."""
        count = int(np.searchsorted(-sizes, -n, side="right"))
        return int(stops[count - 1]) if count else 0

    top = max(longest, 1).bit_length() - 1
    ladder = _Ladder(codes, {k: reach(1 << k) for k in range(top + 2)})
    found = [np.zeros((0, 3), dtype=np.int64)]
    for q in range(1, SMALLEST):
        end = reach(max(least, EXPONENT * q))
        a, b = _stretches(codes[: max(end - q, 0)] == codes[q:end])
        keep = b - a + q >= max(least, EXPONENT * q)
        found.append(np.stack([a[keep], b[keep] + q, np.full(keep.sum(), q)], axis=1))
    runs = _smallest(np.concatenate(found))
    k = SMALLEST.bit_length() - 1
    while EXPONENT << k <= longest:
        new = _scale(codes[: reach(EXPONENT << k)], ladder, k, top, runs, least)
        if len(new):
            runs = _smallest(np.concatenate([runs, new]))
        k += 1
    return runs


def _smallest(runs: np.ndarray) -> np.ndarray:
    """Of the rows of one stretch that with the smallest period."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    return runs[np.concatenate([[True], (runs[1:, :2] != runs[:-1, :2]).any(axis=1)])[: len(runs)]]


def _scale(codes: np.ndarray, ladder: _Ladder, k: int, top: int, runs: np.ndarray, least: int) -> np.ndarray:
    """The runs with a period of 2**k words up to twice that."""
    t, size = 1 << k, len(codes)
    hashes = ladder.level(k)[: max(size - t, 0)].copy()
    regions = runs[(runs[:, 2] * EXPONENT <= t) & (runs[:, 1] - runs[:, 0] >= t) & (runs[:, 1] <= size)]
    if len(regions):
        inside = np.zeros(len(hashes) + 1, dtype=np.int64)
        np.add.at(inside, regions[:, 0], 1)
        np.add.at(inside, np.minimum(regions[:, 1] - t + 1, len(hashes)), -1)
        hashes[np.cumsum(inside[:-1]) > 0] = NONE
    least_of = hashes
    for j in range(k):
        w = 1 << j
        least_of = np.minimum(least_of[:-w], least_of[w:])
    if len(least_of) < 2:
        return runs[:0]
    places = len(hashes) - t
    least_of = np.minimum(least_of[:places], hashes[t:])
    picked = np.flatnonzero((least_of != NONE) & ((least_of == hashes[:places]) | (least_of == hashes[t:])))
    context = ladder.level(k + 1)
    picked = picked[picked < len(context)]
    order = picked[np.argsort(context[picked], kind="stable")]
    apart = order[1:] - order[:-1]
    ok = (context[order[1:]] == context[order[:-1]]) & (apart >= t) & (apart < 2 * t)
    at, by = order[:-1][ok], apart[ok]
    left, right = ladder.extended(at, by, np.full(len(at), 2 * t), top)
    ok = right + by - left >= np.maximum(least, EXPONENT * by)
    rows = np.unique(np.stack([left[ok], right[ok] + by[ok], by[ok]], axis=1), axis=0)
    return np.array([_exact(codes, *row) for row in rows.tolist()], dtype=np.int64).reshape(-1, 3)


def _exact(codes: np.ndarray, start: int, end: int, q: int) -> tuple[int, int, int]:
    """The stretch itself if its words agree, else what words say around its longest part that does."""
    same = codes[start : end - q] == codes[start + q : end]
    if same.all():
        return start, end, q
    a, b = _stretches(codes[:-q] == codes[q:])  # two windows had one hash
    best = int(np.argmax(np.minimum(b, end - q) - np.maximum(a, start)))
    return int(a[best]), int(b[best]) + q, q


def runs_of(texts: list[str | None], least: int = 6) -> list[tuple[list[bytes], np.ndarray]]:
    """Words and runs (start, length, period) of each text, by start, then period."""
    words = [(t or "").encode().split() for t in texts]
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    lengths = [len(words[i]) for i in order]
    flat = pa.array([w for i in order for w in words[i]], pa.binary()).dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(np.array(lengths, dtype=np.int64) + 1)])
    codes = np.full(starts[-1], -1, dtype=np.int64)
    breaks = starts[1:] - 1
    codes[breaks] = len(flat.dictionary) + np.arange(len(breaks))
    codes[codes < 0] = flat.indices.to_numpy()
    found = find_runs(codes, lengths, least)
    found = found[found[:, 1] - found[:, 0] >= np.maximum(least, EXPONENT * found[:, 2])]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    cut = np.searchsorted(found[:, 0], starts)
    out: list = [None] * len(words)
    for place, i in enumerate(order):
        rows = found[cut[place] : cut[place + 1]].copy()
        rows[:, 1] -= rows[:, 0]
        rows[:, 0] -= starts[place]
        out[i] = (words[i], rows)
    return out


def _collapsed(words: list[bytes], runs: np.ndarray) -> str:
    """The words that no run contains after its first period."""
    if len(runs):
        inside = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(inside, runs[:, 0] + runs[:, 2], 1)
        np.add.at(inside, runs[:, 0] + runs[:, 1], -1)
        words = [words[i] for i in np.flatnonzero(np.cumsum(inside[:-1]) == 0).tolist()]
    return b" ".join(words).decode()


def with_runs(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None, least: int = 6) -> DataFrame:
    """``keep`` (all columns if not given), n_words, runs and the collapsed text of every row."""
    kept = df.columns if keep is None else list(keep)

    def named(name: str) -> str:
        while name in kept:
            name = f"_{name}"
        return name

    outputs = [(named("n_words"), T.LongType()), (named("runs"), T.ArrayType(RUN)), (named("collapsed"), T.StringType())]
    held = df.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("kept"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([held.schema["kept"], *(T.StructField(n, t) for n, t in outputs)])
    runs_type = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                rows = runs_of(some.column(1).to_pylist(), least)
                found = [[dict(zip(RUN.names, r, strict=True)) for r in runs.tolist()] for _, runs in rows]
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0),
                        pa.array([len(words) for words, _ in rows], pa.int64()),
                        pa.array(found, runs_type),
                        pa.array([_collapsed(*r) for r in rows], pa.string()),
                    ],
                    names=schema.names,
                )

    found = held.mapInArrow(run, schema)
    return found.select(*(F.col("kept").getField(c).alias(c) for c in kept), *(n for n, _ in outputs))


def slices(batch: pa.RecordBatch, column: int, size: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose texts have about ``size`` bytes together, or of one long text."""
    texts = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(lengths) // size
    start = 0
    while start < len(part):
        stop = int(np.searchsorted(part, part[start], side="right"))
        yield batch.slice(start, stop - start)
        start = stop
