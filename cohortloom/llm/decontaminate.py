"""Benchmark decontamination: pigeonhole pieces and Myers distance.

Texts and items are compared in lower case with single spaces. An item of m characters may differ
from a passage by ``m // SHARE`` edits. Of that number plus one pieces of the item at least one is
untouched by the edits, so every passage within the budget holds a piece exactly. One pass over the
texts finds all pieces with an automaton; around each hit the bit-parallel distance of Myers checks
the whole item against the text, with any beginning and end.

Items are taken in blocks of about ``BLOCK`` characters, whose pieces are broadcast. A larger benchmark
takes more passes, not more memory: each block has a job of its own, which writes what it finds under the
digest of the text; only the texts that have leaks meet there again.

Cases: null and empty texts have no leaks; null and blank items, and those of fewer than ``least``
characters if the caller sets it, take no part; items of up to ``SHARE`` - 1 characters must be found
exactly; ids of items are of any type; items of equal text are all reported; of several passages like
an item the nearest, then the first, is reported; repeated rows are treated alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cohortloom.sources.stages import StageArea

SHARE = 20  # characters of an item for each edit
BLOCK = 500_000  # characters of a block of items


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str) -> list[tuple[int, str]]:
    """Place and text of the pieces: one more than the edits allowed."""
    n = len(item) // SHARE + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def nearest(item: str, text: str, most: int) -> tuple[int, int] | None:
    """Distance and end of the best match of ``item`` with any part of ``text``; None beyond ``most``.

    Columns of the edit matrix are bit vectors of vertical differences.
    """
    m = len(item)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best: tuple[int, int] | None = None
    for end, c in enumerate(text, 1):
        eq = where.get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | ~(diagonal | plus) & full, plus & diagonal
        distance += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        if distance <= most and (best is None or distance < best[0]):
            best = (distance, end)
    return best


@dataclass
class Finder:
    """The automaton of a block of items."""

    items: list[tuple[int, str]]

    def __post_init__(self) -> None:
        self.texts: dict[str, list[int]] = {}
        for name, text in self.items:
            self.texts.setdefault(text, []).append(name)
        self.unique = list(self.texts)
        hits: dict[str, list[tuple[int, int]]] = {}
        for n, text in enumerate(self.unique):
            for at, piece in pieces(text):
                hits.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in hits.items():
            self.automaton.add_word(piece, (len(piece), places))
        if hits:
            self.automaton.make_automaton()

    def leaks(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, distance, end in the normal form of the text) of every item found, by item."""
        if not text or not self.unique:
            return []
        body = normal(text)
        best: dict[int, tuple[int, int]] = {}
        looked: dict[int, list[tuple[int, int]]] = {}
        for last, (size, places) in self.automaton.iter(body):
            for n, at in places:
                item = self.unique[n]
                if n in best and best[n][0] == 0:
                    continue
                most = len(item) // SHARE
                start = last + 1 - size - at
                lo, hi = max(0, start - most), min(len(body), start + len(item) + most)
                if any(a <= lo and hi <= b for a, b in looked.get(n, ())):
                    continue
                # neighbouring hits of a passage share one look
                lo, hi = max(0, lo - most), min(len(body), hi + most)
                looked.setdefault(n, []).append((lo, hi))
                at_once = body.find(item, lo, hi)
                found = (0, at_once + len(item) - lo) if at_once >= 0 else nearest(item, body[lo:hi], most)
                if found and (n not in best or (found[0], lo + found[1]) < best[n]):
                    best[n] = (found[0], lo + found[1])
        return sorted((name, d, end) for n, (d, end) in best.items() for name in self.texts[self.unique[n]])


def blocks(items: DataFrame, key: str = "item_id", text: str = "text") -> list[Column]:
    """Conditions that deal the items to blocks of bounded size."""
    total = items.agg(F.sum(F.length(text))).first()[0] or 0
    n = max(1, -(-total // BLOCK))
    part = F.pmod(F.xxhash64(key, text), F.lit(n))
    return [part == i for i in range(n)]


def with_leaks(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    key: str = "item_id",
    item_text: str = "text",
    out: str = "leaks",
    least: int = 1,
    area: StageArea | None = None,
) -> DataFrame:
    """Add ``out``: an array of (item, distance, end) of the benchmark items that a text holds.

    ``end`` is the end of the passage in the normal form of the text. ``least``: characters of the
    shortest item that takes part. ``area``: where the blocks of a large benchmark write.
    """
    named = items.where(F.col(item_text).isNotNull() & F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.col(item_text).alias("text")
    )
    names = [c for c in df.columns if c != out]
    kind = T.ArrayType(
        T.StructType([T.StructField("item", named.schema["key"].dataType), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())])
    )
    row = F.struct(*names).alias("row")
    parts = blocks(named, "key")
    if len(parts) == 1:
        searched = _searched(df.select(row, F.col(text).alias("text")), named, least, kind)
        return searched.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("leaks").alias(out))
    area = area or StageArea(df.sparkSession)
    digest = F.sha2(F.col(text), 256)
    written = []
    for part in parts:
        found = _searched(df.select(digest.alias("row"), F.col(text).alias("text")), named.where(part), least, kind)
        written.append(area.save(found.where(F.size("leaks") > 0).dropDuplicates(["row"]), "leaks"))
    every = reduce(DataFrame.unionAll, written).groupBy("row").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    joined = df.select(row, digest.alias("digest")).join(every.withColumnRenamed("row", "digest"), "digest", "left")
    leaks = F.coalesce("leaks", F.array().cast(kind)).alias(out)
    return joined.select(*(F.col(f"row.`{c}`").alias(c) for c in names), leaks)


def _searched(rows: DataFrame, items: DataFrame, least: int, kind: T.ArrayType) -> DataFrame:
    """(row, leaks) of (row, text): one pass with a block of items."""
    block = [(r.key, normal(r.text)) for r in items.toLocalIterator()]
    shared = rows.sparkSession.sparkContext.broadcast([(k, x) for k, x in block if len(x) >= max(least, 1)])
    leak = to_arrow_type(kind)

    def run(batches):
        finder = Finder(shared.value)
        for batch in batches:
            found = [[{"item": i, "distance": d, "end": e} for i, d, e in finder.leaks(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, leak)], names=["row", "leaks"])

    return rows.mapInArrow(run, T.StructType([rows.schema["row"], T.StructField("leaks", kind)]))
