"""Line dedup: content-defined chunks of lines that repeat anywhere are kept once.

A line of ``LETTERS`` letters is a chunk of its own. Among the shorter lines between, a rolling hash
over the hashes of ``WINDOW`` lines ends a chunk of two or more where it is 0 modulo ``SPREAD``; a
single short line joins the short lines before it, else the long line after it, so that a bracket or
an empty line is no chunk. The same lines thus give the same chunks wherever they stand. A chunk that
occurs more than once, in one document or in several, stays where it occurs first (smallest id, then
place) and is removed elsewhere, after its bytes were compared with the first occurrence.

Not found: a long line with a single short line before it that differs, and short lines at the ends of
a repeated run whose chunks reach beyond it.

Spark first groups numbers only: hash, id and place of each chunk, with minima formed before the
shuffle. A bitmap of the repeated hashes, of ``BITMAP`` bits whatever the corpus, then tells the scan
which chunks' bytes to write down for the comparison; a full bitmap would only write more. The bytes
meet on their hash in a join of written tables, so that a chunk with very many copies is split at
run time. Texts are shuffled once, to meet the places to remove.

Cases: a null text stays null and an empty one empty; a document may lose all of its lines and then
has an empty text; rows without an id are left as they are and take no part; rows that repeat an id
are one document with several texts: equal chunks at the same place of them are one occurrence;
other columns are kept, ``n_chars`` is not touched here.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.bits import BITMAP, bitmap
from cohortloom.sources.stages import StageArea

LETTERS = 30  # letters of a line that is a chunk of its own
WINDOW = 2  # lines of the rolling hash over shorter lines
SPREAD = 2  # lines of a chunk of these beyond the second, on average
LEAST = 1  # lines of a chunk that can be removed
LONG = re.compile(r"(?:[\W\d_]*+[^\W\d_]){%d}" % LETTERS)
STEP = 0x9E3779B97F4A7C15
FULL = (1 << 64) - 1


def chunks(text: str | None) -> list[list[str]]:
    """The lines of a text, chunk by chunk."""
    if not text:
        return []
    out: list[list[str]] = []
    short: list[str] = []  # lines that no chunk has yet
    window: list[int] = []
    after_short = False  # the last chunk is of short lines that stand directly before

    def single() -> bool:
        if len(short) == 1 and after_short:
            out[-1].append(short.pop())
        return len(short) == 1

    for line in text.split("\n"):
        if LONG.match(line):
            if single():
                out.append([short.pop(), line])
            else:
                out += [short, [line]] if short else [[line]]
            short, window, after_short = [], [], False
            continue
        short.append(line)
        window = [*window[-WINDOW + 1 :], xxhash.xxh3_64_intdigest(line)]
        rolling = 0
        for h in window:
            rolling = (rolling * STEP + h) & FULL
        if len(short) >= 2 and ((rolling * STEP) & FULL) >> 40 & (SPREAD - 1) == 0:
            out.append(short)
            short, after_short = [], True
    if single() and out:
        out[-1].append(short.pop())
    return [*out, short] if short else out


def chunk_hash(lines: list[str]) -> int:
    """Signed."""
    return int(np.uint64(xxhash.xxh3_64_intdigest("\n".join(lines))).astype(np.int64))


def _numbered(docs: DataFrame) -> DataFrame:
    """(id, place, hash) of every chunk."""

    def run(batches):
        for batch in batches:
            ids, places, hashes = [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i, lines in enumerate(chunks(text)):
                    if len(lines) >= LEAST:
                        ids.append(name)
                        places.append(i)
                        hashes.append(chunk_hash(lines))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(places, pa.int32()), pa.array(hashes, pa.int64())],
                names=["id", "place", "hash"],
            )

    return docs.mapInArrow(run, T.StructType([docs.schema["id"], T.StructField("place", T.IntegerType()), T.StructField("hash", T.LongType())]))


def _written(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(hash, id, place, body) of the chunks whose bit is set."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = T.StructType(
        [T.StructField("hash", T.LongType()), docs.schema["id"], T.StructField("place", T.IntegerType()), T.StructField("body", T.StringType())]
    )

    def run(batches):
        bits = shared.value
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                rows = []
                for i, lines in enumerate(chunks(text)):
                    if len(lines) >= LEAST:
                        h = chunk_hash(lines)
                        spot = h % BITMAP
                        if bits[spot >> 3] >> (7 - (spot & 7)) & 1:
                            rows.append((h, i, "\n".join(lines)))
                if rows:
                    h, i, body = zip(*rows, strict=True)
                    same = pa.array([name.as_py()] * len(rows), batch.schema.field(0).type)
                    yield pa.RecordBatch.from_arrays([pa.array(h), same, pa.array(i, pa.int32()), pa.array(body)], names=kind.names)

    return docs.mapInArrow(run, kind)


def repeated_chunks(df: DataFrame, area: StageArea, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(id, chunks): places and hashes of the chunks to remove from each document that has any."""
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    numbers = _numbered(docs)
    first = numbers.groupBy("hash").agg(F.min(F.struct("id", "place")).alias("first"), F.count("*").alias("n"))
    repeated = area.save(first.where("n > 1").select("hash", "first"), "repeated")
    bodies = area.save(_written(docs, bitmap(repeated)), "bodies")
    # Written tables: a hash with very many copies can be split.
    where = repeated.select("hash", "first.id", "first.place")
    one = bodies.join(where.hint("merge"), ["hash", "id", "place"]).groupBy("hash", "id", "place").agg(F.min("body").alias("kept"))
    kept = area.save(one.select("hash", F.struct("id", "place").alias("first"), "kept"), "kept")
    same = bodies.join(kept.hint("merge"), "hash").where((F.col("body") == F.col("kept")) & (F.struct("id", "place") != F.col("first")))
    gone = area.save(same.select("id", F.struct("place", "hash").alias("chunk")), "gone")
    return area.save(gone.groupBy("id").agg(F.collect_set("chunk").alias("chunks")), "removed")


def remove_repeats(
    df: DataFrame, area: StageArea, text: str = "text", key: str = "doc_id", counts: tuple[str, str] | None = ("n_lines", "n_removed")
) -> DataFrame:
    """``df`` with the repeated chunks taken out of its text, and with ``counts`` its lines before and
    how many of them were removed."""
    gone = repeated_chunks(df, area, text, key)
    names = [c for c in df.columns if c not in (counts or ())]
    named = df.select(F.struct(*names).alias("row"), F.col(text).alias("text"), F.col(key).alias("id"))
    # The list may be small or not; the plan is the same at every size.
    rows = named.join(gone.hint("merge"), "id", "left").select("row", "text", "chunks")
    schema = T.StructType(
        [T.StructField("row", rows.schema["row"].dataType), T.StructField("kept", T.StringType()),
         T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]
    )

    def run(batches):
        for batch in batches:
            kept, n, less = [], [], []
            for body, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                n.append(body.count("\n") + 1 if body else 0)
                out = {(g["place"], g["hash"]) for g in gone or ()}
                left = [x for i, x in enumerate(chunks(body)) if (i, chunk_hash(x)) not in out] if out else None
                kept.append(body if left is None else "\n".join(line for x in left for line in x))
                less.append(0 if left is None else n[-1] - sum(map(len, left)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(less, pa.int64())], names=schema.names
            )

    done = rows.mapInArrow(run, schema)
    back = [F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in names]
    sizes = [F.col(c).alias(out) for c, out in zip(("n_lines", "n_removed"), counts or (), strict=False)]
    return done.select(*back, *sizes)
