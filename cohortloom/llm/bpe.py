"""Byte-level BPE: DuckDB recursive queries inside the tasks of a Spark scan.

Spark splits each text by the tokenizer's pattern (a JVM expression) and streams the pieces as Arrow
batches. A task cuts the distinct pieces where no token of the vocabulary can lie across, lays the
bytes of the distinct parts out as rows ``(word, pos, tok)`` and lets a recursive query join neighbouring
rows with the merge table and contract the pair of minimum rank of every part, until none has a pair
left. Equal pairs that do not overlap are contracted in one round, from the left, unless the vocabulary
has a pair of lower rank that their product could form: then only the leftmost is. The ids of documents
are put together from those of their words; another query joins them with the vocabulary, and an ordered
aggregation decodes them.

No shuffle, nothing grows with the corpus but the result: the vocabulary and its merge table are the
only broadcast (their size is that of the rank file). A task has its own database, closed at its end:
``QUERY_BYTES`` of parts in a query (a longer part is a query of its own) and the rows of ``ROUNDS``
rounds. Contracted words stay in a worker for its next tasks, ``CACHE_BYTES`` of them with their ids.

The classes of the pattern follow the Unicode tables of the tokenizer library, not those of the JVM:
code points in which the two differ are named in the expression.

Cases: a null text is an empty text; an empty text has no ids and decodes to no bytes; repeated
rows are encoded like any other; other columns, whatever their names, are not touched; a word may be
as long as its text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_BYTES = 1 << 20  # of the parts of one recursive query
ROUNDS = 8  # of one recursive query, which keeps the rows of all of its rounds
CACHE_BYTES = 48 << 20  # of words and their ids that a worker keeps
SLICE_WORDS = 500_000  # words of documents that are gathered together
BLOCK = 0x800  # code points that are asked about together; the surrogates are one block

CONTRACT = f"""
WITH RECURSIVE t(step, word, pos, tok) AS (
    SELECT 0, word, pos, tok FROM base
  UNION ALL (
    WITH pairs AS (
        SELECT word, pos, tok, row_number() OVER w AS nth, CASE WHEN lead(word) OVER w = word THEN lead(tok) OVER w END AS nxt
        FROM t WHERE step < {ROUNDS} WINDOW w AS (ORDER BY word, pos)
    ),
    ranked AS (
        SELECT word, pos, tok, nth, (m.rank::BIGINT << 1) + m.alone::BIGINT AS rank
        FROM pairs LEFT JOIN merges m ON m.a = tok AND m.b = nxt
    ),
    best AS (
        SELECT word, min((rank << 30) + nth) AS best, min(nth) AS start FROM ranked GROUP BY word HAVING best IS NOT NULL
    ),
    -- Places are counted from the last row before this one that does not start the best pair: odd ones
    -- take their neighbour in, even ones are taken in. Of a pair that goes alone only the first counts.
    placed AS (
        SELECT r.word, pos, tok, nth, best >> 31 AS made, rank IS NOT DISTINCT FROM best >> 30 AS hit,
               (best >> 30) & 1 = 1 AS alone, best & {(1 << 30) - 1} AS first,
               nth - coalesce(max(CASE WHEN rank IS DISTINCT FROM best >> 30 THEN nth END) OVER (
                   PARTITION BY r.word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                   start - 1) AS place
        FROM ranked r JOIN best USING (word)
    )
    SELECT (SELECT max(step) FROM t) + 1, word, pos,
           CASE WHEN hit AND CASE WHEN alone THEN nth = first ELSE place % 2 = 1 END THEN made::INTEGER ELSE tok END
    FROM placed WHERE CASE WHEN alone THEN nth <> first + 1 ELSE place % 2 = 1 END
  )
),
last AS (SELECT word, max(step) AS step FROM t GROUP BY word)
SELECT step, word, pos, tok FROM t JOIN last USING (word, step)
"""

DECODE = "SELECT list(vocab.raw ORDER BY pos) AS raw FROM ids JOIN vocab ON vocab.id = ids.tok"


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of a byte-level tokenizer and the pattern that splits text before the merges."""

    tokens: tuple[bytes, ...]  # by position in ``ids``
    ids: tuple[int, ...]
    pattern: str

    @classmethod
    def read(cls, path: str, pattern: str) -> Vocabulary:
        """A rank file: lines of a base64 token and its rank."""
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls(tuple(base64.b64decode(t) for t, _ in pairs), tuple(int(r) for _, r in pairs), pattern)

    def merges(self) -> pa.Table:
        """Every pair of tokens whose bytes together are a token, with that token's id.

        ``alone``: a neighbour of the product could make a pair of a lower rank with it, which then comes
        before the next equal pair. That takes a neighbour whose pair with the product's nearer part is
        not of a lower rank itself, or it would have come first.
        """
        ranks = dict(zip(self.tokens, self.ids, strict=True))
        rows = [
            (ranks[t[:i]], ranks[t[i:]], r, t[:i], t[i:])
            for t, r in ranks.items()
            for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks
        ]
        after, before = {}, {}  # neighbours that make a lower rank with a token
        for a, b, r, x, y in rows:
            if r < a:
                after.setdefault(a, []).append(y)
            if r < b:
                before.setdefault(b, []).append(x)
        alone = {
            r
            for _, _, r, x, y in rows
            if any(ranks.get(y + z, r) >= r for z in after.get(r, ())) or any(ranks.get(z + x, r) >= r for z in before.get(r, ()))
        }
        a, b, r = np.array([row[:3] for row in rows], dtype=np.int32).reshape(-1, 3).T
        return pa.table({"a": a, "b": b, "rank": r, "alone": np.isin(r, np.array(sorted(alone), dtype=np.int32))})

    def shipped(self) -> tuple[bytes, bytes]:
        """Vocabulary and merge table as Arrow streams, for a broadcast."""
        vocab = pa.table({"id": pa.array(self.ids, pa.int32()), "raw": pa.array(self.tokens, pa.binary())})
        return tuple(_stream(x) for x in (vocab, self.merges()))


def _stream(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _ranges(points: np.ndarray) -> str:
    """Ascending code points as the inside of a class of a JVM expression."""
    parts = np.split(points, np.flatnonzero(np.diff(points) > 1) + 1)
    return "".join(f"\\x{{{p[0]:X}}}-\\x{{{p[-1]:X}}}" for p in parts)


def _points(text: str) -> np.ndarray:
    return np.unique(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32))


def jvm_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern for the JVM, its classes those of the tokenizer library.

    Both engines are asked which of all code points are in a class; only those come back from the JVM. Those
    that it lacks are added behind one comparison with the first of them, those that it has too many are
    taken away.
    """
    blocks = ["".join(map(chr, range(i, i + BLOCK))) for i in range(0, 0x110000, BLOCK) if i != 0xD800]
    kinds = sorted(set(re.findall(r"\\p\{\w+\}|\\s", pattern)))
    rows = spark.createDataFrame([(b,) for b in blocks], "block string")
    inside = rows.select(*(F.regexp_replace("block", f"(?U)[^{k}]", "") for k in kinds)).collect()
    single = {bytes([b]): b for b in range(256)}
    for at, kind in enumerate(kinds):
        jvm = _points("".join(row[at] for row in inside))
        probe = tiktoken.Encoding("probe", pat_str=kind, mergeable_ranks=single, special_tokens={})
        library = _points(b"".join(bytes(probe.encode_ordinary(b)) for b in blocks).decode())
        own = kind
        if len(lacks := np.setdiff1d(library, jvm)):
            own = f"[{own}[\\x{{{lacks[0]:X}}}-\\x{{10FFFF}}&&[{_ranges(lacks)}]]]"
        if len(more := np.setdiff1d(jvm, library)):
            own = f"[{own}&&[^{_ranges(more)}]]"
        if own != kind:
            pattern = pattern.replace(kind, own)
            if kind == r"\s":
                pattern = pattern.replace(r"\S", f"[^{own}]")
    return f"(?U){pattern}"


def _starts(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], ends[:-1]])


def _gather(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``values`` named by ``at``, end to end, and where each of them ends."""
    first = _starts(ends)[at] if len(ends) else np.zeros(0, np.int64)
    length = ends[at] - first if len(ends) else first
    stops = np.cumsum(length)
    place = np.arange(stops[-1] if len(stops) else 0) + np.repeat(first - (stops - length), length)
    return values[place], stops


@dataclass
class Known:
    """Contracted words, the first ones first: their ids end to end, and where each word's end."""

    words: pa.Array
    ids: np.ndarray
    ends: np.ndarray

    @classmethod
    def none(cls) -> Known:
        return cls(pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(0, np.int64))

    def size(self) -> int:
        return self.words.nbytes + self.ids.nbytes + self.ends.nbytes

    def add(self, words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> None:
        self.ends = np.concatenate([self.ends, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, ids])
        self.words = pa.concat_arrays([self.words, words])


_kept: dict[int, Known] = {}


class Contractor:
    """One task's database, and the words that its worker has contracted."""

    def __init__(self, shipped: tuple[bytes, bytes]):
        self.vocabulary = hash(shipped)
        vocab, merges = (pa.ipc.open_stream(x).read_all() for x in shipped)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "350MB", "temp_directory": ""})
        self.db.register("vocab_in", vocab)
        self.db.register("merges_in", merges)
        self.db.execute("CREATE TABLE vocab AS FROM vocab_in; CREATE TABLE merges AS FROM merges_in")
        self.db.unregister("vocab_in")
        self.db.unregister("merges_in")
        tokens = vocab["raw"].to_pylist()
        self.ids = dict(zip(tokens, vocab["id"].to_pylist(), strict=True))
        self.first = np.array([self.ids.get(bytes([b]), -1) for b in range(256)], dtype=np.int32)
        if (self.first < 0).any():
            raise ValueError("a byte-level vocabulary has every single byte")
        # Which two bytes are a token, and which three bytes are in one.
        self.two = np.zeros(1 << 16, dtype=bool)
        self.two[[t[0] << 8 | t[1] for t in tokens if len(t) == 2]] = True
        raw = np.frombuffer(b"".join(tokens), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum([len(t) for t in tokens])
        token = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        inside = np.flatnonzero(np.arange(len(raw)) + 2 < ends[token])
        three = np.zeros(1 << 24, dtype=bool)
        three[raw[inside] << 16 | raw[inside + 1] << 8 | raw[inside + 2]] = True
        self.three = np.packbits(three, bitorder="little")
        self.known = _kept.get(self.vocabulary) or Known.none()

    def close(self) -> None:
        """Free the database; the words stay for the next task of the same vocabulary."""
        self.db.close()
        _kept.clear()
        _kept[self.vocabulary] = self.known

    def lookup(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words, where each known word's end, and the places of ``words``, which are distinct, among them."""
        if self.known.size() > CACHE_BYTES:
            self.known = Known.none()
        # The known words, of which there are far more, are looked up among ``words``.
        found = pc.fill_null(pc.index_in(self.known.words, words), -1).to_numpy()
        at = np.full(len(words), -1)
        at[found[found >= 0]] = np.flatnonzero(found >= 0)
        new = at < 0
        if new.any():
            at[new] = len(self.known.words) + np.arange(new.sum())
            fresh = words.filter(pa.array(new))
            self.known.add(fresh, *self.contract(fresh.to_pylist()))
        return self.known.ids, self.known.ends, at

    def contract(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, end to end, and where each word's end. A word that is a token is that token."""
        whole = [self.ids.get(w) for w in words]
        direct = np.array([i is not None for i in whole], dtype=bool)
        rest = [w for w, i in zip(words, whole, strict=True) if i is None]
        raw, word_ends = b"".join(rest), np.cumsum([len(w) for w in rest], dtype=np.int64)
        cuts = self._cuts(raw, word_ends)
        parts: dict[bytes, int] = {}
        listed = [parts.setdefault(raw[a:b], len(parts)) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False)]
        ids, stops = _gather(*self._by_sql(list(parts)), np.array(listed, dtype=np.int64))
        # Where the ids of each word end, first without the words that are tokens, then with them.
        ends = np.zeros(len(words) + 1, dtype=np.int64)
        ends[1:][~direct] = stops[np.searchsorted(cuts, word_ends)] if len(cuts) else 0
        ends = np.maximum.accumulate(ends)[1:]
        ids = np.insert(ids, ends[direct], [i for i in whole if i is not None])
        return ids, ends + np.cumsum(direct)

    def _cuts(self, text: bytes, word_ends: np.ndarray) -> np.ndarray:
        """The ends of words, and the places that no token can lie across: its two bytes there, or three, are in none."""
        if not text:
            return word_ends
        raw = np.frombuffer(text, dtype=np.uint8).astype(np.int32)
        pair = raw[:-1] << 8 | raw[1:]
        across = self.two[pair]
        triple = pair[:-1] << 8 | raw[2:]
        held = (self.three[triple >> 3] >> (triple & 7) & 1).astype(bool)
        across[1:] |= held
        across[:-1] |= held
        cut = np.append(~across, True)
        cut[word_ends - 1] = True
        return np.flatnonzero(cut) + 1

    def _by_sql(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        length = np.array([len(p) for p in parts], dtype=np.int64)
        group = _starts(np.cumsum(length)) // QUERY_BYTES if len(parts) else length
        done = []
        for some in np.split(np.arange(len(parts)), np.flatnonzero(np.diff(group)) + 1):
            raw = np.frombuffer(b"".join(parts[i] for i in some), dtype=np.uint8)
            n = length[some]
            pos = np.arange(len(raw)) - np.repeat(np.cumsum(n) - n, n)
            base = {"word": np.repeat(some, n).astype(np.int32), "pos": pos.astype(np.int32), "tok": self.first[raw]}
            while len(base["word"]):
                self.db.register("base", pa.table(base))
                got = self.db.execute(CONTRACT).fetchnumpy()
                open_ = np.asarray(got.pop("step")) == ROUNDS
                got = {k: np.asarray(v).astype(np.int32) for k, v in got.items()}
                done.append({k: v[~open_] for k, v in got.items()})
                base = {k: v[open_] for k, v in got.items()}
        if not done:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        word, pos, tok = (np.concatenate([d[k] for d in done]) for k in ("word", "pos", "tok"))
        return tok[np.lexsort((pos, word))], np.cumsum(np.bincount(word, minlength=len(parts)))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each list of ids; ``ends``: where each list ends."""
        self.db.register("ids", pa.table({"pos": np.arange(len(ids)), "tok": ids}))
        raw = self.db.sql(DECODE).to_arrow_table()["raw"].combine_chunks().flatten().cast(pa.binary())
        return pc.binary_join(pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), raw), b"")

    def check(self, ids: np.ndarray) -> None:
        unknown = set(np.unique(ids).tolist()) - set(self.ids.values())
        if unknown:
            raise ValueError(f"ids outside the vocabulary: {sorted(unknown)[:5]}")


OUTPUTS = {"token_ids": T.ArrayType(T.IntegerType()), "ids_text": T.StringType(), "decoded": T.BinaryType()}


def encode(df: DataFrame, vocab: Vocabulary, text: str = "text", keep: tuple[str, ...] = (), outputs: tuple[str, ...] = tuple(OUTPUTS)) -> DataFrame:
    """Encode whole texts and decode the ids again.

    Columns: those of ``keep``, ``n_tokens``, and of ``outputs``: ``token_ids`` (array of int), ``ids_text``
    (decimal ids joined by one space), ``decoded`` (binary, from the ids).
    """
    shared = df.sparkSession.sparkContext.broadcast(vocab.shipped())
    pattern = jvm_pattern(df.sparkSession, vocab.pattern)
    split = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(0))
    pieces = df.select(F.struct(*keep).alias("row") if keep else F.lit(True).alias("row"), split.alias("words"))
    schema = T.StructType([T.StructField("row", pieces.schema["row"].dataType), T.StructField("n_tokens", T.LongType())])
    for name in outputs:
        schema = schema.add(name, OUTPUTS[name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Contractor(shared.value)) as contractor:
            for batch in batches:
                n = np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))
                at = 0
                while at < len(batch):  # at least one document, then as many as fit
                    before = n[at - 1] if at else 0
                    end = max(at + 1, int(np.searchsorted(n, before + SLICE_WORDS, side="right")))
                    some = batch.slice(at, end - at)
                    columns = _documents(contractor, some.column(1), outputs)
                    yield pa.RecordBatch.from_arrays([some.column(0), *columns], names=schema.names)
                    at = end

    out = pieces.mapInArrow(run, schema)
    rest = [c for c in schema.names if c != "row"]
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in keep), *rest)


def _documents(contractor: Contractor, lists: pa.ListArray, outputs: tuple[str, ...]) -> list[pa.Array]:
    flat = lists.flatten().dictionary_encode()
    found, ends, at = contractor.lookup(flat.dictionary.cast(pa.large_binary()))
    ids, stops = _gather(found, ends, at[flat.indices.to_numpy()])
    words = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], stops])[words]  # where the ids of each document end
    length = np.diff(ends, prepend=0)
    out: list[pa.Array] = [pa.array(length, pa.int64())]
    for name in outputs:
        if name == "ids_text":
            numbers = pa.LargeListArray.from_arrays(np.concatenate([[0], ends]), pa.array(ids).cast(pa.string()))
            out.append(pc.binary_join(numbers, " "))
        elif name == "decoded":
            out.append(contractor.decode(ids, ends))
        else:
            out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids)))
    return out


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add ``out``, the bytes of the ids of each row. A null list decodes to no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(vocab.shipped())
    schema = T.StructType([T.StructField("row", df.schema), T.StructField("bytes", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(Contractor(shared.value)) as contractor:
            for batch in batches:
                lists = batch.column(1)
                flat = pc.fill_null(lists.flatten(), -1).to_numpy()
                contractor.check(flat)
                ends = np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([batch.column(0), contractor.decode(flat, ends)], names=["row", "bytes"])

    done = df.select(F.struct("*").alias("row"), F.col(ids).alias("ids")).mapInArrow(run, schema)
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns if c != out), F.col("bytes").alias(out))
