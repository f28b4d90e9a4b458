"""Jaccard join of documents on word n-grams, by adaptive prefixes that must match more than once.

Documents with equal sets of n-grams are one class from the start. The tokens of a class (hashes of its
n-grams) are ordered from rare to frequent. A class of n tokens shares at least o = ceil(t n) of them
with any class at similarity t, so its first n - o + l tokens hold l common ones, and so do its
partner's: two classes are compared only if they share as many prefix tokens as the smaller of their
two l asks for. Each class chooses its own l, the one of least estimated cost: the postings that its
prefix reads, plus the comparisons that they may lead to, which are fewer the more matches are asked for.

1. *Frequencies.* Tokens are dealt to buckets by their hash, packed some thousand to a row; a bucket
   tells how many classes have each of its tokens. Only tokens of two or more classes go back to their
   classes; the others come first in the order and need no posting. A class that shares less than o
   tokens with anyone is done. The number of buckets grows with the input.
2. *Cells.* The classes whose prefixes hold tokens with one smallest class, which are most often the
   tokens of one group of near copies, form a cell. Each class comes into a cell once, with its tokens; a
   large cell is dealt to blocks, and pairs of blocks to tasks. Candidates are counted and compared inside
   the task, which returns a spanning forest of the links that it found, never a row for each pair.
3. *Chains.* Where a cell has so many classes that pairs of blocks would be many, first only near
   neighbours in an order by smallest hashes are compared, and what is linked becomes one component; this
   is repeated with other hashes as long as a round takes away a tenth of the pairs that are left. Then the
   classes of the cell's largest component are compared only with those outside it.

No pair of different components that share a prefix token is left out: classes of one component are
reachable from each other already. Pairs are verified on all the tokens that they share with anyone.
Components are formed by alternating stars. Frequencies and chains only steer the cost. n-grams are told
apart by hashes, of which 56 bits or more decide in a comparison, sets by 64-bit digests.

Cases: A-Z are lower-cased, words are parted by ASCII white space; a text of fewer words is one n-gram;
null, empty and blank texts have an empty set, are linked with nothing, and are their own component; a
row without a key takes part, but names a component only if no other does, so its component can be null;
repeated rows are one class; ties of the order are broken by hashes; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.llm.components import components
from cohortloom.llm.periodic import _mixed, slices
from cohortloom.sources.stages import StageArea

SLICE = 1_000_000  # bytes of text whose n-grams are formed together
DEALT = 500_000  # tokens that a task packs together
BUCKET = 4_000_000  # tokens of a bucket, about
LEAST_BITS = 9  # of the number of buckets
PAYLOAD = 48  # bits of a token beside its bucket
VERIFY = 50  # cost of a comparison, in postings
HOME = 256  # classes of a block of a cell; a task holds two blocks
TOKENS = 1_000_000  # of a block, about
WIDE = 4  # a cell's classes for each of its longest posting, above which its tokens are parted
BLOCK = 8192  # classes of a cell above which it may be chained
NEIGHBOURS = 16  # that a class is compared with in a round of chains
MANY = 32  # pairs left for each class of a cell, above which its classes are chained
STEP = np.uint64(0x9E3779B97F4A7C15)


def gram_sets(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of the distinct n-grams of each text, sorted by row, then hash."""
    parts = [(t or "").encode().lower().split() for t in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    flat = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode()
    word = np.array([xxhash.xxh3_64_intdigest(w) for w in flat.dictionary.to_pylist()], dtype=np.uint64)
    word = word[flat.indices.to_numpy()] if len(flat) else np.zeros(0, dtype=np.uint64)
    row, ends = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes)
    place = np.arange(len(word))
    width = np.minimum(words, sizes)  # of the n-grams of each text
    first = place[place + width[row] <= ends[row]]
    row = row[first]
    gram = width[row].astype(np.uint64)
    for j in range(words):
        at = first + j
        more = j < width[row]
        gram = np.where(more, _mixed(gram * STEP + word[np.minimum(at, len(word) - 1)]), gram)
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])[: len(row)]
    return row[new], gram[new]


def _cuts(row: np.ndarray, rows: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(rows + 1))


def _digests(gram: np.ndarray, cuts: np.ndarray) -> list[int | None]:
    """A number for each set; none for the empty one."""
    raw = gram.tobytes()
    made = [xxhash.xxh3_64_intdigest(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return [d if d is None or d < 1 << 63 else d - (1 << 64) for d in made]


def sets_of(df: DataFrame, words: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n, set): size and digest of every row's set."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    schema = T.StructType([rows.schema["key"], T.StructField("n", T.LongType()), T.StructField("set", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, 1, SLICE):
                row, gram = gram_sets(some.column(1).to_pylist(), words)
                cuts = _cuts(row, len(some))
                arrays = [some.column(0), pa.array(np.diff(cuts)), pa.array(_digests(gram, cuts), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


# --- Frequencies ---------------------------------------------------------------------------------


def _packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The bytes of the values from start to start."""
    offsets = (np.append(starts, len(values)) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _dealt(df: DataFrame, words: int, bits: int, text: str) -> DataFrame:
    """Rows of packed tokens of a bucket, with the sets that they belong to and how many each has."""
    rows = df.select(F.col(f"`{text}`").cast("string").alias("text"))

    def packed(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        sets, gram = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        bucket, payload = _split(gram, bits)
        del gram
        order = np.lexsort((payload, sets, bucket))
        sets, bucket, payload = sets[order], bucket[order], payload[order]
        # A set that stood in several slices counts once.
        new = (sets[1:] != sets[:-1]) | (bucket[1:] != bucket[:-1]) | (payload[1:] != payload[:-1])
        new = np.concatenate([[True], new])
        sets, bucket, payload = sets[new], bucket[new], payload[new]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        group = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (sets[1:] != sets[:-1])]))
        counts = np.diff(np.append(group, len(sets))).astype(np.uint32)
        of = np.searchsorted(group, starts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[starts].astype(np.int64)),
                _packed(sets[group], of),
                _packed(counts, of),
                _packed((payload & np.uint64(0xFFFFFFFF)).astype(np.uint32), starts),
                _packed((payload >> np.uint64(32)).astype(np.uint16), starts),
            ],
            names=["bucket", "sets", "counts", "low", "high"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for some in slices(batch, 0, SLICE):
                row, gram = gram_sets(some.column(0).to_pylist(), words)
                cuts = _cuts(row, len(some))
                digests = np.array([d or 0 for d in _digests(gram, cuts)], dtype=np.int64)
                held.append((np.repeat(digests, np.diff(cuts)), gram))
                size += len(gram)
                if size >= DEALT:
                    yield packed(held)
                    size = 0
        if size:
            yield packed(held)

    return rows.mapInArrow(run, "bucket long, sets binary, counts binary, low binary, high binary")


def _split(gram: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and payload of each hash."""
    rest = 64 - bits
    payload = (gram & np.uint64((1 << rest) - 1)) >> np.uint64(max(rest - PAYLOAD, 0))
    return gram >> np.uint64(rest), payload


def _shared(dealt: DataFrame, bits: int) -> DataFrame:
    """(set, token, df) of the tokens that two or more sets have."""
    rows = dealt.repartition("bucket").sortWithinPartitions("bucket")
    shift = np.uint64(min(PAYLOAD, 64 - bits))

    def found(bucket: int, parts: list[tuple[bytes, ...]]) -> pa.RecordBatch:
        sets, counts, low, high = (
            np.frombuffer(b"".join(p[i] for p in parts), dtype=t) for i, t in enumerate((np.int64, np.uint32, np.uint32, np.uint16))
        )
        sets = np.repeat(sets, counts)
        payload = high.astype(np.uint64) << np.uint64(32) | low
        order = np.lexsort((sets, payload))
        sets, payload = sets[order], payload[order]
        other = np.concatenate([[True], payload[1:] != payload[:-1]])
        new = other | np.concatenate([[True], sets[1:] != sets[:-1]])
        sets, payload, other = sets[new], payload[new], other[new]
        starts = np.flatnonzero(other)
        df = np.diff(np.append(starts, len(sets)))
        df = np.repeat(df, df)
        more = df > 1
        token = (np.uint64(bucket) << shift | payload[more]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(sets[more]), pa.array(token), pa.array(df[more])], names=["set", "token", "df"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for bucket, *part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and parts:
                    yield found(now, parts)
                    parts = []
                now = bucket
                parts.append(part)
        if parts:
            yield found(now, parts)

    return rows.mapInArrow(run, "set long, token long, df long")


def matches_asked(df: np.ndarray, need: int) -> int:
    """The l of least estimated cost for a class.

    ``df``: of its shared tokens, ascending; ``need``: the least overlap with a partner. With l matches
    the prefix holds the first ``len(df) - need + l`` of them. At most the l-th part of the postings'
    entries are classes met l times, each of which is compared.
    """
    asked = np.arange(1, need + 1)
    read = np.cumsum(df - 1)[len(df) - need + asked - 1]
    return int(asked[np.argmin(read * (1 + VERIFY / asked))])


def _live(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(set, n, need, prefix, tokens) of the classes that can have a partner."""
    lists = shared.groupBy("set").agg(F.collect_list(F.struct("df", "token")).alias("held"))
    rows = lists.join(classes.select("set", "n").hint("merge"), "set")
    rows = rows.where(100 * F.size("held") >= percent * F.col("n")).select("set", "n", "held")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(2)
            flat, ends = held.flatten(), np.cumsum(pc.list_value_length(held).to_numpy(zero_copy_only=False))
            df, token = flat.field("df").to_numpy(), flat.field("token").to_numpy()
            needs, prefixes, tokens, start = [], [], [], 0
            for n, end in zip(batch.column(1).to_pylist(), ends.tolist(), strict=True):
                order = np.lexsort((token[start:end], df[start:end]))
                need = -(-percent * n // 100)
                asked = matches_asked(df[start:end][order], need)
                needs.append(asked)
                prefixes.append(token[start:end][order[: end - start - need + asked]])
                tokens.append(np.sort(token[start:end]))
                start = end
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(needs, pa.int64()), pa.array(prefixes, kind), pa.array(tokens, kind)],
                names=["set", "n", "need", "prefix", "tokens"],
            )

    return rows.mapInArrow(run, "set long, n long, need long, prefix array<long>, tokens array<long>")


# --- Candidates ----------------------------------------------------------------------------------

CELL = ["leader", "part"]
LINK = "u long, v long"


def _cells(live: DataFrame, area: StageArea) -> DataFrame:
    """(leader, part, set, m): the classes of each cell and how many tokens they have.

    A cell's tokens are those whose smallest class is ``leader``. Where they belong to many groups, as those
    of a class that shares a little with each of very many others, they are dealt to parts.
    """
    postings = live.select("set", F.size("tokens").alias("m"), F.explode("prefix").alias("token"))
    leaders = postings.groupBy("token").agg(F.min("set").alias("leader"), F.count("*").alias("k")).where("k > 1")
    postings = area.save(postings.join(leaders.hint("merge"), "token").select("leader", "token", "k", "set", "m"), "postings")
    once = postings.groupBy("leader", "set").agg(F.max("k").alias("k"))
    sizes = once.groupBy("leader").agg(F.count("*").alias("c"), F.max("k").alias("k"))
    held = WIDE * F.greatest("k", F.lit(HOME).cast("long"))
    hubs = area.save(sizes.where(F.col("c") > held).select("leader", F.ceil(F.col("c") / held).alias("parts")), "hubs")
    parted = postings.join(hubs, "leader", "left")
    part = F.pmod(F.xxhash64("token"), F.coalesce("parts", F.lit(1).cast("long"))).alias("part")
    return area.save(parted.select("leader", part, "set", "m").distinct(), "cells")


def _close(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _runs(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs of some sizes, end to end, and where each begins among them."""
    begin = np.cumsum(sizes) - sizes
    return np.repeat(starts - begin, sizes) + np.arange(sizes.sum()), begin


def _forest(rows: pa.Table, last: np.ndarray, percent: int) -> pa.RecordBatch:
    """Links of the similarity that connect all classes that any such link connects.

    ``rows``: set, n, need, comp, own, prefix, tokens. A class is compared with those after it, up to the
    place ``last``, of another component and, unless ``own`` is one value, of another ``own``.
    """
    sets, n, need, comp, own = (rows.column(c).to_numpy().copy() for c in ("set", "n", "need", "comp", "own"))
    lists = [rows.column(c).combine_chunks() for c in ("prefix", "tokens")]
    (psize, size), (prefix, tokens) = ([f(x).to_numpy().astype(np.int64) for x in lists] for f in (pc.list_value_length, pc.list_flatten))
    names, token = np.unique(tokens, return_inverse=True)
    prefix = np.searchsorted(names, prefix)
    pstart, start = np.cumsum(psize) - psize, np.cumsum(size) - size
    alone = (own == own[0]).all()
    u, v = [], []
    for at in range(len(sets) - 1):
        after = slice(at + 1, last[at])
        other = comp[after] != comp[at]
        if not other.any():
            continue
        other &= _close(n[after], n[at], percent)
        if not alone:
            other &= own[after] != own[at]
        some = np.flatnonzero(other) + at + 1
        if not len(some):
            continue
        mark = np.zeros(len(names), dtype=bool)
        mark[prefix[pstart[at] : pstart[at] + psize[at]]] = True
        place, begin = _runs(pstart[some], psize[some])
        met = np.add.reduceat(mark[prefix[place]], begin, dtype=np.int64)
        some = some[met >= np.minimum(need[some], need[at])]
        if not len(some):
            continue
        mark[token[start[at] : start[at] + size[at]]] = True
        place, begin = _runs(start[some], size[some])
        common = np.add.reduceat(mark[token[place]], begin, dtype=np.int64)
        some = some[100 * common >= percent * (n[at] + n[some] - common)]
        joined, first = np.unique(comp[some], return_index=True)
        u.append(np.full(len(first), sets[at]))
        v.append(sets[some[first]])
        comp[np.isin(comp, joined)] = comp[at]
    none = np.zeros(0, dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *x])) for x in (u, v)], names=["u", "v"])


ROW = ["set", "n", "need", "comp", "own", "prefix", "tokens"]


def _chained(cells: DataFrame, live: DataFrame, round_no: int, percent: int) -> DataFrame:
    """Links of near neighbours of different components in each cell, cut to ranges of any size.

    The order is by bands of size, and within a band by the smallest hash of a class's tokens, which similar
    classes have in common as often as they share tokens.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent))) if percent < 100 else F.col("n")
    keys = [*CELL, "band", "draw", "set"]
    draw = F.array_min(F.transform("tokens", lambda t: F.xxhash64(t, F.lit(round_no))))
    rows = cells.join(live.hint("merge"), "set").withColumns({"band": band, "draw": draw, "own": F.lit(0).cast("long")})
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select(*CELL, *ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if not len(batch):
                continue
            table = pa.Table.from_batches([batch] if before is None else [*before, batch])
            key = np.stack([table.column(c).to_numpy() for c in CELL])
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            ends = np.append(cuts, len(table))[np.searchsorted(cuts, np.arange(len(table)), side="right")]
            yield _forest(table, np.minimum(ends, np.arange(len(table)) + 1 + NEIGHBOURS), percent)
            before = table.slice(max(len(table) - NEIGHBOURS, 0)).to_batches()

    return rows.mapInArrow(run, LINK)


def _crossed(cells: DataFrame, sizes: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Links of all pairs of classes of different components that meet in a cell, a forest for each task.

    ``sizes``: of the cells that have such pairs. Their classes are dealt to blocks. Those of the largest
    component, if they fill more than one block, meet only the blocks of the others.
    """
    blocks = lambda k, m: F.greatest(F.ceil(F.col(k) / HOME), F.ceil(F.col(m) / TOKENS))
    sizes = sizes.withColumn("a", F.when(blocks("large.c", "large.m") > 1, blocks("large.c", "large.m")).otherwise(0))
    sizes = sizes.withColumn("k", F.when(F.col("a") > 0, F.col("k") - F.col("large.c")).otherwise(F.col("k")))
    sizes = sizes.withColumn("m", F.when(F.col("a") > 0, F.col("m") - F.col("large.m")).otherwise(F.col("m")))
    sizes = sizes.select(*CELL, "a", blocks("k", "m").alias("b"), F.col("large.comp").alias("main"))
    rows = cells.join(sizes.hint("merge"), CELL)
    main, draw = (F.col("a") > 0) & (F.col("comp") == F.col("main")), F.xxhash64("set")
    rows = rows.withColumn("own", F.when(main, F.pmod(draw, "a")).otherwise(F.col("a") + F.pmod(draw, "b")))
    other = F.explode(F.sequence(F.when(main, F.col("a")).otherwise(F.lit(0)), F.col("a") + F.col("b") - 1)).alias("other")
    rows = rows.select(*CELL, "set", "comp", "own", other)
    rows = rows.select(*CELL, "set", "comp", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    keys = [*CELL, "i", "j"]
    dealt = rows.join(live.hint("merge"), "set").select(*keys, *ROW)
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "n", "set")

    def forest(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts)
        n = table.column("n").to_numpy()  # ascending
        return _forest(table, np.searchsorted(n, 100 * n // percent, side="right"), percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy() for c in range(4)])
            cuts = (np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist()
            found = []
            for start, stop in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if stop == start:
                    continue
                if key[:, start].tolist() != cell and held:
                    found.append(forest(held))
                    held = []
                cell = key[:, start].tolist()
                held.append(batch.slice(start, stop - start))
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()
        if held:
            yield forest(held)

    return dealt.mapInArrow(run, LINK)


def links_of(live: DataFrame, percent: int, area: StageArea) -> DataFrame:
    """(node, root) of linked classes: those reachable over pairs of the similarity."""
    cells = _cells(live, area)
    roots, round_no, before = None, 0, None
    while True:
        if roots is None:
            now = cells.withColumn("comp", F.col("set"))
        else:
            told = roots.select(F.col("node").alias("set"), F.col("root").alias("comp"))
            now = cells.join(told.hint("merge"), "set", "left").withColumn("comp", F.coalesce("comp", "set"))
            now = area.save(now.select(*cells.columns, "comp"), "named")
        parts = now.groupBy(*CELL, "comp").agg(F.count("*").alias("c"), F.sum("m").alias("m"))
        sizes = parts.groupBy(*CELL).agg(
            F.sum("c").alias("k"),
            F.sum("m").alias("m"),
            F.sum(F.col("c") * F.col("c")).alias("own"),
            F.max(F.struct("c", "m", "comp")).alias("large"),
        )
        sizes = area.save(sizes.where("own < k * k"), "sizes")
        pairs = F.expr("(k * k - own) div 2")
        many = sizes.where((F.col("k") > BLOCK) & (pairs > MANY * F.col("k")))
        left = many.agg(F.coalesce(F.sum(pairs), F.lit(0))).first()[0]
        last = left == 0 or (before is not None and 10 * left > 9 * before)
        if last:
            new = _crossed(now, sizes, live, percent)
        else:
            new = _chained(now.join(many.select(*CELL).hint("merge"), CELL, "left_semi"), live, round_no, percent)
        new = area.save(new, "links")
        if roots is not None:  # the links so far, as stars
            new = new.unionAll(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))
        roots = area.save(components(new, area), "roots")
        if last:
            return roots
        round_no, before = round_no + 1, left


def near_duplicates(
    df: DataFrame, words: int, percent: int, area: StageArea, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """(key, n, component): the smallest key among the rows reachable over links of the similarity."""
    docs = area.save(sets_of(df, words, text, key), "sets")
    classes = docs.where("set IS NOT NULL").groupBy("set").agg(F.min("key").alias("first"), F.max("n").alias("n"))
    classes = area.save(classes, "classes")
    total = docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bits = max(LEAST_BITS, int(total // BUCKET).bit_length())
    live = area.save(_live(_shared(_dealt(df, words, bits, text), bits), classes, percent), "live")
    roots = links_of(live, percent, area).withColumnRenamed("node", "set")
    rooted = classes.join(roots.hint("merge"), "set", "left").select("set", "first", F.coalesce("root", "set").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least.hint("merge"), "root").select("set", "component")
    joined = docs.join(named.hint("merge"), "set", "left")
    component = F.when(F.col("set").isNull(), F.col("key")).otherwise(F.col("component"))
    return joined.select(F.col("key").alias(key), "n", component.alias("component"))
