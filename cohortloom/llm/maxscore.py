"""Exact top-k inner products of a query set against all vectors, by MaxScore over shards.

Vectors become whole numbers. A term is a dimension with a sign: the posting list of (d, +) has the
vectors whose component d is positive, that of (d, -) those where it is negative. For a query the
terms are those of its own signs; only they can add to a score, at most |q_d| times the list's
largest component. Everything else can only lower it.

Spark deals the rows to shards and the queries to blocks, both of bounded size, and joins every
block with every shard by shard number (a stated query set against all rows, in blocks). In a shard
a few list heads give the threshold; the lists with the smallest bounds whose sum stays below it are
non-essential. The essential lists are traversed, the other dimensions are probed group by group,
and a vector is dropped as soon as its score and the bounds that are left cannot reach the threshold.
The shards' best are merged with a window.

Cases: vectors that are null or hold null or non-finite components take no part; shorter vectors
count as padded with zeros; rows that repeat an id and vector count once; a query's own id is never
its candidate; ties go to the smaller id; fewer candidates than k give all; an empty table gives an
empty result. Null ids take no part. Scores are
64-bit whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 16_384  # vectors
BLOCK = 1_024  # queries
HEADS = 8  # entries of a list's head that set the first threshold
GROUP = 8  # dimensions probed together


def scaled(vector: Column, scale: int) -> Column:
    """Whole numbers floor(scale * x); null if the vector takes no part."""
    x = F.transform(vector, lambda v: v.cast("double"))
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(odd, F.lit(True)), F.transform(x, lambda v: F.floor(v * scale)))


def top_k(rows: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "ints") -> DataFrame:
    """(query_id, rank, <key>, score) for every row that ``is_query`` holds for, against all rows."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    usable = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    named = usable.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), is_query.alias("q"))
    shards = _packed(named.select("id", "v"), SHARD, parts)
    blocks = _packed(named.where("q").select("id", "v"), BLOCK, 1).drop("part")
    dealt = blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    pairs = shards.select("part", F.struct("n", "ids", "data").alias("shard")).join(
        dealt.select("part", F.struct("n", "ids", "data").alias("block")), "part"
    )

    def run(batches):
        for batch in batches:
            for shard, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, x = _unpacked(shard)
                queries, q = _unpacked(block)
                yield _search(ids, x, queries, q, k)

    found = pairs.select("shard", "block").mapInArrow(run, "query_id long, vec_id long, score long").distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(key), "score")


def _packed(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows of at most ``size`` vectors as one matrix; ``part`` deals them out evenly."""

    def run(batches):
        n = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, len(batch), size):
                some = batch.slice(at, size)
                yield _pack(some.column(0).to_numpy(zero_copy_only=False), some.column(1).to_pylist(), n % parts)
                n += 1

    return rows.mapInArrow(run, "part int, n int, ids binary, data binary")


def _pack(ids: np.ndarray, vectors: list[list[int]], part: int) -> pa.RecordBatch:
    width = max((len(v) for v in vectors), default=0)
    if all(len(v) == width for v in vectors):
        x = np.array(vectors, dtype=np.int64).reshape(len(vectors), width)
    else:
        x = np.zeros((len(vectors), width), dtype=np.int64)
        for i, v in enumerate(vectors):
            x[i, : len(v)] = v
    whole = np.unique(np.concatenate([ids.astype(np.int64)[:, None], x], axis=1), axis=0)
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array([part], pa.int32()),
            "n": pa.array([len(whole)], pa.int32()),
            "ids": pa.array([whole[:, 0].tobytes()], pa.binary()),
            "data": pa.array([np.ascontiguousarray(whole[:, 1:]).tobytes()], pa.binary()),
        }
    )


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    return ids, np.frombuffer(row["data"], dtype=np.int64).reshape(row["n"], -1)


def _search(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int) -> pa.RecordBatch:
    width = max(x.shape[1], q.shape[1])
    x, q = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, q))
    by_term = np.ascontiguousarray(x.T)
    top, low = np.maximum(x.max(axis=0, initial=0), 0), np.minimum(x.min(axis=0, initial=0), 0)
    heads = np.argsort(by_term, axis=1)  # both ends of a row are the heads of its two lists
    out: list[list[np.ndarray]] = [[], [], []]
    for name, one in zip(queries.tolist(), q, strict=True):
        at, score = max_score(ids, x, by_term, heads, np.where(one > 0, one * top, one * low), one, name, k)
        out[0].append(np.full(len(at), name))
        out[1].append(ids[at])
        out[2].append(score)
    arrays = [pa.array(np.concatenate([np.zeros(0, np.int64), *o]), pa.int64()) for o in out]
    return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])


def max_score(ids, x, by_term, heads, bound, q, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the k best vectors of a shard; ``bound`` has the most each term can add."""
    order = np.argsort(-bound, kind="stable")
    first = order[:4]
    seeds = np.unique(np.where((q[first] > 0)[:, None], heads[first, -HEADS:], heads[first, :HEADS]))
    seeds = seeds[ids[seeds] != own]
    floor = None
    if len(seeds) >= k:
        floor = np.partition(x[seeds] @ q, len(seeds) - k)[len(seeds) - k]
    rest = np.concatenate([np.cumsum(bound[order][::-1])[::-1], [0]])  # what terms from here on can add
    essential = len(order)
    if floor is not None and floor > 0:
        essential = int(np.argmax(rest < floor))  # from here on, together below the threshold
        lists = order[:essential]
        posted = ((by_term[lists] * np.sign(q[lists])[:, None]) > 0).any(axis=0)
        at = np.flatnonzero(posted & (ids != own))
    else:
        at = np.flatnonzero(ids != own)
    score = np.zeros(len(at), dtype=np.int64)
    for start in range(0, len(order), GROUP):
        dims = order[start : start + GROUP]
        for d in dims:
            score += by_term[d][at] * q[d]
        if floor is not None:
            stay = score + rest[min(start + GROUP, len(order))] >= floor
            if not stay.all():
                at, score = at[stay], score[stay]
    best = np.lexsort((ids[at], -score))[:k]
    return at[best], score[best]
