"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the distinct byte n-grams of its lower-cased form, hashed to
``2 ** HASH_BITS`` buckets. Over all labelled training rows Spark counts in how many texts of either
label a bucket occurs; a bucket's ratio is the logarithm of its smoothed share of label 1 over that
of label 0. Buckets that occur in fewer than ``MIN_ROWS`` texts, or with less than ``MIN_EVIDENCE`` for a
link to the label, or with a ratio below ``MIN_RATIO``, say little and are left out. A logistic regression is then fitted
over the ratios of the buckets present; its intercept is set so that 0.5 parts the labels best, each
with its share of all training rows.

The classifier is learned from a sample of bounded size: about ``LEARN`` rows of each label for the
ratios and ``SAMPLE`` of each for the regression, drawn by a hash of the id. The drawn labels are
therefore a broadcast of bounded size, and no text is shuffled. Counts leave a task as at most one
row per bucket. The model is one vector of ``2 ** HASH_BITS`` weights, whatever the size of the
corpus. Scoring is one pass without a shuffle.

Cases: a null text is an empty text, scored by the intercept; rows whose label is null are not
learned from; repeated rows count as often as they occur; a training set without both labels gives
its label share to every text (0 if there is no training row).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HASH_BITS = 20
SIZES = (4, 5, 6)  # bytes of an n-gram
MIN_ROWS = 3
MIN_EVIDENCE = 12.0  # likelihood ratio statistic
MIN_RATIO = 1.0  # of a bucket, as a logarithm; weaker ones follow the lengths of the texts
SMOOTHING = 0.5
LEARN = 6_000  # training rows of each label for the ratios
SAMPLE = 3_000  # of these, rows of each label for the regression
PENALTY = 1e-3
ROUNDS = 300
BLANKS = bytes(32 if c < 33 else c for c in range(256))


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # of each bucket
    intercept: float

    def score(self, text: str | None) -> float:
        found = hashed(text)
        found = np.unique(found[self.weights[found] != 0])
        z = self.intercept + float(self.weights[found].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def scratch() -> np.ndarray:
    return np.zeros(1 << HASH_BITS, dtype=np.int32)


def hashed(text: str | None) -> np.ndarray:
    """The bucket of every n-gram of a text."""
    raw = np.frombuffer(b" " + (text or "").lower().encode().translate(BLANKS) + b" ", dtype=np.uint8).astype(np.uint64)
    parts = [np.zeros(0, dtype=np.int32)]
    code = raw
    for n in range(2, max(SIZES) + 1):
        if len(raw) < n:
            break
        code = (code[:-1] << np.uint64(8)) | raw[n - 1 :]
        if n in SIZES:
            mixed = (code + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
            parts.append((mixed >> np.uint64(64 - HASH_BITS)).astype(np.int32))
    return np.concatenate(parts)


def buckets(text: str | None, seen: np.ndarray) -> np.ndarray:
    """Distinct buckets of a text's n-grams. ``seen`` is scratch space."""
    found = hashed(text)
    place = np.arange(len(found), dtype=np.int32)
    seen[found] = place  # of equal buckets, the last one stays
    return found[seen[found] == place]


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """Learn from the rows of ``labels`` (key, 0 or 1) and the texts they name."""
    rows = labels.where(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    shares = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    zeros, ones = shares.get(0, 0), shares.get(1, 0)
    weights = np.zeros(1 << HASH_BITS, dtype=np.float32)
    share = ones / max(1, zeros + ones)
    prior = Model(weights, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    if not zeros or not ones:
        return prior
    # About 2 * LEARN small rows, whatever the number of labels.
    chosen = _thinned(rows, shares, LEARN)
    drawn = {r.label: r.n for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    most = [drawn.get(0, 0), drawn.get(1, 0)]
    learn = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    # Only buckets that tell the labels apart reach the driver.
    ratio = F.ln((F.col("n1") + SMOOTHING) / (most[1] + 2 * SMOOTHING)) - F.ln((F.col("n0") + SMOOTHING) / (most[0] + 2 * SMOOTHING))
    told = _counts(learn).where((F.col("n0") + F.col("n1") >= MIN_ROWS) & (_evidence(*most) >= MIN_EVIDENCE))
    table = told.select("bucket", ratio.alias("ratio")).where(F.abs("ratio") >= MIN_RATIO).toArrow()
    scale = np.zeros(1 << HASH_BITS, dtype=np.float32)
    scale[table.column("bucket").to_numpy()] = table.column("ratio").to_numpy()
    sample = _present(_thinned(learn, drawn, SAMPLE), scale).toArrow()
    if not len(sample):  # labels of no text
        return prior
    y, found = sample.column("label").to_numpy(), sample.column("found").combine_chunks()
    size = pc.list_value_length(found).to_numpy(zero_copy_only=False)
    cols = found.flatten().to_numpy()
    beta = _regress(cols, size, y, scale)
    weights = (beta * scale).astype(np.float32)
    z = np.bincount(np.repeat(np.arange(len(y)), size), weights[cols], minlength=len(y))
    return Model(weights, -_boundary(z, y, zeros, ones))


def _boundary(z: np.ndarray, y: np.ndarray, zeros: int, ones: int) -> float:
    """The value that parts the labels of the sample best, each label with its share of all training
    rows; of equally good ranges the middle of the widest, where it is positive."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    cost = np.where(y == 1, ones / max(1, y.sum()), -zeros / max(1, (y == 0).sum()))
    wrong = np.concatenate([[0.0], np.cumsum(cost)])  # label 1 below, less label 0 below
    edges = np.concatenate([[z[0] - 2], z, [z[-1] + 2]])
    width = np.where(wrong <= wrong.min() + 1e-9, np.diff(edges), -1)
    best = int(np.argmax(width))
    low, high = edges[best], edges[best + 1]
    # A text without evidence (0) stays below the boundary if that is as good.
    return float((max(low, 0) + high) / 2 if high > 0 else (low + high) / 2)


def _evidence(zeros: int, ones: int):
    """Likelihood ratio statistic of a bucket's occurrence against the label."""
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    share = (n0 + n1) / (zeros + ones)

    def term(n, total, part):
        return F.when(n > 0, n * F.ln(n / (total * part))).otherwise(0.0)

    seen = term(n0, zeros, share) + term(n1, ones, share)
    return 2 * (seen + term(zeros - n0, zeros, 1 - share) + term(ones - n1, ones, 1 - share))


def _thinned(rows: DataFrame, shares: dict[int, int], most: int) -> DataFrame:
    """About ``most`` rows of each label, the same ones in every run."""
    draw = F.pmod(F.xxhash64("key", F.lit(most)), F.lit(1 << 32)) / float(1 << 32)
    rate = F.coalesce(*(F.when(F.col("label") == i, F.lit(most / n)) for i, n in sorted(shares.items()) if n))
    return rows.where(draw < rate)


def _counts(rows: DataFrame) -> DataFrame:
    def run(batches):
        seen, n = scratch(), np.zeros((2, 1 << HASH_BITS), dtype=np.int64)
        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[y, buckets(x, seen)] += 1
        at = np.flatnonzero(n.any(axis=0))
        for start in range(0, len(at), 1 << 17):
            some = at[start : start + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.astype(np.int32)), pa.array(n[0, some]), pa.array(n[1, some])], names=["bucket", "n0", "n1"]
            )

    found = rows.select("text", "label").mapInArrow(run, "bucket int, n0 long, n1 long")
    return found.groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def _present(rows: DataFrame, scale: np.ndarray) -> DataFrame:
    """The buckets with a ratio that occur in each row."""
    known = rows.sparkSession.sparkContext.broadcast(scale)

    def run(batches):
        seen = scratch()
        for batch in batches:
            found = [(b := buckets(x, seen))[known.value[b] != 0].astype(np.int32) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["label", "found"])

    return rows.select("text", "label").mapInArrow(run, "label int, found array<int>")


def _regress(cols: np.ndarray, size: np.ndarray, y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Logistic regression over the scaled features: accelerated gradient steps on the whole sample.

    ``cols``: the buckets of one row after the other; ``size``: how many each row has.
    """
    used, cols = np.unique(cols, return_inverse=True)
    row = np.repeat(np.arange(len(y)), size)
    values = scale[used][cols].astype(np.float64)
    n = len(y)
    weight = np.where(y == 1, n / (2 * max(1, y.sum())), n / (2 * max(1, n - y.sum()))) / n
    norm = np.bincount(row, values**2, minlength=n) + 1
    step = 4 / (np.bincount(cols, values**2 * weight[row], minlength=len(used)).sum() + 1 + 4 * PENALTY)
    step = max(step, 4 / (norm.max() + 4 * PENALTY))
    w, c = np.zeros(len(used)), 0.0
    w1, c1, t = w, c, 1.0
    for _ in range(ROUNDS):
        z = np.bincount(row, values * w1[cols], minlength=n) + c1
        g = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y) * weight
        w2 = w1 - step * (np.bincount(cols, values * g[row], minlength=len(used)) + PENALTY * w1)
        c2 = c1 - step * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w1, c1 = w2 + (t - 1) / t2 * (w2 - w), c2 + (t - 1) / t2 * (c2 - c)
        w, c, t = w2, c2, t2
    beta = np.zeros(len(scale))
    beta[used] = w
    return beta


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all others than ``out``) and ``out``, the probability of label 1."""
    names = [c for c in df.columns if c != out] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.struct(*names).alias("row"), F.col(text).alias("text"))
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches):
        for batch in batches:
            found = [shared.value.score(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["row", "score"])

    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.col("score").alias(out))
