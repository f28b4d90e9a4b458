"""Language identification by partial matching of byte contexts.

Each language has a tree of byte contexts up to ``ORDER`` bytes with the counts of what followed.
The probability of a byte after a context is ``c / (n + q)`` if it was seen there (c times of n, with
q distinct followers), else the escape probability ``q / (n + q)`` times its probability after the
next shorter context among the bytes not seen; below the empty context all bytes are alike. The
statistics are frozen once learned, so the code length of a text under a language is an exact sum
over its positions, and the prediction is the language with the shortest code.

Learned from a sample of bounded size, about ``SAMPLE`` rows of each language drawn by a hash of the
id; Spark counts their n-grams and only counts reach the driver. The model has the
code lengths of the grams seen in any language and the escapes of their contexts, all 256 bytes apart,
and is broadcast once; scoring reads every whole text in one pass without a shuffle.

Cases: a text that is null or has no letter is ``und`` with score 0; without a training row every
text is ``und``; ties go to the first language by name; repeated rows are predicted alike.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORDER = 3  # bytes of the longest context
SAMPLE = 600  # training rows of each language
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Frozen statistics, by the length of the context.

    ``grams`` are the sorted codes of a context and a byte that any language has, ``costs`` their code
    lengths in bits in each language; ``contexts`` are the sorted codes of the contexts, and ``escapes``
    the bits to add to the code length after the next shorter one for a byte that no language has there.
    """

    languages: tuple[str, ...]
    grams: tuple[np.ndarray, ...]
    costs: tuple[np.ndarray, ...]
    contexts: tuple[np.ndarray, ...]
    escapes: tuple[np.ndarray, ...]

    @property
    def symbol(self) -> np.ndarray:
        """Columns of ``cost``: one for each byte that was seen, and one for all that never were."""
        out = np.full(256, len(self.grams[0]))
        out[self.grams[0]] = np.arange(len(self.grams[0]))
        return out

    @property
    def cost(self) -> np.ndarray:
        """Code lengths after all known contexts in each language; large."""
        columns = np.append(self.grams[0], 255)  # which no UTF-8 has
        every = [self.after((c[:, None] * 256 + columns).ravel(), i) for i, c in enumerate(self.contexts)]
        return np.concatenate(every).reshape(-1, len(columns), len(self.languages))

    def after(self, code: np.ndarray, order: int) -> np.ndarray:
        """Code lengths of bytes after contexts of ``order`` bytes, in each language."""
        out = np.zeros((len(code), len(self.languages)), dtype=np.float32)
        left = np.arange(len(code))
        for i in range(order, -1, -1):
            here = code[left] & ((1 << 8 * (i + 1)) - 1)
            at, known = _found(self.grams[i], here)
            out[left[known]] += self.costs[i][at[known]]
            left, here = left[~known], here[~known]
            if not len(left):
                return out
            at, known = _found(self.contexts[i], here >> 8)
            out[left[known]] += self.escapes[i][at[known]]
        out[left] += 8  # below the empty context all bytes are alike
        return out

    def bits(self, text: str) -> np.ndarray:
        """Exact code length of a text under each language."""
        # Bytes that were never seen are alike, as contexts too: as the padding, if that is none of the bytes.
        seen = self.grams[0].tolist()
        table = bytearray([0 if 0 not in seen else 255]) * 256
        for b in seen:
            table[b] = b
        raw = text.encode().translate(table)
        total = np.zeros(len(self.languages))
        for i in range(min(ORDER, len(raw))):
            total += self.after(np.array([int.from_bytes(raw[: i + 1], "big")]), i)[0]
        for at in range(0, len(raw) - ORDER, 1 << 20):
            total += self.after(_windows(raw[at : at + (1 << 20) + ORDER]), ORDER).sum(axis=0, dtype=np.float64)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not LETTER.search(text):
            return UNKNOWN, 0.0
        bits = self.bits(text)
        best = int(np.argmin(bits))
        return self.languages[best], float(1 / np.exp2(-np.minimum(bits - bits[best], 1000)).sum())


def _found(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values in sorted keys, and whether they are there."""
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return at, keys[at] == values


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Model:
    """Learn from rows with a text and a language; others are left out."""
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("key"), F.lit(1 << 32)) / float(1 << 32)
    rates = [F.when(F.col("lang") == x, F.lit(SAMPLE / n)) for x, n in sorted(sizes.items())]
    texts = rows.where(draw < F.coalesce(*rates, F.lit(0.0)))
    table = _grams(texts).toArrow()
    return _frozen(table.column("lang").to_pylist(), table.column("gram").to_numpy(), table.column("n").to_numpy())


def _grams(texts: DataFrame) -> DataFrame:
    """Counts of each language's grams of ORDER + 1 bytes; a text's start is padded with the byte 0."""

    def run(batches):
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            raw = batch.column(1).to_pylist()
            for lang in sorted(set(langs.tolist())):
                body = [b"\0" * ORDER + raw[i].encode() for i in np.flatnonzero(langs == lang)]
                gram = np.concatenate([_windows(b) for b in body])
                value, n = np.unique(gram, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(value), pa.string()), pa.array(value), pa.array(n)], names=["lang", "gram", "n"]
                )

    found = texts.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _windows(raw: bytes) -> np.ndarray:
    s = np.frombuffer(raw, dtype=np.uint8).astype(np.int64)
    out = np.zeros(len(s) - ORDER, dtype=np.int64)
    for i in range(ORDER + 1):
        out = (out << 8) | s[i : len(s) - ORDER + i]
    return out


def _frozen(langs: list[str], gram: np.ndarray, n: np.ndarray) -> Model:
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), (), (), (), ())
    which = np.array([names.index(x) for x in langs], dtype=np.int64)
    grams, costs, contexts, escapes = [], [], [], []
    for order in range(ORDER + 1):
        keys, place = np.unique(gram & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
        count = np.zeros((len(keys), len(names)))
        np.add.at(count, (place, which), n)
        context, of = np.unique(keys >> 8, return_inverse=True)
        # The end of a known gram is a known gram of the shorter context.
        below = chance[np.searchsorted(grams[-1], keys & ((1 << 8 * order) - 1))] if order else np.full(count.shape, 1 / 256)
        chance, escape = _escaped(count, below, of, len(context))
        grams.append(keys)
        costs.append((-np.log2(chance)).astype(np.float32))
        contexts.append(context)
        escapes.append((-np.log2(escape)).astype(np.float32))
    return Model(names, tuple(grams), tuple(costs), tuple(contexts), tuple(escapes))


def _escaped(count: np.ndarray, below: np.ndarray, of: np.ndarray, contexts: int) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of grams, from their counts and those after the shorter context, and the factor
    of each context for bytes not seen there; ``of`` has the context of each gram."""

    def summed(values):
        out = np.zeros((contexts, count.shape[1]))
        np.add.at(out, of, values)
        return out

    n, q = summed(count), summed(count > 0)
    left = np.maximum(1 - summed(np.where(count > 0, below, 0)), 1e-12)
    full = q >= 256  # nothing is left to escape to
    escape = np.where((n > 0) & ~full, q / np.maximum(n + q, 1) / left, 1)
    seen = count / np.maximum(np.where(full, n, n + q), 1)[of]
    return np.where(count > 0, seen, escape[of] * below), escape


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` (all others than the results), ``lang_pred`` and ``score``."""
    names = [c for c in df.columns if c not in ("lang_pred", "score")] if keep is None else keep
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.struct(*names).alias("row"), F.col(text).alias("text"))
    schema = T.StructType(
        [T.StructField("row", rows.schema["row"].dataType), T.StructField("lang_pred", T.StringType()),
         T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())],
                names=schema.names,
            )

    done = rows.mapInArrow(run, schema)
    return done.select(*(F.col(f"row.`{c}`").alias(c) for c in names), "lang_pred", "score")
