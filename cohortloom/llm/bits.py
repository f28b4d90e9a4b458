"""A bitmap of hashes: which rows a scan should write down for a join.

Its size is the same for any corpus, so it can be collected and broadcast. A bit that is set by
chance, or a bitmap that is nearly full, makes a scan write more than needed, never less.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITMAP = 1 << 26
PAGE = 1 << 19  # bits that one row holds


def bitmap(rows: DataFrame) -> np.ndarray:
    """Packed bits of ``hash`` modulo ``BITMAP``."""
    spot = F.pmod("hash", F.lit(BITMAP))
    pages = rows.select((spot / PAGE).cast("int").alias("page"), (spot % PAGE).cast("int").alias("bit"))

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            page, bit = (batch.column(i).to_numpy() for i in (0, 1))
            for p in np.unique(page).tolist():
                bits = held.setdefault(p, np.zeros(PAGE, dtype=np.uint8))
                bits[bit[page == p]] = 1
        for p, bits in held.items():
            yield pa.RecordBatch.from_pydict({"page": pa.array([p], pa.int32()), "bits": [np.packbits(bits).tobytes()]})

    # at most BITMAP / PAGE rows
    rows = pages.repartition("page").mapInArrow(run, "page int, bits binary").toArrow()
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for page, bits in zip(rows.column("page").to_pylist(), rows.column("bits").to_pylist(), strict=True):
        out[page * PAGE // 8 : (page + 1) * PAGE // 8] |= np.frombuffer(bits, dtype=np.uint8)
    return out
