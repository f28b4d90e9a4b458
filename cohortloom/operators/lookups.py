"""Joins that add the attributes of one keyed row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def left_lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: dict[str, str],
    spread: Sequence[str],
) -> DataFrame:
    """Left join on a key that is unique in ``dim``; ``keys`` maps fact columns to ``dim`` columns.

    Rows whose first key column is missing match nothing, and there may be very many of them;
    instead of meeting in the one task that owns the null key they are spread by a hash of the
    ``spread`` columns. A key that many rows share is left to the run-time split of skewed joins,
    so follow a lookup with nothing that needs its partitioning; where ``dim`` is small, Spark
    broadcasts it by its size and no row moves.
    """
    (first, dim_first), *rest = keys.items()
    place = F.coalesce(F.col(first), F.xxhash64(*spread))
    matches = (F.col("_place") == F.col(dim_first)) & F.col(first).isNotNull()
    for fact_key, dim_key in rest:
        matches &= F.col(fact_key) == F.col(dim_key)
    return facts.withColumn("_place", place).join(dim, matches, "left").drop("_place")
