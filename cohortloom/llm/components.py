"""Connected components of a link table, by alternating large and small stars.

Every round is two shuffles of the links that are left; minima are formed before the shuffle, and
the joins read written tables, so that a node with very many links is split at run time. The links
of a round are written to the shared folder: lineage stays short and lost executors cost one round
at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.sources.stages import StageArea


def components(links: DataFrame, area: StageArea) -> DataFrame:
    """``links``: (u, v) of comparable type, any order, repeats and self links allowed.

    Returns (node, root) for every node that is linked to a smaller one; the root is the smallest
    node of the component. An empty table gives an empty one.
    """
    now = area.save(_down(links), "links")
    seen = _state(now)
    while True:
        now = area.save(_small(area.save(_large(now), "large")), "links")
        after = _state(now)
        if after == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = after


def _down(links: DataFrame) -> DataFrame:
    """Each link once, from the larger node to the smaller."""
    both = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    return both.where("u > v").distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest neighbour."""
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.where("v > u").join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
