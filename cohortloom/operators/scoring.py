"""Scores, ranks and percentile tiles of the class counts.

Nothing here puts all users into one task: ranks come from the sizes of sorted parts, and the counts
themselves are scored where they lie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.config import Config
from cohortloom.functions.columns import log_score, rank_bucket
from cohortloom.sources.stages import StageArea


def class_limits(
    counts: DataFrame,
    stages: StageArea,
    tiles: int = 20,
    group: str = "activity_class",
    count: str = "n",
    user_id: str = "user_id",
) -> DataFrame:
    """Per class: the largest count and the last ``(count, user id)`` of every tile.

    ``counts`` is read more than once, so pass a written table.

    1. The rows are dealt out by ranges of (class, count, user id), which makes parts of about equal
       size whatever the ids and counts are, and written with the number of their part.
    2. A running sum over the sizes of the parts of a class, at most one row per part and class,
       gives the ranks that each part holds.
    3. Only parts in which a tile ends, at most ``tiles`` per class, are ranked row by row, each in
       its own task.
    """
    ranged = counts.select(group, count, user_id).repartitionByRange(group, count, user_id)
    keyed = stages.save(ranged.withColumn("part", F.spark_partition_id()), "ranged_counts")
    cell = [group, "part"]
    cells = keyed.groupBy(*cell).agg(F.count(F.lit(1)).alias("users"), F.max(count).alias("top"))
    in_class = W.partitionBy(group)
    earlier = in_class.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranked = cells.select(
        *cell,
        "users",
        F.coalesce(F.sum("users").over(earlier), F.lit(0)).alias("before"),
        F.sum("users").over(in_class).alias("total"),
        F.max("top").over(in_class).alias("largest"),
    )
    # The first (total % tiles) tiles hold one row more than the rest.
    small, large, extra = f"(total div {tiles})", f"(total div {tiles} + 1)", f"(total % {tiles})"

    def tiles_until(rank: str) -> str:
        """Number of tiles that end at or before a rank."""
        rest = f"{extra} + ({rank} - {extra} * {large}) div greatest({small}, 1)"
        return f"CASE WHEN {rank} <= {extra} * {large} THEN {rank} div {large} ELSE {rest} END"

    ends = (
        ranked.selectExpr(
            "*",
            f"{tiles_until('before')} AS ended",
            f"{tiles_until('(before + users)')} AS ending",
        )
        .filter("ending > ended")
        .selectExpr(
            *cell,
            "largest",
            f"transform(sequence(ended + 1, ending), "
            f"i -> i * {small} + least(i, {extra}) - before) AS positions",
        )
    )
    # At most one row per tile and class on the broadcast side.
    in_cell = W.partitionBy(*cell).orderBy(count, user_id)
    last_rows = (
        keyed.join(F.broadcast(ends), cell)
        .withColumn("position", F.row_number().over(in_cell).cast("bigint"))
        .filter("array_contains(positions, position)")
    )
    end = F.struct(F.col(count).alias("n"), F.col(user_id).alias("id"))
    return last_rows.groupBy(group).agg(
        F.max("largest").alias("largest"), F.sort_array(F.collect_list(end)).alias("tile_ends")
    )


def score_classes(counts: DataFrame, cfg: Config, stages: StageArea) -> DataFrame:
    """Add log, score, rank and percentile to the long counts.

    The score divides log10(n + 1) by the largest log10(n) of the class, so it can exceed 1; where
    no user has two rows of a class the score is 0.
    """
    limits = class_limits(counts, stages, cfg.tiles)
    # A row's tile is its place among the tile ends of its class.
    own = F.struct("n", F.col("user_id").alias("id"))
    tile = F.array_position(F.sort_array(F.array_append("tile_ends", own)), own)
    step = 100 // cfg.tiles
    score = F.try_divide(F.log10(F.col("n") + 1), F.log10("largest"))
    return (
        # One row per class, at most eleven.
        counts.join(F.broadcast(limits), "activity_class")
        .withColumn("log", log_score("n"))
        .withColumn("raw_score", score)
        .withColumn("score", F.coalesce("raw_score", F.lit(0.0)))
        .withColumn("rank", rank_bucket(F.col("raw_score"), cfg.rank_width))
        .withColumn("percentile", (step * tile).cast("int"))
        .drop("raw_score", "largest", "tile_ends")
    )
