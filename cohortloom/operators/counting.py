"""Active users, and counts per user and class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.config import Config
from cohortloom.operators.classify import counted_acts, user_directory
from cohortloom.operators.filters import rolling_window
from cohortloom.sources.stages import StageArea
from cohortloom.sources.tables import Tables


def active_users(t: Tables, cfg: Config, log: DataFrame | None = None) -> DataFrame:
    """Distinct users with any log row in the window, with the slug of their account.

    Users are made distinct before the lookups, so no lookup sees a hot user. ``log`` is the reduced
    log, if it was written before.
    """
    if log is None:
        log = rolling_window(t.activities, "created_at", cfg.activity_as_of, cfg.activity_window)
    recent = log
    people = user_directory(t.users, t.collectives).filter("has_account")
    return recent.select("user_id").distinct().join(people, "user_id").select("user_id", "user_slug")


def class_counts(t: Tables, cfg: Config, log: DataFrame | None = None) -> DataFrame:
    """Per user and class: number of rows, sorted distinct hosts and recipients.

    Recipients are null for classes of the activity log. Rows are first summed per user, class, host
    and recipient, which splits the rows of a user with very many; the lists are then built from
    distinct pairs. Users are looked up last, when there is one row per user and class; the log
    classes need a user with an account.
    """
    recipients = F.array_sort(F.collect_set("recipient"))
    pairs = counted_acts(t, cfg, log).groupBy("user_id", "activity_class", "host", "recipient")
    counts = (
        pairs.agg(F.sum("n").alias("n"))
        .groupBy("user_id", "activity_class")
        .agg(
            F.sum("n").alias("n"),
            F.array_sort(F.collect_set("host")).alias("hosts"),
            F.when(F.size(recipients) > 0, recipients).alias("recipients"),
        )
    )
    people = user_directory(t.users, t.collectives)
    known = counts.join(people, "user_id").filter("has_account OR recipients IS NOT NULL")
    return known.select("user_id", "user_slug", "activity_class", "n", "hosts", "recipients")


@dataclass(frozen=True)
class ClassLists:
    """Class counts with their lists in parts.

    ``rows``: user_id, user_slug, activity_class, n, host_count, recipient_count.
    ``parts``: user_id, activity_class, list ('hosts' or 'recipients'), part (from 0), items. The parts
    of a list, in their order, hold its sorted distinct items; only its last part can be short.
    """

    rows: DataFrame
    parts: DataFrame


def class_lists(
    t: Tables, cfg: Config, stages: StageArea, log: DataFrame | None = None, size: int = 10_000
) -> ClassLists:
    """The rows of :func:`class_counts` for users whose lists may be very long.

    Nothing here holds a whole list: a user's distinct hosts and recipients are rows of their own, dealt
    out by ranges, and come together in parts of ``size`` items. Counts and list lengths need no list.
    """
    pairs = counted_acts(t, cfg, log)
    # The host's row carries the count; every act has one, if only a missing one.
    both = "stack(2, 'hosts', host, n, 'recipients', recipient, 0L) AS (list, item, n)"
    items = stages.save(
        pairs.selectExpr("user_id", "activity_class", both)
        .groupBy("user_id", "activity_class", "list", "item")
        .agg(F.sum("n").alias("n")),
        "class_items",
    )
    length = "count_if(list = '{0}' AND item IS NOT NULL)"
    counts = items.groupBy("user_id", "activity_class").agg(
        F.sum("n").alias("n"),
        F.expr(length.format("hosts")).alias("host_count"),
        F.expr(length.format("recipients")).alias("recipient_count"),
    )
    people = user_directory(t.users, t.collectives)
    known = counts.join(people, "user_id").filter("has_account OR recipient_count > 0")
    rows = stages.save(
        known.select("user_id", "user_slug", "activity_class", "n", "host_count", "recipient_count"),
        "class_rows",
    )
    parts = list_parts(
        items.filter("item IS NOT NULL").drop("n"), ["user_id", "activity_class", "list"], stages, size
    )
    return ClassLists(rows, parts.join(rows.select("user_id", "activity_class"), ["user_id", "activity_class"]))


def list_parts(items: DataFrame, keys: list[str], stages: StageArea, size: int) -> DataFrame:
    """Sorted lists in parts of ``size``: ``keys``, part (from 0) and items.

    ``items`` has distinct rows of ``keys`` and ``item``. They are dealt out by ranges of key and item,
    so a key with a third of all rows fills many tasks; a running sum over the sizes of a key's ranges
    (one row per range) gives the place at which each begins, and rows are numbered inside their range.
    """
    ranged = items.repartitionByRange(*keys, "item").withColumn("dealt", F.spark_partition_id())
    keyed = stages.save(ranged, "ranged_items")
    cell = [*keys, "dealt"]
    earlier = W.partitionBy(*keys).orderBy("dealt").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        keyed.groupBy(*cell)
        .agg(F.count(F.lit(1)).alias("size"))
        .select(*cell, F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    )
    place = F.col("start") + F.row_number().over(W.partitionBy(*cell).orderBy("item")) - 1
    placed = keyed.join(starts, cell).select(*keys, "item", place.alias("place"))
    return (
        placed.groupBy(*keys, F.expr(f"place div {size}").alias("part"))
        .agg(F.array_sort(F.collect_list("item")).alias("items"))
        .select(*keys, "part", "items")
    )


def whole_lists(lists: ClassLists) -> DataFrame:
    """The rows of :func:`class_counts`, each list put together in one value."""
    keys = ["user_id", "activity_class"]

    def whole(name: str):
        of_list = F.when(F.col("list") == name, F.struct("part", "items"))
        ordered = F.array_sort(F.collect_list(of_list))
        return F.flatten(F.transform(ordered, lambda p: p["items"])).alias(name)

    joined = lists.rows.join(
        lists.parts.groupBy(*keys).agg(whole("hosts"), whole("recipients")), keys, "left"
    )
    none = F.expr("CAST(array() AS array<string>)")
    return joined.select(
        "user_id",
        "user_slug",
        "activity_class",
        "n",
        F.coalesce("hosts", none).alias("hosts"),
        F.when(F.col("recipient_count") > 0, F.col("recipients")).alias("recipients"),
    )
