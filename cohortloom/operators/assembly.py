"""Wide tables: one row per active user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import CLASSES, ActivityClass


def _by_user(active: DataFrame, long: DataFrame, parts: Sequence[str]) -> DataFrame:
    """One row per active user, with a map from class to its parts.

    The long rows of active users meet their user first and are then collected where they are: only
    long rows are shuffled, by user. A user has at most eleven.
    """
    rows = active.join(long.select("user_id", "activity_class", *parts), "user_id", "left")
    entry = f"struct(activity_class, struct({', '.join(parts)}))"
    entries = f"collect_list({entry}) FILTER (WHERE activity_class IS NOT NULL)"
    return rows.groupBy("user_id", "user_slug").agg(
        F.expr(f"map_from_entries({entries})").alias("classes")
    )


def _part(c: ActivityClass, part: str) -> str:
    return f"try_element_at(classes, '{c.measure}').{part}"


def _or_zero(c: ActivityClass, part: str, zero: str) -> str:
    return f"coalesce({_part(c, part)}, {zero}) AS {c.column('count' if part == 'n' else part)}"


def _all_parts(c: ActivityClass) -> list[str]:
    columns = [
        _or_zero(c, "n", "0L"),
        _or_zero(c, "log", "0D"),
        _or_zero(c, "score", "0D"),
        _or_zero(c, "rank", "0D"),
        _or_zero(c, "percentile", "0"),
    ]
    columns += [f"{_part(c, part)} AS {c.column(part)}" for part in c.list_parts]
    if c.from_orders:
        # Null, not zero, where the class is inactive.
        listed = _part(c, "recipients")
        size = f"CASE WHEN {listed} IS NOT NULL THEN size({listed}) END"
        columns.append(f"{size} AS {c.column('recipient_count')}")
    return columns


def cohort_table(active: DataFrame, scored: DataFrame) -> DataFrame:
    """The cohort table: ids and 78 class columns. Sort it by user where it is written."""
    parts = ["n", "log", "score", "rank", "percentile", "hosts", "recipients"]
    columns = [text for c in CLASSES for text in _all_parts(c)]
    return _by_user(active, scored, parts).selectExpr("user_id", "user_slug", *columns)


def user_counts(active: DataFrame, counts: DataFrame) -> DataFrame:
    """The thirty columns that the user analysis keeps, without scores; missing lists are empty."""
    empty = "CAST(array() AS array<string>)"
    columns = []
    for c in CLASSES:
        columns.append(_or_zero(c, "n", "0L"))
        columns += [_or_zero(c, part, empty) for part in c.list_parts]
    wide = _by_user(active, counts, ["n", "hosts", "recipients"])
    return wide.selectExpr("user_id", "user_slug", *columns)
