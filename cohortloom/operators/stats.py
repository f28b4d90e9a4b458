"""Counts, shares and histograms of the user frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import CHART_MEASURES, MEASURES, PROFILE_MEASURES, Config
from cohortloom.functions.columns import holds_any, percent_of
from cohortloom.operators.features import with_totals


def _as_rows(one_row: DataFrame, names: Sequence[str], key: str, value: str) -> DataFrame:
    """Turn a one-row frame into one row per column."""
    return one_row.unpivot([], list(names), key, value)


def _level_counts(all_users: DataFrame, cfg: Config) -> dict[str, Column]:
    """Number of users at each level of activity, as aggregates over all users."""
    total = F.col("total_activities")
    listed = holds_any(list(cfg.blocked_list_columns), cfg.blocked_slugs)
    fits = ~listed if cfg.blocked_slugs else F.lit(True)
    return {
        "all": F.count(F.lit(1)),
        "counted": F.count_if(fits & (total > 0)),
        "active": F.count_if(fits & (total > 0) & (total > cfg.active_threshold)),
        "highly_active": F.count_if(fits & (total > 0) & (total > cfg.high_threshold)),
    }


def funnel(all_users: DataFrame, cfg: Config) -> DataFrame:
    """Number of users: all, counted, active and highly active, from one pass."""
    levels = _level_counts(all_users, cfg)
    counts = with_totals(all_users).agg(*[c.alias(n) for n, c in levels.items()])
    return _as_rows(counts, list(levels), "stage", "users")


def class_user_share(all_users: DataFrame, cfg: Config) -> DataFrame:
    """Per class: users with any activity, as a share of all and of counted users.

    Both shares take the users over all users, including those the counted users leave out.
    """
    levels = _level_counts(all_users, cfg)
    users = {m: F.count_if(F.col(m) > 0) for m in MEASURES}
    counts = with_totals(all_users).agg(
        levels["all"].alias("all_users"),
        levels["counted"].alias("counted_users"),
        *[c.alias(m) for m, c in users.items()],
    )
    rows = counts.unpivot(["all_users", "counted_users"], list(MEASURES), "measure", "users")
    return rows.select(
        "measure",
        "users",
        percent_of(F.col("users"), F.col("all_users")).alias("percent_of_all"),
        percent_of(F.col("users"), F.col("counted_users")).alias("percent_of_counted"),
    )


def class_pies(active: DataFrame, measures=CHART_MEASURES) -> DataFrame:
    """Per measure: active users with and without it."""
    counts = active.agg(
        F.count(F.lit(1)).alias("all_users"),
        *[F.count_if(F.col(m) > 0).alias(m) for m in measures],
    )
    rows = counts.unpivot(["all_users"], list(measures), "measure", "users_with")
    return rows.select(
        "measure", "users_with", (F.col("all_users") - F.col("users_with")).alias("users_without")
    )


def histogram(
    df: DataFrame, measures=CHART_MEASURES, cap: int = 20, by: Sequence[str] = ()
) -> DataFrame:
    """Users per number of activities, from 1 to ``cap`` or more; each task adds up its own bins."""
    return (
        df.unpivot(list(by), list(measures), "measure", "value")
        .filter(F.col("value") > 0)
        .withColumn("activities", F.least(F.col("value"), F.lit(cap).cast("bigint")))
        .groupBy(*by, "measure", "activities")
        .agg(F.count(F.lit(1)).alias("users"))
    )


def cluster_histogram(clustered: DataFrame, cfg: Config) -> DataFrame:
    return histogram(clustered, PROFILE_MEASURES, cfg.cluster_histogram_cap, ["cluster"])
