"""From counts to features: cleaning, totals, logarithmic scales and levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.config import (
    ADMIN_MEASURES,
    CONTRIBUTION_MEASURES,
    EXPENSE_MEASURES,
    FEATURE_MEASURES,
    MODIFIER,
    Config,
)
from cohortloom.functions.columns import level_score, sum_of
from cohortloom.operators.filters import above, drop_blocked


def with_totals(users: DataFrame) -> DataFrame:
    """Add total contributions, expenses and activities."""
    return users.withColumns(
        {
            "total_contributions": sum_of(CONTRIBUTION_MEASURES),
            "total_expenses": sum_of(EXPENSE_MEASURES),
        }
    ).withColumn(
        "total_activities", sum_of(["total_contributions", "total_expenses", *ADMIN_MEASURES])
    )


def counted_users(all_users: DataFrame, cfg: Config) -> DataFrame:
    """Users with a counted activity and no tie to a blocked account, with totals."""
    kept = drop_blocked(all_users, list(cfg.blocked_list_columns), cfg.blocked_slugs)
    return above(with_totals(kept), "total_activities", 0)


def with_modifier(users: DataFrame, cfg: Config) -> DataFrame:
    """Add the host admin weight: all admin activities of users with many for hosts, else 0."""
    heavy = F.col("host_admin_activities") >= cfg.modifier_threshold
    weight = F.when(heavy, sum_of(ADMIN_MEASURES)).otherwise(F.lit(0).cast("bigint"))
    return users.withColumn(MODIFIER, weight)


def active_cohort(all_users: DataFrame, cfg: Config) -> DataFrame:
    """Counted users above the activity threshold, with totals and the host admin weight."""
    counted = counted_users(all_users, cfg)
    return with_modifier(above(counted, "total_activities", cfg.active_threshold), cfg)


@dataclass(frozen=True)
class LogScale:
    """Smallest and largest ln(n + 1) of a measure."""

    measure: str
    low: float
    high: float

    def norm(self) -> Column:
        """ln(n + 1) scaled to [0, 1]; 0 where all users have the same count."""
        if not self.high > self.low:
            return F.lit(0.0)
        return (F.log1p(F.col(self.measure)) - self.low) / (self.high - self.low)


def fit_log_scales(users: DataFrame, measures=FEATURE_MEASURES) -> list[LogScale]:
    """Limits of all measures, from one pass."""
    logs = [F.log1p(F.col(m)) for m in measures]
    lows = [F.min(x).alias(f"low_{i}") for i, x in enumerate(logs)]
    highs = [F.max(x).alias(f"high_{i}") for i, x in enumerate(logs)]
    row = users.agg(*lows, *highs).first()
    return [
        LogScale(m, row[f"low_{i}"] or 0.0, row[f"high_{i}"] or 0.0)
        for i, m in enumerate(measures)
    ]


def add_log_features(users: DataFrame, scales: list[LogScale]) -> DataFrame:
    """Add ``_log``, ``_norm_log`` and ``_score`` of every measure."""
    norms = {f"{s.measure}_norm_log": s.norm() for s in scales}
    return users.withColumns(
        {f"{s.measure}_log": F.log1p(F.col(s.measure)) for s in scales} | norms
    ).withColumns(
        {f"{s.measure}_score": level_score(F.col(f"{s.measure}_norm_log")) for s in scales}
    )


def ordered_columns(df: DataFrame) -> DataFrame:
    """Ids first, the rest sorted by name, lists last."""
    ids = ["user_id", "user_slug"]
    rest = sorted(c for c in df.columns if c not in ids)
    lists = [c for c in rest if c.endswith(("_hosts", "_recipients"))]
    return df.select(*ids, *[c for c in rest if c not in lists], *lists)
