"""From log and orders to the cohort table, features and clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from cohortloom.config import CLUSTER_MEASURES, FEATURE_MEASURES, MODIFIER, Config
from cohortloom.operators.assembly import cohort_table, user_counts
from cohortloom.operators.classify import reduced_log
from cohortloom.operators.clusters import ClusterModel, cluster_points, fit_clusters
from cohortloom.operators.counting import active_users, class_counts
from cohortloom.operators.features import (
    LogScale,
    active_cohort,
    add_log_features,
    fit_log_scales,
    ordered_columns,
)
from cohortloom.operators.power import PowerScale, add_power_features, fit_power_scales
from cohortloom.operators.scoring import score_classes
from cohortloom.sources.stages import StageArea
from cohortloom.sources.tables import Tables


def _log(t: Tables, cfg: Config, stages: StageArea) -> DataFrame:
    """The reduced log, written once for all that is counted from it."""
    return stages.tables.get("log") or stages.save(reduced_log(t.activities, cfg), "log")


def _counts(t: Tables, cfg: Config, stages: StageArea) -> DataFrame:
    """The class counts, written once; they are read several times."""
    known = stages.tables.get("class_counts")
    return known or stages.save(class_counts(t, cfg, _log(t, cfg, stages)), "class_counts")


def scored_classes(t: Tables, cfg: Config, stages: StageArea) -> DataFrame:
    """Long frame with scores."""
    return score_classes(_counts(t, cfg, stages), cfg, stages)


def wide_cohort(t: Tables, cfg: Config, stages: StageArea) -> DataFrame:
    """The cohort table in the order of the user ids."""
    active = active_users(t, cfg, _log(t, cfg, stages))
    return cohort_table(active, scored_classes(t, cfg, stages)).orderBy("user_id")


def all_users(t: Tables, cfg: Config, stages: StageArea) -> DataFrame:
    """Every user with log rows in the window: ids, counts and lists."""
    return user_counts(active_users(t, cfg, _log(t, cfg, stages)), _counts(t, cfg, stages))


@dataclass(frozen=True)
class Scales:
    logs: list[LogScale]
    powers: list[PowerScale]


@dataclass(frozen=True)
class Cohort:
    """Users and active users as written tables, and the scales fitted to the active ones."""

    users: DataFrame
    active: DataFrame
    scales: Scales

    def featured(self) -> DataFrame:
        """Active users with all features, in the column order of the saved table."""
        df = add_log_features(self.active, self.scales.logs)
        return ordered_columns(add_power_features(df, self.scales.powers))


def stage_users(t: Tables, cfg: Config, stages: StageArea) -> DataFrame:
    return stages.save(all_users(t, cfg, stages), "all_users")


def stage_active(t: Tables, cfg: Config, stages: StageArea) -> DataFrame:
    """Active users, written apart: every fit reads their counts again."""
    return active_of(stage_users(t, cfg, stages), cfg, stages)


def active_of(users: DataFrame, cfg: Config, stages: StageArea) -> DataFrame:
    """Active users of a table of all users, counted here or exported earlier."""
    return stages.save(active_cohort(users, cfg), "active_users")


def fit_scales(active: DataFrame) -> Scales:
    powers = fit_power_scales(active, [*FEATURE_MEASURES, MODIFIER])
    return Scales(fit_log_scales(active), powers)


def build_cohort(t: Tables, cfg: Config, stages: StageArea) -> Cohort:
    active = stage_active(t, cfg, stages)
    return Cohort(stages.tables["all_users"], active, fit_scales(active))


@dataclass(frozen=True)
class Clustered:
    points: DataFrame
    scales: list[PowerScale]
    model: ClusterModel
    users: DataFrame


def points_of(active: DataFrame, stages: StageArea) -> tuple[DataFrame, list[PowerScale]]:
    """Distinct points of the active users, and the scales that made their features."""
    powers = fit_power_scales(active, CLUSTER_MEASURES)
    return cluster_points(active, powers, stages), powers


def cluster_users(active: DataFrame, cfg: Config, stages: StageArea) -> Clustered:
    """Fit the clusters and write the active users with logs, cluster and names."""
    points, powers = points_of(active, stages)
    model = fit_clusters(points, cfg)
    logged = add_log_features(active, fit_log_scales(active))
    users = stages.save(model.assign(logged, powers, cfg), "clustered_users")
    return Clustered(points, powers, model, users)
