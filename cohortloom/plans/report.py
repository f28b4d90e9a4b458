"""The whole report, from the operational tables to a bundle of results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import PROFILE_MEASURES, Config
from cohortloom.operators import stats
from cohortloom.operators.clusters import (
    cluster_profile,
    cluster_sizes,
    elbow,
    project,
    user_profiles,
)
from cohortloom.operators.hierarchy import smallest_expenses, top_hosts
from cohortloom.operators.report import headline_numbers, manifest
from cohortloom.operators.sampling import group_links, sample_per_group
from cohortloom.plans.cohort import cluster_users, stage_active, wide_cohort
from cohortloom.plans.moneyflow import all_trees, money_flow
from cohortloom.sources.stages import StageArea, is_done, mark_done, run_folder
from cohortloom.sources.tables import Tables


MAP_COLUMNS = ("user_id", "user_slug", *PROFILE_MEASURES, "cluster", "cluster_full_name", "x", "y")


def cluster_links(clustered: DataFrame, cfg: Config) -> DataFrame:
    """Links to the profiles of some random users of each cluster."""
    slim = clustered.select("cluster", "user_id", "user_slug")
    sample = sample_per_group(slim, "cluster", cfg.links_per_cluster, cfg.seed)
    return group_links(sample, "cluster", cfg.profile_url)


def build_results(
    t: Tables, cfg: Config, stages: StageArea, with_elbow: bool = False
) -> dict[str, DataFrame]:
    """Every result of the report by name. The elbow curve fits many models and is optional."""
    active = stage_active(t, cfg, stages)
    users = stages.tables["all_users"]
    clustered = cluster_users(active, cfg, stages)
    money = money_flow(t, cfg, stages)
    cohorts = clustered.users
    mapped = project(cohorts, clustered.scales)
    results = {
        "cohort_table": wide_cohort(t, cfg, stages),
        "funnel": stats.funnel(users, cfg),
        "class_user_share": stats.class_user_share(users, cfg),
        "class_pies": stats.class_pies(active),
        "class_histogram": stats.histogram(active, cap=cfg.histogram_cap),
        "cluster_tree": cluster_sizes(cohorts),
        "cluster_profile": cluster_profile(cohorts),
        "cluster_histogram": stats.cluster_histogram(cohorts, cfg),
        "cluster_links": cluster_links(cohorts, cfg),
        "user_profiles": user_profiles(cohorts, clustered.model, cfg),
        "pca_map": mapped.select(*MAP_COLUMNS),
        "top_hosts": top_hosts(money.income),
        "smallest_expenses": smallest_expenses(money.expenses),
        "headline_numbers": headline_numbers(users, money, cfg),
    }
    results |= {f"tree_{name}": df for name, df in all_trees(money, cfg).items()}
    if with_elbow:
        results["elbow"] = elbow(clustered.points, cfg)
    return results


def write_report(
    t: Tables, cfg: Config, out: str, with_elbow: bool = False, run_id: str | None = None
) -> str:
    """Build and write every result, then the manifest over the written results; returns the run's id.

    A run has a folder of its own, and its manifest is written last: a run without one is never read, so
    a reader sees the whole old report or the whole new one. A run that broke is taken up again by its
    ``run_id``: finished results and stage tables stay, and the work goes on at the first one missing.
    The results of a resumed run agree with each other, as they come from the same stage tables; they are
    deleted when the run is complete. A complete run is left as it is. Give another id if the source
    tables, the settings or ``with_elbow`` have changed.
    """
    spark = t.activities.sparkSession
    run_id = run_id or uuid.uuid4().hex
    folder = run_folder(out, run_id)
    if is_done(spark, f"{folder}/manifest"):
        return run_id
    # Names that begin with an underscore are no results.
    stages = StageArea(spark, folder=f"{folder}/_stages")
    results = build_results(t, cfg, stages, with_elbow)
    for name, df in results.items():
        _write_once(df, f"{folder}/{name}")
    written = {name: spark.read.parquet(f"{folder}/{name}") for name in results}
    entries = manifest(written, cfg).orderBy("section_ord", F.asc_nulls_first("item_ord"))
    _write_once(entries, f"{folder}/manifest")
    stages.close()
    return run_id


def _write_once(df: DataFrame, path: str) -> None:
    """Write a table unless it is whole; the marker comes after the data."""
    spark = df.sparkSession
    if not is_done(spark, path):
        df.write.mode("overwrite").parquet(path)
        mark_done(spark, path)
