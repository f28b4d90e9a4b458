"""What the physical plans must and must not hold."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from catalogue.queries import QUERIES
from cohortloom.operators.classify import counted_acts
from cohortloom.operators.counting import class_counts
from cohortloom.operators.lookups import left_lookup
from cohortloom.operators.money import expense_rollup, income_rollup
from cohortloom.plans.cohort import all_users, scored_classes, wide_cohort
from cohortloom.sources.sample import CONFIG, SampleTables
from tests.helpers import plan_of

SF = "/root/testdata/sf0.001"
# These fit models; their plans are those of the frames they start from.
FITTED = {"elbow", "kmeans_sizes", "cluster_tree", "cluster_profile", "cluster_histogram"}
FITTED |= {"cluster_user_profiles", "cluster_sample_links", "pca_map", "cluster_checks", "elbow_of_one", "feature_totals"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - FITTED))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for node in ("Python", "ArrowEval", "MapInPandas", "CartesianProduct", "NestedLoopJoin"):
        assert node not in plan, node


def single_partition_windows(plan):
    """Windows fed by an exchange into one partition."""
    lines = plan.splitlines()
    return [
        line
        for i, line in enumerate(lines)
        if re.search(r"\bWindow \[", line) and any("SinglePartition" in x for x in lines[i : i + 4])
    ]


@pytest.mark.parametrize("name", ["class_scores", "cohort_table_wide", "segment_top_users"])
def test_no_window_over_all_rows(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not single_partition_windows(plan)


def test_scoring_does_not_shuffle_the_counts(spark, stages):
    """Scored rows come straight from the written counts; only small limits are joined."""
    plan = plan_of(scored_classes(SampleTables(spark, SF), CONFIG, stages))
    lines = plan.splitlines()
    probe = next(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line)
    build = next(i for i, line in enumerate(lines) if "BroadcastExchange" in line)
    assert not any("Exchange hashpartitioning" in line for line in lines[probe:build])


def scans(plan):
    return [line for line in plan.splitlines() if "FileScan parquet" in line]


def test_filters_and_columns_reach_the_scan(spark):
    t = SampleTables(spark, SF)
    log = [line for line in scans(plan_of(counted_acts(t, CONFIG))) if "events.parquet" in line]
    assert len(log) == 1
    assert "GreaterThan(ts" in log[0] and "LessThanOrEqual(ts" in log[0]
    ledger = [line for line in scans(plan_of(expense_rollup(t, CONFIG))) if "lineitem" in line]
    assert len(ledger) == 1
    assert "GreaterThanOrEqual(l_shipdate" in ledger[0] and "LessThan(l_shipdate" in ledger[0]
    assert "event_type" not in plan_of(t.collectives)


def test_log_and_orders_are_scanned_once(spark):
    plan = plan_of(class_counts(SampleTables(spark, SF), CONFIG))
    assert sum("events.parquet" in s for s in scans(plan)) == 1
    assert sum("orders.parquet" in s for s in scans(plan)) == 1


def test_all_users_and_the_cohort_table_share_one_scan(spark, stages):
    t = SampleTables(spark, SF)
    users, wide = all_users(t, CONFIG, stages), wide_cohort(t, CONFIG, stages)
    assert list(stages.tables).count("log") == 1
    for df in (users, wide):
        assert not any("events.parquet" in s or "orders.parquet" in s for s in scans(plan_of(df)))


def test_facts_are_reduced_before_every_lookup(spark):
    """Below the first join of the fact side there is a partial aggregation."""
    t = SampleTables(spark, SF)
    for df in (expense_rollup(t, CONFIG), income_rollup(t, CONFIG)):
        lines = plan_of(df).splitlines()
        scan = next(i for i, line in enumerate(lines) if "lineitem.parquet" in line)
        below = [re.sub(r"[^A-Za-z].*", "", re.sub(r"^[^A-Za-z]*", "", x)) for x in lines[:scan]]
        steps = [x for x in below if x.endswith("Aggregate") or x.endswith("Join")]
        assert steps[-1].endswith("Aggregate") and steps[-2].endswith("Aggregate")


def hot_facts(spark, rows=60_000):
    """A third of the rows share a key, and a third have none."""
    return spark.range(0, rows, 1, 8).selectExpr(
        "id AS fact_id",
        "CASE id % 3 WHEN 0 THEN 7L WHEN 1 THEN id % 500 END AS k",
        "repeat(md5(string(id)), 4) AS payload",
    )


def accounts(spark):
    return spark.range(500).selectExpr("id AS account_id", "concat('a', id) AS slug")


def test_lookup_splits_hot_keys_and_spreads_missing_ones(spark, settings):
    facts, dim = hot_facts(spark), accounts(spark)
    expected = {
        r.slug: r.n
        for r in facts.join(F.broadcast(dim), F.col("k") == F.col("account_id"), "left")
        .groupBy("slug")
        .agg(F.count("*").alias("n"))
        .collect()
    }
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="200KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.5",
        spark__sql__adaptive__advisoryPartitionSizeInBytes="200KB",
        spark__sql__adaptive__coalescePartitions__enabled="false",
    )
    settings(spark__sql__shuffle__partitions="16")
    found = left_lookup(facts, dim, {"k": "account_id"}, ["fact_id"])
    placed = found.withColumn("task", F.spark_partition_id())
    rows = placed.select("slug", "payload", "task").collect()
    sizes, got = Counter(r.task for r in rows), Counter(r.slug for r in rows)
    assert got == expected
    # No task gets the third of the rows that share a key, nor the third without a key.
    assert max(sizes.values()) < 60_000 / 10
    found.collect()
    assert "skew=true" in plan_of(found)


def test_shuffled_joins_give_the_same_rows(spark, settings):
    """The plan for accounts that are too large to broadcast."""
    t = SampleTables(spark, SF)
    small = sorted(map(str, class_counts(t, CONFIG).collect()))
    income = sorted(map(str, income_rollup(t, CONFIG).collect()))
    settings(
        spark__sql__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__autoBroadcastJoinThreshold="-1",
        spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="1KB",
        spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.0",
        spark__sql__adaptive__forceOptimizeSkewedJoin="true",
    )
    t = SampleTables(spark, SF)
    df = class_counts(t, CONFIG)
    assert "BroadcastHashJoin" not in plan_of(df)
    assert sorted(map(str, df.collect())) == small
    assert sorted(map(str, income_rollup(t, CONFIG).collect())) == income
