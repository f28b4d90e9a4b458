from __future__ import annotations

import math
import random

import pytest

from cohortloom.operators.assembly import cohort_table, user_counts
from cohortloom.operators.scoring import class_limits, score_classes
from cohortloom.sources.tables import kept_columns
from tests.helpers import CFG

SCHEMA = "user_id bigint, activity_class string, n bigint"


def tiles_by_rule(rows, tiles=20):
    """Tile number of every (n, user) by position: the first tiles hold one row more."""
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    small, extra = divmod(len(ordered), tiles)
    out, start = {}, 0
    for tile in range(1, tiles + 1):
        size = small + (tile <= extra)
        for user, _ in ordered[start : start + size]:
            out[user] = 5 * tile
        start += size
    return out


@pytest.mark.parametrize(
    "size, top, id_step",
    [(1, 1, 1), (7, 3, 1), (19, 1, 1), (20, 4, 1), (21, 2, 5), (173, 1, 1), (1000, 6, 10**9)],
)
def test_percentile_tiles(spark, stages, size, top, id_step):
    rng = random.Random(size)
    users = [(i * id_step - 3, 1 if rng.random() < 0.6 else rng.randint(1, top)) for i in range(size)]
    df = spark.createDataFrame([(u, "a", n) for u, n in users], SCHEMA)
    got = {r.user_id: r.percentile for r in score_classes(df, CFG, stages).collect()}
    assert got == tiles_by_rule(users)


def test_tiles_of_several_classes(spark, stages):
    rng = random.Random(5)
    users = {c: [(i, rng.choice([1, 1, 1, 2, 9])) for i in range(k)] for c, k in (("a", 64), ("b", 333))}
    rows = [(u, c, n) for c, pairs in users.items() for u, n in pairs]
    scored = score_classes(spark.createDataFrame(rows, SCHEMA), CFG, stages).collect()
    for c, pairs in users.items():
        assert {r.user_id: r.percentile for r in scored if r.activity_class == c} == tiles_by_rule(pairs)


@pytest.mark.parametrize(
    "ids",
    [
        [*range(3000), 9 * 10**18],
        [-(2**63), *range(-1500, 1500), 2**63 - 1],
        [i * (2**50) for i in range(-3000, 3000)],
    ],
)
def test_tiles_do_not_depend_on_the_range_of_ids(spark, stages, settings, ids):
    """One count shared by all, sparse and extreme ids: no part holds much more than its share."""
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    users = [(i, 1) for i in ids]
    df = spark.createDataFrame([(u, "a", n) for u, n in users], SCHEMA).repartition(5)
    got = {r.user_id: r.percentile for r in score_classes(df, CFG, stages).collect()}
    assert got == tiles_by_rule(users)
    parts = stages.tables["ranged_counts"].groupBy("part").count().collect()
    assert len(parts) > 1 and max(p["count"] for p in parts) < 3 * len(ids) / len(parts)


def test_scores(spark, stages):
    df = spark.createDataFrame([(1, "a", 1), (2, "a", 10), (3, "a", 100)], SCHEMA)
    rows = {r.user_id: r for r in score_classes(df, CFG, stages).collect()}
    assert rows[3].score == pytest.approx(math.log10(101) / 2)
    assert rows[3].score > 1
    assert (rows[3].rank, rows[2].rank, rows[1].rank) == (4.0, 2.0, 1.0)
    assert rows[2].log == pytest.approx(1.0)


def test_scores_of_single_acts_are_zero(spark, stages):
    df = spark.createDataFrame([(i, "a", 1) for i in range(5)], SCHEMA)
    rows = score_classes(df, CFG, stages).collect()
    assert {(r.score, r.rank, r.log) for r in rows} == {(0.0, 0.0, 0.0)}


def test_limits_stay_small(spark, stages):
    """The frame that is broadcast has one row per class and at most one end per tile."""
    df = spark.range(20_000).selectExpr("id AS user_id", "'a' AS activity_class", "1 + id % 3 AS n")
    limits = class_limits(df, stages).collect()
    assert len(limits) == 1
    assert len(limits[0].tile_ends) == 20
    assert limits[0].largest == 3


def test_empty_counts(spark, stages):
    df = spark.createDataFrame([], SCHEMA)
    assert score_classes(df, CFG, stages).count() == 0


def test_wide_tables(spark, stages):
    active = spark.createDataFrame([(1, "ann"), (2, "bob")], "user_id bigint, user_slug string")
    rows = [
        (1, "event_orders", 2, ["h"], ["p", "q"]),
        (1, "virtual_card_purchases", 3, ["h"], None),
        (9, "event_orders", 5, ["h"], ["p"]),  # not active
    ]
    long = spark.createDataFrame(
        rows,
        "user_id bigint, activity_class string, n bigint, hosts array<string>, recipients array<string>",
    )
    wide = cohort_table(active, score_classes(long, CFG, stages))
    assert len(wide.columns) == 80
    ann, bob = wide.orderBy("user_id").collect()
    assert (ann.event_orders, ann.event_orders_recipient_count) == (2, 2)
    assert ann.virtual_card_purchases_hosts == ["h"]
    assert (bob.event_orders, bob.event_orders_score, bob.event_orders_percentile) == (0, 0, 0)
    # An inactive class has no lists and no recipient count.
    assert bob.event_orders_hosts is None
    assert bob.event_orders_recipient_count is None

    kept = user_counts(active, long)
    assert kept.columns == kept_columns()
    assert len(kept.columns) == 30
    assert kept.orderBy("user_id").collect()[1].event_orders_recipients == []
