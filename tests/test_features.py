from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.config import (
    CLUSTER_MEASURES,
    FEATURE_MEASURES,
    LIST_COLUMNS,
    MEASURES,
    MODIFIER,
    SAMPLE_TITLE,
    TOP_PROFILES,
)
from cohortloom.operators import stats
from cohortloom.operators.clusters import (
    GRID,
    cluster_points,
    cluster_profile,
    cluster_sizes,
    elbow,
    fit_clusters,
    mixed_sample,
    project,
    top_users,
    user_profiles,
)
from cohortloom.operators.features import (
    active_cohort,
    add_log_features,
    fit_log_scales,
    ordered_columns,
)
from cohortloom.operators.power import add_power_features, fit_power_scales
from cohortloom.operators.sampling import group_links, sample_per_group, top_per_group
from tests.helpers import CFG, config, plan_of


def users_frame(spark, rows):
    """Users from dicts; counts default to 0 and lists to empty."""
    names = ["user_id", "user_slug", *MEASURES, *LIST_COLUMNS]
    kinds = ["bigint", "string"] + ["bigint"] * len(MEASURES) + ["array<string>"] * len(LIST_COLUMNS)
    data = []
    for i, row in enumerate(rows, 1):
        row = {"user_id": i, "user_slug": f"u{i}", **row}
        data.append(tuple(row.get(n, [] if n in LIST_COLUMNS else 0) for n in names))
    return spark.createDataFrame(data, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


@pytest.fixture(scope="module")
def random_users(spark):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        row = {"direct_contributions": 1}
        if i % 4:
            row = {m: rng.choice([0, 0, 0, 1, 2, 5, 30]) for m in MEASURES}
        rows.append(row)
    return active_cohort(users_frame(spark, rows), CFG).cache()


def test_cohort_totals_and_filters(spark):
    df = users_frame(
        spark,
        [
            {"direct_contributions": 2, "expense_activities": 3, "host_admin_activities": 25, "collective_admin_activities": 4},
            {"host_admin_activities": 24, "collective_admin_activities": 4},
            {},
            {"event_orders": 1, "event_orders_hosts": ["blocked"]},
            {"virtual_card_purchases": 1, "virtual_card_purchases_hosts": ["blocked"]},
        ],
    )
    rows = {r.user_id: r for r in active_cohort(df, CFG).collect()}
    assert set(rows) == {1, 2, 5}
    assert (rows[1].total_contributions, rows[1].total_expenses, rows[1].total_activities) == (2, 3, 34)
    assert (rows[1][MODIFIER], rows[2][MODIFIER]) == (29, 0)
    assert {r.user_id for r in active_cohort(df, config(active_threshold=28)).collect()} == {1}
    assert stats.funnel(df, CFG).orderBy("stage").collect() == [
        ("active", 3),
        ("all", 5),
        ("counted", 3),
        ("highly_active", 2),
    ]


def test_log_features(random_users):
    scales = fit_log_scales(random_users)
    df = ordered_columns(add_log_features(random_users, scales))
    rows = df.collect()
    for s in scales:
        norms = [r[f"{s.measure}_norm_log"] for r in rows]
        assert min(norms) == 0 and max(norms) == pytest.approx(1)
        assert {r[f"{s.measure}_score"] for r in rows} <= {0, 1, 2, 3}
    assert df.columns[:2] == ["user_id", "user_slug"]
    assert df.columns[-len(LIST_COLUMNS) :] == sorted(LIST_COLUMNS)


def test_constant_measure_scales_to_zero(spark):
    df = active_cohort(users_frame(spark, [{"event_orders": 3}, {"event_orders": 3}]), CFG)
    row = add_log_features(df, fit_log_scales(df)).first()
    assert (row.event_orders_norm_log, row.event_orders_score) == (0, 0)
    scales = fit_power_scales(df, FEATURE_MEASURES)
    assert {s.power for s in scales} == {1.0}
    row = add_power_features(df, scales).first()
    assert (row.event_orders_yeojohnson, row.event_orders_yeojohnson_scaled) == (0, 0)


def likelihood(xs, power):
    xs = np.asarray(xs, float)
    y = np.log1p(xs) if power == 0 else ((xs + 1) ** power - 1) / power
    return -len(xs) / 2 * math.log(y.var()) + (power - 1) * np.log1p(xs).sum()


def test_power_fit_is_the_best_power(random_users):
    measures = [*FEATURE_MEASURES, MODIFIER]
    data = random_users.select(*measures).toPandas()
    for s in fit_power_scales(random_users, measures):
        best = likelihood(data[s.measure], s.power)
        assert s.log_likelihood == pytest.approx(best, rel=1e-6)
        for step in (0.01, 0.1, 1.0):
            assert best >= likelihood(data[s.measure], s.power - step)
            assert best >= likelihood(data[s.measure], s.power + step)


@pytest.mark.parametrize(
    "xs, power", [([10] * 950 + [1] * 50, 11.7), ([0] * 960 + [1] * 30 + [2] * 10, None), ([0] * 300 + [1], None)]
)
def test_powers_have_no_bound(spark, xs, power):
    """The best power is found wherever it lies, on either side."""
    df = users_frame(spark, [{"event_orders": x} for x in xs])
    (scale,) = fit_power_scales(df, ["event_orders"])
    assert not -8 < scale.power < 8
    if power:
        assert scale.power == pytest.approx(power, abs=0.1)
    around = [scale.power + d for d in np.linspace(-5, 5, 201)]
    assert likelihood(xs, scale.power) >= max(likelihood(xs, p) for p in around) - 1e-6


def test_rare_measures_have_powers_far_below_zero(spark):
    rng = random.Random(3)
    rows = [{"event_orders": rng.choice([1, 2]) if i % 25 == 0 else 0, "direct_contributions": 1 + i % 3} for i in range(400)]
    df = active_cohort(users_frame(spark, rows), CFG)
    (scale,) = fit_power_scales(df, ["event_orders"])
    xs = [r.event_orders for r in df.collect()]
    assert scale.power < -5
    assert likelihood(xs, scale.power) > likelihood(xs, -2.0)
    grid = [scale.power + d for d in np.linspace(-10, 10, 401)]
    assert likelihood(xs, scale.power) >= max(likelihood(xs, p) for p in grid) - 1e-6


def test_power_features_are_standard(random_users):
    scales = fit_power_scales(random_users, CLUSTER_MEASURES)
    df = add_power_features(random_users, scales)
    for m in CLUSTER_MEASURES:
        row = df.agg(
            F.avg(f"{m}_yeojohnson").alias("mean"),
            F.stddev_pop(f"{m}_yeojohnson").alias("sd"),
            F.min(f"{m}_yeojohnson_scaled").alias("low"),
            F.max(f"{m}_yeojohnson_scaled").alias("high"),
        ).first()
        assert row.mean == pytest.approx(0, abs=1e-6)
        assert row.sd == pytest.approx(1, abs=1e-6)
        assert (row.low, row.high) == (pytest.approx(0), pytest.approx(1))


def test_statistics(random_users, spark):
    data = random_users.toPandas()
    pies = {r.measure: r for r in stats.class_pies(random_users).collect()}
    assert len(pies) == 13
    for m, r in pies.items():
        assert r.users_with == (data[m] > 0).sum()
        assert r.users_with + r.users_without == len(data)
    bins = stats.histogram(random_users).collect()
    assert max(r.activities for r in bins) == 20
    for m in pies:
        assert sum(r.users for r in bins if r.measure == m) == pies[m].users_with
    share = stats.class_user_share(users_frame(spark, [{"event_orders": 1}, {}, {}]), CFG)
    row = share.filter("measure = 'event_orders'").first()
    assert (row.users, row.percent_of_all, row.percent_of_counted) == (1, 33.33, 100.0)


SMALL = dict(clusters=4, restarts=3, max_iter=50, elbow_ks=(1, 2, 4, 8))


def test_clusters(random_users, stages):
    cfg = config(**SMALL)
    scales = fit_power_scales(random_users, CLUSTER_MEASURES)
    points = cluster_points(random_users, scales, stages)
    # A third of the users are one point.
    assert points.agg(F.sum("users")).first()[0] == random_users.count()
    assert points.count() < random_users.count() * 3 / 4 + 2
    model = fit_clusters(points, cfg)
    logged = add_log_features(random_users, fit_log_scales(random_users))
    users = model.assign(logged, scales, cfg).cache()
    assert users.count() == random_users.count() == users.select("user_id").distinct().count()
    sizes = [r.users for r in cluster_sizes(users).orderBy("cluster").collect()]
    assert sizes == sorted(sizes, reverse=True) and len(sizes) == 4
    again = fit_clusters(cluster_points(random_users.repartition(7), scales, stages), cfg)
    assert again.cost == pytest.approx(model.cost)
    assert again.assign(random_users, scales, cfg).select("user_id", "cluster").exceptAll(
        users.select("user_id", "cluster")
    ).isEmpty()
    profile = cluster_profile(users).collect()
    assert [r.cluster for r in profile] == [1, 2, 3, 4]
    assert {r.cluster_name for r in profile} == {"Cluster 1", "Cluster 2", "Cluster 3", "Cluster 4"}
    # Profiled clusters lead in the measure that their title states.
    for measure, _ in TOP_PROFILES:
        at = CLUSTER_MEASURES.index(measure)
        number_at = {n: p for p, n in model.numbers.items()}
        centers = model.centers()
        assert centers[number_at[model.leader(measure)]][at] == max(c[at] for c in centers)
    shown = user_profiles(users, model, cfg).collect()
    assert {r.title for r in shown} == {t for _, t in TOP_PROFILES} | {SAMPLE_TITLE}
    bins = stats.cluster_histogram(users, cfg)
    assert bins.agg(F.max("activities")).first()[0] == 10

    # The cost is that of the users themselves: squared distances to their own centres.
    centers = np.array(model.centers())
    columns = [f"{m}_yeojohnson" for m in CLUSTER_MEASURES]
    data = add_power_features(users, scales).select("cluster", *columns).toPandas()
    number_of = {n: p for p, n in model.numbers.items()}
    x = np.floor(data[columns].to_numpy(float) * GRID + 0.5) / GRID
    cost = ((x - centers[[number_of[c] for c in data["cluster"]]]) ** 2).sum()
    assert model.cost == pytest.approx(cost)
    # No user is nearer to another centre, and no step of the plain algorithm makes it cheaper.
    apart = ((x[:, None, :] - centers[None]) ** 2).sum(axis=2)
    assert (apart.min(axis=1) >= apart[np.arange(len(x)), [number_of[c] for c in data["cluster"]]] - 1e-9).all()
    own = np.array([number_of[c] for c in data["cluster"]])
    means = np.array([x[own == i].mean(axis=0) for i in range(len(centers))])
    assert ((x[:, None, :] - means[None]) ** 2).sum(axis=2).min(axis=1).sum() > cost - 0.01


def plain_fit(points, starts, k):
    """The same rules, point by point."""
    heavy = sorted(points, key=lambda p: (-points[p], p))[:starts]
    fits = []
    for first in heavy:
        centers = [first]
        while len(centers) < k:
            d = {p: min(sum((a - b) ** 2 for a, b in zip(p, c)) for c in centers) for p in points}
            far = min(points, key=lambda p: (-float(points[p]) * float(d[p]), p))
            if not d[far]:
                break
            centers.append(far)
        best = None
        while True:
            near = {p: min((sum((a - b) ** 2 for a, b in zip(p, c)), i) for i, c in enumerate(centers)) for p in points}
            cost = sum(points[p] * near[p][0] for p in points)
            if best is not None and cost >= best[0]:
                break
            best = cost, centers
            held = {i: [p for p in points if near[p][1] == i] for i in range(len(centers))}
            centers = [
                tuple((2 * sum(points[p] * p[j] for p in held[i]) + w) // (2 * w) for j in range(len(c))) if (w := sum(points[p] for p in held[i])) else c
                for i, c in enumerate(centers)
            ]
        fits.append(best)
    return min(fits, key=lambda f: f[0])


@pytest.mark.parametrize("seed, size", [(1, 40), (2, 9), (3, 3), (4, 1)])
def test_fit_is_exact(spark, seed, size):
    """Equal to the rules point by point; ties, hot points and fewer points than clusters included."""
    rng = random.Random(seed)
    dims = len(CLUSTER_MEASURES)
    points = {tuple(rng.randrange(-3, 4) * GRID for _ in range(dims)): rng.choice([1, 1, 2, 10**9]) for _ in range(size)}
    rows = [([x / GRID for x in p], list(p), n) for p, n in points.items()]
    df = spark.createDataFrame(rows, "x array<double>, grid array<long>, users long").repartition(5)
    model = fit_clusters(df, config(clusters=5, restarts=4, max_iter=100))
    cost, centers = plain_fit(points, 4, 5)
    assert model.grid_centers == centers
    assert model.cost == cost / GRID**2
    curve = elbow(df, config(elbow_ks=(1, 2, 3, 4, 5))).orderBy("k").collect()
    costs = [r.inertia for r in curve[1:]]
    assert costs == sorted(costs, reverse=True)
    assert costs[-1] == min(plain_fit(points, 1, k)[0] for k in (2, 3, 4, 5)) / GRID**2


def test_no_points(spark):
    df = spark.createDataFrame([], "x array<double>, grid array<long>, users long")
    model = fit_clusters(df, config(**SMALL))
    assert (model.grid_centers, model.numbers, model.cost) == ([], {}, 0.0)


def test_elbow(random_users, stages):
    scales = fit_power_scales(random_users, CLUSTER_MEASURES)
    curve = elbow(cluster_points(random_users, scales, stages), config(**SMALL)).orderBy("k").collect()
    assert [r.k for r in curve] == [1, 2, 4, 8]
    costs = [r.inertia for r in curve]
    assert costs == sorted(costs, reverse=True)
    # Standardized features: one cluster costs the number of users times the features that vary.
    varying = sum(s.deviation > 0 for s in scales)
    assert costs[0] == pytest.approx(random_users.count() * varying)


def test_clusters_without_a_name(random_users, stages):
    cfg = config(**SMALL, cluster_names={1: ("big", "Big One")}, cluster_display_order=("big",))
    scales = fit_power_scales(random_users, CLUSTER_MEASURES)
    model = fit_clusters(cluster_points(random_users, scales, stages), cfg)
    names = {r.cluster_name for r in model.assign(random_users, scales, cfg).collect()}
    assert names == {"big", "Cluster 2", "Cluster 3", "Cluster 4"}


def test_projection(random_users):
    scales = fit_power_scales(random_users, CLUSTER_MEASURES)
    xy = project(random_users, scales).select("user_id", "x", "y").toPandas()
    assert xy["x"].var() >= xy["y"].var() > 0
    columns = [f"{m}_yeojohnson" for m in CLUSTER_MEASURES]
    data = add_power_features(random_users, scales).select("user_id", *columns).toPandas()
    features = data.set_index("user_id")[columns].to_numpy()
    spectrum = np.linalg.eigvalsh(np.cov(features.T))
    assert xy["x"].var() == pytest.approx(spectrum[-1])
    assert xy["y"].var() == pytest.approx(spectrum[-2])


def grouped(spark, size=2000):
    """One group holds nearly all rows."""
    return spark.range(size).selectExpr(
        "id AS user_id",
        "concat('u', id) AS user_slug",
        "CASE WHEN id < 5 THEN 'small' ELSE 'big' END AS g",
        "id % 50 AS v",
    )


def test_top_per_group(spark):
    df = top_per_group(grouped(spark), "g", [F.desc("v"), "user_id"], 3)
    rows = sorted((r.g, r.position, r.user_id) for r in df.collect())
    assert rows == [("big", 1, 49), ("big", 2, 99), ("big", 3, 149), ("small", 1, 4), ("small", 2, 3), ("small", 3, 2)]
    # Each task keeps its best rows before the shuffle.
    plan = plan_of(df)
    assert plan.count("WindowGroupLimit") >= 2


def test_sample_per_group_is_reproducible(spark):
    def draw(df, seed):
        return {(r.g, r.position): r.user_id for r in sample_per_group(df, "g", 10, seed).collect()}

    one = draw(grouped(spark), 42)
    assert len(one) == 15
    assert one == draw(grouped(spark).repartition(7, "v"), 42)
    assert one != draw(grouped(spark), 43)


def test_links(spark):
    sample = sample_per_group(grouped(spark, 3), "g", 10, 1)
    order = [r.user_slug for r in sample.orderBy("position").collect()]
    link = group_links(sample, "g", "https://example.org/").first().links
    assert link == ", ".join(f'<a href="https://example.org/{s}">{s}</a>' for s in order)


def test_profiles(random_users):
    logged = add_log_features(random_users, fit_log_scales(random_users))
    named = logged.withColumn("cluster_name", F.expr("CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END"))
    top = top_users(named, CFG, [("even", "event_orders", "Even")], "cluster_name").collect()
    best = [r.user_id for r in named.filter("user_id % 2 = 0").orderBy(F.desc("event_orders"), "user_id").limit(8).collect()]
    assert [r.user_id for r in sorted(top, key=lambda r: r.position)] == best
    mixed = mixed_sample(named, CFG, ["even", "odd"], "cluster_name").collect()
    assert sorted(r.position for r in mixed) == list(range(1, 9))
    assert len({r.user_id for r in mixed}) == 8
