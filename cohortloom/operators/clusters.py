"""k-means cohorts, their numbering, profiles and map.

Users with the same counts are the same point, and most users share a few points. The points are
therefore counted first, and k-means runs on distinct points with their number of users as weight,
which minimizes the same cost.

All of k-means is whole-number arithmetic: features are rounded to ``GRID`` parts of a deviation, and
so are centres. Sums and costs are then exact, and the fit is the same however the users are stored,
in whatever order tasks end, and in any other engine. Starts are not random but chosen from the points
by weight and distance. Every round is one job over the points for all starts (or all numbers of
clusters) together; it returns a row per start and cluster.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.config import (
    CLUSTER_MEASURES,
    PROFILE_MEASURES,
    SAMPLE_TITLE,
    TOP_PROFILES,
    Config,
)
from cohortloom.operators.power import PowerScale
from cohortloom.operators.sampling import sample_per_group, top_per_group
from cohortloom.sources.stages import StageArea
from cohortloom.sources.tables import small_table

# Parts of a deviation. Distances fit 64 bits up to 14,000 deviations; beyond, Spark's arithmetic fails
# rather than wrapping around.
GRID = 1 << 16
Center = tuple[int, ...]


def with_features(df: DataFrame, scales: Sequence[PowerScale]) -> DataFrame:
    """Add the feature vector of the standardized cluster measures."""
    by_name = {s.measure: s for s in scales}
    inputs = {f"_f{i}": by_name[m].standardized() for i, m in enumerate(CLUSTER_MEASURES)}
    assembled = VectorAssembler(inputCols=list(inputs), outputCol="features").transform(
        df.withColumns(inputs)
    )
    return assembled.drop(*inputs)


def grid_features(scales: Sequence[PowerScale]) -> Column:
    """The standardized cluster measures as whole parts of a deviation."""
    by_name = {s.measure: s for s in scales}
    return F.array(
        *(F.floor(by_name[m].standardized() * GRID + 0.5).cast("long") for m in CLUSTER_MEASURES)
    )


def cluster_points(
    users: DataFrame, scales: Sequence[PowerScale], stages: StageArea, rows_per_task: int = 20_000
) -> DataFrame:
    """Distinct points (x, grid) with their number of users, written once; all rounds read them."""
    by_name = {s.measure: s for s in scales}
    counted = stages.save(
        users.groupBy(*CLUSTER_MEASURES).agg(F.count(F.lit(1)).alias("users")), "cluster_counts"
    )
    partitions = counted.count() // rows_per_task + 1
    placed = counted.repartition(partitions, *CLUSTER_MEASURES)
    x = F.array(*(by_name[m].standardized().cast("double") for m in CLUSTER_MEASURES))
    return stages.save(placed.select(x.alias("x"), grid_features(scales).alias("grid"), "users"), "cluster_points")


def center_lists(lists: Sequence[Sequence[Center]], ids: Sequence[int]) -> Column:
    """(id, centers) of every start as one literal, which stays out of the generated code."""
    rows = json.dumps([{"id": i, "centers": [list(c) for c in cs]} for i, cs in zip(ids, lists)])
    return F.from_json(F.lit(rows), "array<struct<id:int,centers:array<array<bigint>>>>")


def _distance(grid: str) -> str:
    return " + ".join(f"({grid}[{i}] - c[{i}]) * ({grid}[{i}] - c[{i}])" for i in range(len(CLUSTER_MEASURES)))


def distances(grid: str, centers: str) -> Column:
    """Squared distances to all centres."""
    return F.expr(f"transform({centers}, c -> {_distance(grid)})")


def _nearest(grid: str, centers: str) -> Column:
    """(d, n): squared distance and place of the nearest centre; of equally near ones the first."""
    return F.expr(f"array_min(transform({centers}, (c, i) -> struct({_distance(grid)} AS d, i AS n)))")


def _near(points: DataFrame, lists: Sequence[Sequence[Center]], ids: Sequence[int]) -> DataFrame:
    """Every point once for each start, with its nearest centre."""
    spread = points.select("grid", "users", F.explode(center_lists(lists, ids)).alias("s"))
    return spread.select(F.col("s.id").alias("id"), "grid", "users", _nearest("grid", "s.centers").alias("near"))


def first_centers(points: DataFrame, starts: int, k: int) -> list[list[Center]]:
    """Starting centres: the heaviest points, one for each start, then the farthest by weight.

    Each next centre is the point with the largest product of users and squared distance from the
    centres so far; of equal ones the one with the smallest features. The first centres of a start
    with fewer clusters are the same. A start ends early when every point is a centre.
    """
    heavy = points.orderBy(F.desc("users"), "grid").limit(starts).select("grid").collect()
    lists = [[tuple(r.grid)] for r in heavy]
    growing = list(range(len(lists)))
    for _ in range(k - 1):
        if not growing:
            break
        near = _near(points, [lists[i] for i in growing], growing)
        far = F.col("users").cast("double") * F.col("near.d").cast("double")
        scored = near.select("id", F.struct((-far).alias("score"), "grid").alias("far"))
        chosen = scored.groupBy("id").agg(F.min("far").alias("far"))
        growing = []
        for r in chosen.collect():  # one row per start
            if r.far.score < 0:
                lists[r.id].append(tuple(r.far.grid))
                growing.append(r.id)
    return lists


@dataclass
class Fit:
    """A state of one start: its centres, what they cost, and how many users each has."""

    centers: list[Center]
    cost: int | None = None
    sizes: dict[int, int] = field(default_factory=dict)


def refine(points: DataFrame, starts: dict[int, list[Center]], max_iter: int) -> dict[int, Fit]:
    """Move the centres of every start to the mean of their users as long as the cost falls.

    Means are rounded to whole parts; a centre without users stays where it is.
    """
    best: dict[int, Fit] = {}
    now = dict(starts)
    total = [F.expr(f"sum(users * grid[{i}])").alias(f"s{i}") for i in range(len(CLUSTER_MEASURES))]
    for _ in range(max_iter):
        if not now:
            break
        near = _near(points, list(now.values()), list(now))
        sums = near.groupBy("id", F.col("near.n").alias("n")).agg(
            F.sum("users").alias("users"),
            F.sum(F.col("near.d").cast("decimal(20,0)") * F.col("users")).alias("cost"),
            *total,
        )
        rows: dict[int, dict] = {}
        for r in sums.collect():  # one row per start and cluster
            rows.setdefault(r.id, {})[r.n] = r
        moved = {}
        for i, found in rows.items():
            cost = sum(int(r.cost) for r in found.values())
            if i in best and cost >= best[i].cost:
                continue
            best[i] = Fit(now[i], cost, {n: r.users for n, r in found.items()})
            moved[i] = [
                tuple((2 * r[f"s{d}"] + r.users) // (2 * r.users) for d in range(len(center))) if (r := found.get(n)) else center
                for n, center in enumerate(now[i])
            ]
        now = moved
    return best


@dataclass(frozen=True)
class ClusterModel:
    """The best of several k-means fits, with a numbering that does not depend on the start."""

    grid_centers: list[Center]
    numbers: dict[int, int]  # place in the list of centres -> number from 1
    cost: float

    def centers(self) -> list[list[float]]:
        """Centres in deviations."""
        return [[x / GRID for x in c] for c in self.grid_centers]

    def assign(self, users: DataFrame, scales: Sequence[PowerScale], cfg: Config) -> DataFrame:
        """Add ``cluster`` (from 1) and its short and full name."""
        numbers = F.create_map(*[F.lit(v) for pair in self.numbers.items() for v in pair])
        held = users.withColumns({"_grid": grid_features(scales), "_centers": center_lists([self.grid_centers], [0])[0]["centers"]})
        numbered = held.withColumn("cluster", numbers[_nearest("_grid", "_centers")["n"]])
        return add_cluster_names(numbered.drop("_grid", "_centers"), cfg)

    def leader(self, measure: str) -> int:
        """Number of the cluster whose centre is largest in a measure; of equals the first."""
        place = CLUSTER_MEASURES.index(measure)
        return min(self.numbers.items(), key=lambda pair: (-self.grid_centers[pair[0]][place], pair[1]))[1]


def cluster_names_frame(spark: SparkSession, cfg: Config) -> DataFrame:
    """Number, names and place of each named cluster.

    Numbers follow the sizes of one fit, so names belong to a saved model and its analyst.
    """
    place = {name: i + 1 for i, name in enumerate(cfg.cluster_display_order)}
    rows = [(k, s, f, place.get(s)) for k, (s, f) in sorted(cfg.cluster_names.items())]
    schema = "cluster int, cluster_name string, cluster_full_name string, display_order int"
    return small_table(spark, rows, schema)


def add_cluster_names(df: DataFrame, cfg: Config) -> DataFrame:
    """Add short name, full name and place in the display order.

    A cluster without a given name is called by its number and shown last.
    """
    names = cluster_names_frame(df.sparkSession, cfg)
    fallback = F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))
    return df.join(F.broadcast(names), "cluster", "left").withColumns(
        {c: F.coalesce(c, fallback) for c in ("cluster_name", "cluster_full_name")}
    )


def fit_clusters(points: DataFrame, cfg: Config) -> ClusterModel:
    """Best of ``cfg.restarts`` fits by cost; of equally good ones the first.

    Clusters are numbered by size, equal ones by their centres.
    """
    lists = first_centers(points, cfg.restarts, cfg.clusters)
    fits = refine(points, dict(enumerate(lists)), cfg.max_iter)
    if not fits:
        return ClusterModel([], {}, 0.0)
    best = min(fits.items(), key=lambda pair: (pair[1].cost, pair[0]))[1]
    ranked = sorted(range(len(best.centers)), key=lambda i: (-best.sizes.get(i, 0), best.centers[i]))
    numbers = {place: number + 1 for number, place in enumerate(ranked)}
    return ClusterModel(best.centers, numbers, best.cost / GRID**2)


def _total_squares(points: DataFrame) -> float:
    """Cost of a single cluster: squared distances from the mean, over all features."""
    features = range(len(CLUSTER_MEASURES))
    weight, x = F.col("users"), F.col("x")
    sums = [F.sum(weight).alias("w")]
    sums += [F.sum(weight * x[i]).alias(f"s{i}") for i in features]
    sums += [F.sum(weight * x[i] * x[i]).alias(f"q{i}") for i in features]
    row = points.agg(*sums).first()
    return float(sum(row[f"q{i}"] - row[f"s{i}"] ** 2 / row.w for i in features)) if row.w else 0.0


def elbow(points: DataFrame, cfg: Config) -> DataFrame:
    """Least cost found for at most k clusters, for every k.

    The fits of all k begin with the first centres of one start and go on together, a job a round.
    """
    ks = sorted(k for k in cfg.elbow_ks if k > 1)
    costs = {1: _total_squares(points)} if 1 in cfg.elbow_ks else {}
    lists = first_centers(points, 1, max(ks)) if ks else []
    if lists:
        fits = refine(points, {k: lists[0][:k] for k in ks}, cfg.max_iter)
        least = None
        for k in ks:
            least = fits[k].cost if least is None else min(least, fits[k].cost)
            costs[k] = least / GRID**2
    return small_table(points.sparkSession, sorted(costs.items()), "k int, inertia double")


def cluster_sizes(clustered: DataFrame) -> DataFrame:
    return clustered.groupBy("cluster", "cluster_full_name").agg(F.count(F.lit(1)).alias("users"))


def cluster_profile(clustered: DataFrame) -> DataFrame:
    """Names, size and mean normalized logs per cluster, in display order."""
    means = [F.avg(f"{m}_norm_log").alias(f"{m}_norm_log") for m in PROFILE_MEASURES]
    names = ["cluster", "cluster_name", "cluster_full_name", "display_order"]
    return (
        clustered.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("users"), *means)
        .orderBy(F.asc_nulls_last("display_order"), "cluster")
    )


def project(users: DataFrame, scales: Sequence[PowerScale]) -> DataFrame:
    """Two principal components per user, for a map of the cohorts.

    The sign of a component is arbitrary; the largest loading is made positive.
    """
    featured = with_features(users, scales)
    model = PCA(k=2, inputCol="features", outputCol="components").fit(featured)
    loadings = model.pc.toArray()
    signs = [1.0 if max(col, key=abs) >= 0 else -1.0 for col in loadings.T.tolist()]
    xy = vector_to_array("components")
    return (
        model.transform(featured)
        .withColumns({"x": xy[0] * signs[0], "y": xy[1] * signs[1]})
        .drop("features", "components")
    )


def _profile_columns(title: str | Column, position: str = "position") -> list[Column]:
    label = F.lit(title) if isinstance(title, str) else title
    return [
        label.alias("title"),
        F.col(position).alias("position"),
        F.col("user_id"),
        F.col("user_slug"),
        *[F.col(f"{m}_norm_log") for m in PROFILE_MEASURES],
    ]


def top_users(
    clustered: DataFrame,
    cfg: Config,
    picks: Sequence[tuple[str | int, str, str]],
    group: str = "cluster",
) -> DataFrame:
    """The most active users of some clusters, each by one measure.

    ``picks`` lists (cluster, measure, title); a cluster may be picked by several measures.
    """
    listed = F.array(
        *(
            F.struct(F.lit(g).alias("g"), F.lit(i).alias("pick"), F.lit(title).alias("title"), F.col(m).cast("double").alias("by"))
            for i, (g, m, title) in enumerate(picks)
        )
    )
    chosen = clustered.filter(F.col(group).isin(*{p[0] for p in picks}))
    picked = chosen.withColumn("_pick", F.explode(F.filter(listed, lambda p: p["g"] == F.col(group))))
    picked = picked.withColumns({"_n": F.col("_pick.pick"), "_by": F.col("_pick.by"), "_title": F.col("_pick.title")})
    ranked = top_per_group(picked, "_n", [F.desc("_by"), "user_id"], cfg.users_per_cluster)
    return ranked.select(*_profile_columns(F.col("_title")))


def mixed_sample(
    clustered: DataFrame, cfg: Config, names: Sequence[str | int], group: str = "cluster"
) -> DataFrame:
    """A random sample of random samples of some clusters."""
    chosen = clustered.filter(F.col(group).isin(*names))
    per_cluster = sample_per_group(chosen, group, cfg.users_per_cluster, cfg.seed)
    # The second draw has its own seed, so that it does not repeat the order of the first.
    drawn = per_cluster.withColumn("draw", F.lit(1))
    drawn = sample_per_group(drawn, "draw", cfg.users_per_cluster, cfg.seed + 1)
    return drawn.select(*_profile_columns(SAMPLE_TITLE))


def user_profiles(clustered: DataFrame, model: ClusterModel, cfg: Config) -> DataFrame:
    """All profiled users: the most active ones of the clusters that lead in a measure, and a mixed
    sample of the other clusters."""
    picks = [(model.leader(m), m, title) for m, title in TOP_PROFILES]
    rest = sorted(set(model.numbers.values()) - {p[0] for p in picks})
    return top_users(clustered, cfg, picks).unionByName(mixed_sample(clustered, cfg, rest or [p[0] for p in picks]))
