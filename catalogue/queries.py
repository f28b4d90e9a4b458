"""The registered queries. Each takes a session and a folder of source tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.config import (
    CLUSTER_MEASURES,
    FEATURE_MEASURES,
    LIST_COLUMNS,
    MEASURES,
    MODIFIER,
    PROFILE_MEASURES,
)
from cohortloom.functions.columns import parse_list
from cohortloom.operators import clusters, stats
from cohortloom.operators.classify import classify_contributions, classify_expenses
from cohortloom.operators.counting import active_users, class_counts, class_lists, whole_lists
from cohortloom.operators.features import (
    active_cohort,
    add_log_features,
    counted_users,
    fit_log_scales,
)
from cohortloom.operators.filters import activity_range
from cohortloom.operators.hierarchy import TREES, host_account_totals, smallest_expenses, top_hosts
from cohortloom.operators.money import expense_rollup, income_rollup
from cohortloom.operators.power import add_power_features, fit_power_scales
from cohortloom.operators.report import headline_numbers, manifest
from cohortloom.operators.sampling import group_links, sample_per_group
from cohortloom.plans import cohort, moneyflow
from cohortloom.plans.report import cluster_links
from cohortloom.sources.sample import CONFIG, SampleTables
from cohortloom.sources.stages import StageArea
from cohortloom.sources.tables import (
    account_columns,
    cohort_export_schema,
    load_cohort_export,
    read_rollup,
    small_table,
    write_list_text,
    write_rollup,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(query: Query) -> Query:
    QUERIES[query.__name__] = query
    return query


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison, lists as text."""

    def shown(name: str, kind: str):
        if kind == "double":
            # Adding zero turns -0.0 into 0.0.
            return (F.round(name, places) + F.lit(0.0)).alias(name)
        if kind.startswith("array"):
            return F.array_join(name, ",").alias(name)
        return F.col(name)

    return df.select(*[shown(n, k) for n, k in df.dtypes])


# --- Accounts and users ------------------------------------------------------------------------


@register
def account_dim(spark, sf_dir):
    return SampleTables(spark, sf_dir).collectives.select(*account_columns())


@register
def list_text_parse(spark, sf_dir):
    """Lists to text and back, over every class of every user."""
    t = SampleTables(spark, sf_dir)
    text = write_list_text(class_counts(t, CONFIG).drop("n", "user_slug"))
    parsed = text.select(
        "user_id",
        "activity_class",
        parse_list("hosts").alias("hosts"),
        parse_list("recipients").alias("recipients"),
    )
    return parsed.select(
        "user_id",
        "activity_class",
        F.size("hosts").alias("host_count"),
        F.element_at("hosts", -1).alias("last_host"),
        F.size("recipients").alias("recipient_count"),
        F.array_join("recipients", "|").alias("recipients"),
    )


@register
def active_users_in_window(spark, sf_dir):
    return active_users(SampleTables(spark, sf_dir), CONFIG)


@register
def expense_classes(spark, sf_dir):
    return classify_expenses(SampleTables(spark, sf_dir), CONFIG)


@register
def contribution_classes(spark, sf_dir):
    return classify_contributions(SampleTables(spark, sf_dir), CONFIG)


@register
def class_counts_long(spark, sf_dir):
    return rounded(class_counts(SampleTables(spark, sf_dir), CONFIG))


@register
def class_list_sizes(spark, sf_dir):
    """Counts and list lengths per user and class, from the items alone."""
    return class_lists(SampleTables(spark, sf_dir), CONFIG, StageArea(spark)).rows


@register
def class_list_parts(spark, sf_dir):
    """Hosts and recipients per user and class, in parts of four."""
    lists = class_lists(SampleTables(spark, sf_dir), CONFIG, StageArea(spark), size=4)
    return rounded(lists.parts.withColumn("items_in_part", F.size("items").cast("bigint")))


@register
def class_lists_whole(spark, sf_dir):
    """The class counts again, their lists put together from parts."""
    return rounded(whole_lists(class_lists(SampleTables(spark, sf_dir), CONFIG, StageArea(spark), size=4)))


@register
def log_activity_counts(spark, sf_dir):
    counts = class_counts(SampleTables(spark, sf_dir), CONFIG)
    log_classes = ("host_admin_activities", "collective_admin_activities", "virtual_card_purchases")
    kept = counts.filter(F.col("activity_class").isin(*log_classes))
    return rounded(kept.drop("recipients"))


@register
def class_scores(spark, sf_dir):
    scored = cohort.scored_classes(SampleTables(spark, sf_dir), CONFIG, StageArea(spark))
    return rounded(
        scored.select("user_id", "activity_class", "n", "log", "score", "rank", "percentile")
    )


@register
def cohort_table_wide(spark, sf_dir):
    return rounded(cohort.wide_cohort(SampleTables(spark, sf_dir), CONFIG, StageArea(spark)))


# --- Money -------------------------------------------------------------------------------------


@register
def expense_rollup_by_parent(spark, sf_dir):
    return expense_rollup(SampleTables(spark, sf_dir), CONFIG)


@register
def income_rollup_by_parent(spark, sf_dir):
    return income_rollup(SampleTables(spark, sf_dir), CONFIG)


@register
def expenses_clean(spark, sf_dir):
    return moneyflow.expense_flow(SampleTables(spark, sf_dir), CONFIG).expenses


def _money(spark, sf_dir) -> moneyflow.MoneyFlow:
    return moneyflow.money_flow(SampleTables(spark, sf_dir), CONFIG, StageArea(spark))


@register
def income_clean(spark, sf_dir):
    return _money(spark, sf_dir).income


def _tree_query(tree) -> Query:
    def query(spark, sf_dir):
        if tree.source == "expenses":
            money = moneyflow.expense_flow(SampleTables(spark, sf_dir), CONFIG)
        else:
            money = _money(spark, sf_dir)
        return tree.build(money, CONFIG)

    return query


for _tree in TREES:
    QUERIES[f"tree_{_tree.name}"] = _tree_query(_tree)


@register
def expense_totals_by_host_and_account(spark, sf_dir):
    money = moneyflow.expense_flow(SampleTables(spark, sf_dir), CONFIG)
    return host_account_totals(money.expenses)


@register
def top_hosts_by_income(spark, sf_dir):
    return top_hosts(_money(spark, sf_dir).income)


@register
def bottom_expenses(spark, sf_dir):
    return smallest_expenses(moneyflow.expense_flow(SampleTables(spark, sf_dir), CONFIG).expenses)


# --- Exports: results written as CSV with their titles, read back and analysed ------------------


def _exported_rollup(spark, stages: StageArea, df: DataFrame, name: str) -> DataFrame:
    path = f"{stages.root}/{name}"
    write_rollup(df, name, path)
    return read_rollup(spark, name, path)


def _money_from_exports(spark, sf_dir) -> moneyflow.MoneyFlow:
    t, stages = SampleTables(spark, sf_dir), StageArea(spark)
    expenses = _exported_rollup(spark, stages, expense_rollup(t, CONFIG), "expense_rollup")
    income = _exported_rollup(spark, stages, income_rollup(t, CONFIG), "income_rollup")
    return moneyflow.money_from_rollups(expenses, income, t.collectives, CONFIG, stages)


@register
def expenses_from_exports(spark, sf_dir):
    return _money_from_exports(spark, sf_dir).expenses


@register
def income_from_exports(spark, sf_dir):
    return _money_from_exports(spark, sf_dir).income


@register
def cohort_from_export(spark, sf_dir):
    """Active users of an exported cohort table, with their totals."""
    t, stages = SampleTables(spark, sf_dir), StageArea(spark)
    wide = write_list_text(cohort.wide_cohort(t, CONFIG, stages))
    path = f"{stages.root}/cohort_export"
    wide.toDF(*cohort_export_schema().names).write.options(header="true", escape='"').csv(path)
    users = stages.save(load_cohort_export(spark, path), "all_users")
    active = cohort.active_of(users, CONFIG, stages)
    return active.select("user_id", "user_slug", *MEASURES, "total_contributions", "total_expenses", "total_activities")


# --- User statistics ---------------------------------------------------------------------------


def _users(spark, sf_dir) -> DataFrame:
    """All users, for queries that read them once."""
    return cohort.all_users(SampleTables(spark, sf_dir), CONFIG, StageArea(spark))


def _active(spark, sf_dir) -> DataFrame:
    return cohort.stage_active(SampleTables(spark, sf_dir), CONFIG, StageArea(spark))


@register
def blocked_filter(spark, sf_dir):
    """Counted users that name no blocked account, with their totals."""
    stages = StageArea(spark)
    users = cohort.stage_users(SampleTables(spark, sf_dir), CONFIG, stages)
    users = counted_users(users, CONFIG)
    totals = ["total_contributions", "total_expenses", "total_activities"]
    return users.select("user_id", "user_slug", *MEASURES, *totals)


@register
def user_features(spark, sf_dir):
    active = _active(spark, sf_dir)
    featured = add_log_features(active, fit_log_scales(active))
    capped = F.least(F.col("total_activities"), F.lit(CONFIG.histogram_cap)).cast("bigint")
    return rounded(featured.withColumn("activities_bin", capped).drop(*LIST_COLUMNS))


@register
def users_in_activity_range(spark, sf_dir):
    active = _active(spark, sf_dir)
    found = activity_range(active, "collective_admin_activities", 10, 20)
    return found.select("user_id", "user_slug", "collective_admin_activities")


@register
def funnel(spark, sf_dir):
    return stats.funnel(_users(spark, sf_dir), CONFIG)


@register
def class_user_share(spark, sf_dir):
    return stats.class_user_share(_users(spark, sf_dir), CONFIG)


@register
def class_pies(spark, sf_dir):
    return stats.class_pies(active_cohort(_users(spark, sf_dir), CONFIG))


@register
def class_histogram(spark, sf_dir):
    active = active_cohort(_users(spark, sf_dir), CONFIG)
    return stats.histogram(active, cap=CONFIG.histogram_cap)


# --- Scales ------------------------------------------------------------------------------------

ALL_SCALED = (*FEATURE_MEASURES, MODIFIER)


PRECISION = 1e-4  # of the powers that SQL reproduces


@register
def yeo_johnson_lambda(spark, sf_dir):
    scales = fit_power_scales(_active(spark, sf_dir), ALL_SCALED, PRECISION)
    rows = [(s.measure, s.power, s.log_likelihood, s.mean, s.deviation) for s in scales]
    schema = "measure string, power double, log_likelihood double, mean double, deviation double"
    return rounded(small_table(spark, rows, schema), 4)


@register
def yeo_johnson_features(spark, sf_dir):
    active = _active(spark, sf_dir)
    scales = fit_power_scales(active, ALL_SCALED, PRECISION)
    featured = add_power_features(active.select("user_id", *ALL_SCALED), scales)
    return rounded(featured.drop(*ALL_SCALED), 5)


# --- Clusters ----------------------------------------------------------------------------------


def _clustered(spark, sf_dir) -> cohort.Clustered:
    stages = StageArea(spark)
    active = cohort.stage_active(SampleTables(spark, sf_dir), CONFIG, stages)
    return cohort.cluster_users(active, CONFIG, stages)


@register
def elbow(spark, sf_dir):
    stages = StageArea(spark)
    active = cohort.stage_active(SampleTables(spark, sf_dir), CONFIG, stages)
    points, _ = cohort.points_of(active, stages)
    return rounded(clusters.elbow(points, CONFIG), 4)


@register
def kmeans_sizes(spark, sf_dir):
    clustered = _clustered(spark, sf_dir).users
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("users"))


@register
def cluster_tree(spark, sf_dir):
    return clusters.cluster_sizes(_clustered(spark, sf_dir).users)


@register
def cluster_profile(spark, sf_dir):
    return rounded(clusters.cluster_profile(_clustered(spark, sf_dir).users))


@register
def cluster_histogram(spark, sf_dir):
    return stats.cluster_histogram(_clustered(spark, sf_dir).users, CONFIG)


@register
def cluster_user_profiles(spark, sf_dir):
    clustered = _clustered(spark, sf_dir)
    return rounded(clusters.user_profiles(clustered.users, clustered.model, CONFIG))


@register
def cluster_sample_links(spark, sf_dir):
    return cluster_links(_clustered(spark, sf_dir).users, CONFIG)


@register
def pca_map(spark, sf_dir):
    active = _active(spark, sf_dir)
    mapped = clusters.project(active, fit_power_scales(active, CLUSTER_MEASURES))
    return rounded(mapped.select("user_id", "user_slug", *PROFILE_MEASURES, "x", "y"))


# Invariants, whatever the start of k-means.


@register
def elbow_of_one(spark, sf_dir):
    """The cost of a single cluster."""
    stages = StageArea(spark)
    points, _ = cohort.points_of(_active(spark, sf_dir), stages)
    return rounded(clusters.elbow(points, replace(CONFIG, elbow_ks=(1,))), 4)


@register
def feature_totals(spark, sf_dir):
    """Sum and sum of squares of every feature: those of standardized values."""
    active = _active(spark, sf_dir)
    featured = clusters.with_features(active, fit_power_scales(active, CLUSTER_MEASURES))
    x = vector_to_array("features")
    parts = F.array(*(F.struct(F.lit(m).alias("measure"), x[i].alias("x")) for i, m in enumerate(CLUSTER_MEASURES)))
    rows = featured.select(F.explode(parts).alias("f")).select("f.measure", "f.x")
    totals = rows.groupBy("measure").agg(F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))
    return rounded(totals, 4)


@register
def cluster_checks(spark, sf_dir):
    """Invariants of a fit: sizes, nearest centres, numbering, leaders, and counts on the map."""
    fitted = _clustered(spark, sf_dir)
    model = fitted.model
    centers = {model.numbers[p]: c for p, c in enumerate(model.grid_centers)}
    placed = fitted.users.withColumn("grid", clusters.grid_features(fitted.scales))
    lists = [[centers[n] for n in sorted(centers)]]
    far = clusters.distances("grid", "s.centers")
    placed = placed.select("cluster", F.explode(clusters.center_lists(lists, [0])).alias("s"), "grid").select("cluster", far.alias("d"))
    farther = placed.filter(F.element_at("d", F.col("cluster")) > F.array_min("d"))
    sizes = [r.users for r in clusters.cluster_sizes(fitted.users).orderBy("cluster").collect()]  # one row per cluster
    mapped = clusters.project(fitted.users, fitted.scales)
    sums = mapped.agg(*(F.sum(m).alias(m) for m in PROFILE_MEASURES)).first()
    wrong = sum(
        1
        for m in PROFILE_MEASURES
        if any(c[CLUSTER_MEASURES.index(m)] > centers[fitted.model.leader(m)][CLUSTER_MEASURES.index(m)] for c in centers.values())
    )
    rows = [
        ("users", sum(sizes)),
        ("clusters", len(sizes)),
        ("users_nearer_to_another_centre", farther.count()),
        ("clusters_larger_than_the_one_before", sum(b > a for a, b in zip(sizes, sizes[1:]))),
        ("clusters_led_by_another_measure", wrong),
        *((f"map_{m}", sums[m]) for m in PROFILE_MEASURES),
    ]
    return small_table(spark, rows, "metric string, value bigint")


@register
def cluster_name_table(spark, sf_dir):
    """An analyst's names and order; the cluster without a name is called by its number."""
    cfg = replace(CONFIG, cluster_names={1: ("many", "The Many"), 2: ("few", "The Few")}, cluster_display_order=("few", "many"))
    numbers = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.col("n_nationkey") % 3 + 1).cast("int").alias("cluster"))
    return clusters.add_cluster_names(numbers.distinct(), cfg).select("cluster", "cluster_name", "cluster_full_name", "display_order")


# The same group operators, with the market segment of a user's account in place of the cluster:
# a grouping that another engine can reproduce.

SEGMENT_PICKS = (
    ("AUTOMOBILE", "host_admin_activities", "Host admins"),
    ("BUILDING", "collective_admin_activities", "Collective admins"),
    ("FURNITURE", "expense_activities", "Expense submitters"),
)
SAMPLED_SEGMENTS = ("AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "MACHINERY")


def _by_segment(spark, sf_dir) -> DataFrame:
    active = _active(spark, sf_dir)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment")
    )
    return add_log_features(active, fit_log_scales(active)).join(customers, "user_id")


@register
def segment_top_users(spark, sf_dir):
    users = _by_segment(spark, sf_dir)
    return rounded(clusters.top_users(users, CONFIG, SEGMENT_PICKS, "segment"))


@register
def segment_mixed_sample(spark, sf_dir):
    users = _by_segment(spark, sf_dir)
    return rounded(clusters.mixed_sample(users, CONFIG, SAMPLED_SEGMENTS, "segment"))


@register
def segment_sample_links(spark, sf_dir):
    users = _by_segment(spark, sf_dir).select("segment", "user_id", "user_slug")
    sample = sample_per_group(users, "segment", CONFIG.links_per_cluster, CONFIG.seed)
    return group_links(sample, "segment", CONFIG.profile_url)


@register
def segment_profile(spark, sf_dir):
    users = _by_segment(spark, sf_dir)
    means = [F.avg(f"{m}_norm_log").alias(f"{m}_norm_log") for m in PROFILE_MEASURES]
    return rounded(users.groupBy("segment").agg(F.count(F.lit(1)).alias("users"), *means))


@register
def segment_histogram(spark, sf_dir):
    users = _by_segment(spark, sf_dir)
    return stats.histogram(users, PROFILE_MEASURES, CONFIG.cluster_histogram_cap, ["segment"])


# --- Report ------------------------------------------------------------------------------------


@register
def headline_figures(spark, sf_dir):
    numbers = headline_numbers(_users(spark, sf_dir), _money(spark, sf_dir), CONFIG)
    return rounded(numbers, 2)


@register
def report_manifest(spark, sf_dir):
    """Sections, items and result sizes of the parts that need no clustering."""
    stages = StageArea(spark)
    t = SampleTables(spark, sf_dir)
    active = cohort.stage_active(t, CONFIG, stages)
    money = moneyflow.money_flow(t, CONFIG, stages)
    results = {
        "funnel": stats.funnel(stages.tables["all_users"], CONFIG),
        "class_histogram": stats.histogram(active, cap=CONFIG.histogram_cap),
        **{f"tree_{name}": df for name, df in moneyflow.all_trees(money, CONFIG).items()},
    }
    return manifest(results, CONFIG)
