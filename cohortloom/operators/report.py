"""Data of the report: its sections and its headline numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import CHART_MEASURES, SAMPLE_TITLE, TOP_PROFILES, Config
from cohortloom.functions.columns import anchor_id, percent_of
from cohortloom.operators.hierarchy import TREES
from cohortloom.operators.money import MoneyFlow
from cohortloom.operators.stats import funnel
from cohortloom.sources.tables import small_table

MANIFEST_SCHEMA = (
    "section_ord int, section_id string, section_title string, item_ord int, title string, "
    "description string, result_name string"
)


def measure_title(measure: str) -> str:
    return measure.replace("_", " ").title()


def _tree_items(*names: str) -> list[tuple]:
    titles = {tree.name: tree.title for tree in TREES}
    return [(None, titles[n], f"tree_{n}") for n in names]


def _sections(cfg: Config) -> list[tuple[str, str, list[tuple]]]:
    """(id, title, items); an item is (title or None, description, result name).

    Fixed values: ids, titles and order of the sections.
    """
    measures = [
        (measure_title(m), f"Users with {measure_title(m)}, and users by number of them", m)
        for m in CHART_MEASURES
    ]
    names = {n: cfg.cluster_names.get(n, (f"Cluster {n}",) * 2) for n in range(1, cfg.clusters + 1)}
    place = {short: i for i, short in enumerate(cfg.cluster_display_order)}
    shown = sorted(names, key=lambda n: (place.get(names[n][0], len(place)), n))
    clusters = [
        (names[n][1], f"Average activity scores of {names[n][1]}", "cluster_profile") for n in shown
    ]
    profiles = [
        (title, f"The most active users by {measure_title(measure)}", "user_profiles")
        for measure, title in TOP_PROFILES
    ]
    profiles.append((SAMPLE_TITLE, "Users drawn from several clusters", "user_profiles"))
    return [
        ("intro", "Users, Hosts and Collectives", []),
        ("active-users", "Active Users", [(None, "Users by level of activity", "funnel")]),
        ("user-activity-counts", "User Activity", measures),
        ("user-cluster-intro", "User Clustering", [(None, "Users per cluster", "cluster_tree")]),
        ("user-clusters", "User Clusters", clusters),
        (
            "user-clusters-map",
            "User Clusters: Map",
            [("User Clusters in 2D Space", "Two principal components per user", "pca_map")],
        ),
        ("user-profiles", "User Profiles", profiles),
        ("collective-analysis", "Collective Analysis", []),
        (
            "collective-expenses",
            "Collective Expenses",
            _tree_items("expense_amount_by_host", "expense_count_by_host"),
        ),
        (
            "collective-expenses-by-hostfee",
            "Expenses by Host Fee",
            _tree_items("expense_amount_by_fee", "expense_count_by_fee"),
        ),
        (
            "collective-income-by-host-and-method",
            "Tip Potential: Income by Host and Method",
            _tree_items("income_by_fee_and_method"),
        ),
        (
            "collective-tips",
            "Tip Income: Tip Income by Host and Collective",
            _tree_items("tips_by_fee"),
        ),
        (
            "crowdfunding",
            "Crowdfunding Income: Income by Host and Method",
            _tree_items("income_by_crowdfunding"),
        ),
    ]


def _result_sizes(results: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of every result."""
    sizes = [
        df.agg(F.count(F.lit(1)).alias("result_rows")).withColumn("result_name", F.lit(name))
        for name, df in results.items()
    ]
    return reduce(DataFrame.unionByName, sizes)


def manifest(results: dict[str, DataFrame], cfg: Config) -> DataFrame:
    """Sections and items in order, with an anchor per titled item and the size of each result.

    Sections none of whose results exist are left out; the measures of the activity charts share
    the results ``class_pies`` and ``class_histogram``.
    """
    spark = next(iter(results.values())).sparkSession
    rows = []
    for place, (section, title, items) in enumerate(_sections(cfg), 1):
        if section == "user-activity-counts":
            items = [(t, d, "class_histogram") for t, d, _ in items]
        found = [item for item in items if item[2] in results]
        if items and not found:
            continue
        head = (place, section, title)
        rows += [(*head, i, *item) for i, item in enumerate(found, 1)] or [(*head, *[None] * 4)]
    entries = small_table(spark, rows, MANIFEST_SCHEMA)
    return entries.join(F.broadcast(_result_sizes(results)), "result_name", "left").select(
        "section_ord",
        "section_id",
        "section_title",
        "item_ord",
        anchor_id("title").alias("item_id"),
        "title",
        "description",
        "result_name",
        "result_rows",
    )


def _money_totals(money: MoneyFlow, cfg: Config) -> list[DataFrame]:
    """One-row frames of the totals of both clean frames."""
    has_fee = F.col("host_fee_percent") > 0
    crowd = ~F.col("payment_method_type").isin(*cfg.untipped_methods)
    main = F.col("host_collective_slug").isin(*cfg.main_hosts) if cfg.main_hosts else F.lit(False)
    tip = F.col("platform_tip_amount_in_usd")
    usd = F.col("amount_in_usd")
    paid = F.col("transaction_count")

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0)).cast("double")

    expenses = money.expenses.agg(
        total(paid).alias("expenses_paid"),
        total(usd).alias("usd_paid_out"),
        total(F.when(main, paid)).alias("expenses_paid_main_hosts"),
        total(F.when(main, usd)).alias("usd_paid_out_main_hosts"),
    ).withColumn(
        "expenses_other_hosts_percent",
        percent_of(F.col("expenses_paid") - F.col("expenses_paid_main_hosts"), F.col("expenses_paid")),
    )
    income = money.income.agg(
        total(usd).alias("usd_received"),
        total(F.when(main, usd)).alias("usd_received_main_hosts"),
        total(tip).alias("usd_tips"),
        total(F.when(main, tip)).alias("usd_tips_main_hosts"),
        total(F.when(has_fee, tip)).alias("usd_tips_host_fee"),
        total(F.when(~has_fee, tip)).alias("usd_tips_no_host_fee"),
        total(F.when(crowd, usd)).alias("usd_crowdfunding"),
    ).withColumn("crowdfunding_percent", percent_of(F.col("usd_crowdfunding"), F.col("usd_received")))
    return [expenses, income]


def _largest_shares(money: MoneyFlow) -> DataFrame:
    """The largest share that one host has of the expenses, and of the tips, in percent."""

    def share(df: DataFrame, value: str, name: str) -> DataFrame:
        hosts = df.groupBy("host_collective_slug").agg(F.sum(value).cast("double").alias("v"))
        top = hosts.agg(F.max("v").alias("most"), F.sum("v").alias("all"))
        return top.select(F.lit(name).alias("metric"), percent_of(F.col("most"), F.col("all")).alias("value"))

    expenses = share(money.expenses, "transaction_count", "expenses_largest_host_percent")
    return expenses.unionByName(
        share(money.income, "platform_tip_amount_in_usd", "usd_tips_largest_host_percent")
    )


def headline_numbers(all_users: DataFrame, money: MoneyFlow, cfg: Config) -> DataFrame:
    """The totals that the report quotes, one per row; those of the main hosts apart."""
    users = funnel(all_users, cfg).select(
        F.concat(F.col("stage"), F.lit("_users")).alias("metric"),
        F.col("users").cast("double").alias("value"),
    )
    totals = [
        df.unpivot([], df.columns, "metric", "value") for df in _money_totals(money, cfg)
    ]
    return reduce(DataFrame.unionByName, [users, *totals, _largest_shares(money)])
