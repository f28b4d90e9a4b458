"""Classification of log rows and orders.

Both go through one set of lookups. ``relate`` adds what is known about payee and payer; the label
functions of :mod:`cohortloom.functions.columns` turn that into a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import MEASURE_OF_LABEL, Config
from cohortloom.functions.columns import (
    contribution_label,
    expense_label,
    host_label,
    log_act,
)
from cohortloom.operators.filters import drop_values, keep_values, rolling_window
from cohortloom.operators.lookups import left_lookup
from cohortloom.sources.tables import Tables


def user_directory(users: DataFrame, collectives: DataFrame) -> DataFrame:
    """One row per user: id, slug of the user's own account, and whether that account exists."""
    accounts = collectives.select(F.col("id").alias("account_id"), F.col("slug").alias("user_slug"))
    people = users.select(F.col("id").alias("user_id"), "collective_id")
    found = left_lookup(people, accounts, {"collective_id": "account_id"}, ["user_id"])
    return found.select(
        "user_id", "user_slug", F.col("account_id").isNotNull().alias("has_account")
    )


def account_profiles(collectives: DataFrame) -> DataFrame:
    """Accounts with the slug of their host."""
    hosts = collectives.select(F.col("id").alias("host_id"), F.col("slug").alias("host_slug"))
    accounts = collectives.select(
        "id", "slug", "type", "parent_collective_id", "host_collective_id"
    )
    found = left_lookup(accounts, hosts, {"host_collective_id": "host_id"}, ["id"])
    return found.drop("host_id")


def admin_links(members: DataFrame) -> DataFrame:
    """Number of ADMIN memberships per (member, account): duplicates are counted, not joined."""
    return (
        keep_values(members, "role", ["ADMIN"])
        .groupBy(
            F.col("member_collective_id").alias("member_id"),
            F.col("collective_id").alias("account_id"),
        )
        .agg(F.count(F.lit(1)).alias("admin_links"))
    )


def relate(facts: DataFrame, collectives: DataFrame, members: DataFrame) -> DataFrame:
    """Add payee (must exist), its host, payer (may be missing) and ADMIN memberships.

    ``facts`` has ``user_id``, ``to_id``, ``from_id`` and any other columns. Every lookup is on a
    unique key, so no row is multiplied.
    """
    payee = account_profiles(collectives).select(
        F.col("id").alias("payee_id"),
        F.col("slug").alias("payee_slug"),
        F.col("type").alias("payee_type"),
        F.col("parent_collective_id").alias("payee_parent_id"),
        "host_slug",
    )
    payer = collectives.select(
        F.col("id").alias("payer_id"),
        F.col("slug").alias("payer_slug"),
        F.col("type").alias("payer_type"),
        F.col("parent_collective_id").alias("payer_parent_id"),
    )
    known = facts.join(payee, F.col("to_id") == F.col("payee_id"))
    spread = ["user_id", "payee_id"]
    known = left_lookup(known, payer, {"from_id": "payer_id"}, spread)
    pair = {"payer_id": "member_id", "payee_id": "account_id"}
    known = left_lookup(known, admin_links(members), pair, spread)
    return known.drop("to_id", "from_id", "member_id", "account_id")


def log_facts(activities: DataFrame, cfg: Config) -> DataFrame:
    """Counted log rows of the window. Only expenses need the payer."""
    act = log_act("type", cfg)
    counted = (
        *cfg.expense_types,
        *cfg.virtual_card_types,
        *cfg.host_admin_types,
        *cfg.collective_admin_types,
    )
    recent = rolling_window(activities, "created_at", cfg.activity_as_of, cfg.activity_window)
    return keep_values(recent, "type", counted).select(
        "id",
        "user_id",
        act.alias("act"),
        F.col("collective_id").alias("to_id"),
        F.when(act == "expense", F.col("from_collective_id")).alias("from_id"),
    )


def reduced_log(activities: DataFrame, cfg: Config) -> DataFrame:
    """All log rows of the window as (user, act, payee, payer) with their number.

    Rows that count as nothing have no act; they only show that a user was there.
    """
    recent = rolling_window(activities, "created_at", cfg.activity_as_of, cfg.activity_window)
    act = log_act("type", cfg)
    acts = recent.select(
        "user_id",
        act.alias("act"),
        F.when(act.isNotNull(), F.col("collective_id")).alias("to_id"),
        F.when(act == "expense", F.col("from_collective_id")).alias("from_id"),
    )
    return acts.groupBy("user_id", "act", "to_id", "from_id").agg(F.count(F.lit(1)).alias("n"))


def order_facts(orders: DataFrame, cfg: Config) -> DataFrame:
    """Orders of the window that were paid, are active, or were cancelled."""
    recent = rolling_window(orders, "updated_at", cfg.order_as_of, cfg.order_window)
    return keep_values(recent, "status", cfg.order_statuses).select(
        "id",
        F.col("created_by_user_id").alias("user_id"),
        F.lit("order").alias("act"),
        F.col("collective_id").alias("to_id"),
        F.col("from_collective_id").alias("from_id"),
        "payment_method_id",
    )


def mark_host_payment(facts: DataFrame, payment_methods: DataFrame) -> DataFrame:
    """Replace the payment method by whether it is of type ``host``."""
    host_methods = keep_values(payment_methods, "type", ["host"]).select(
        F.col("id").cast("bigint").alias("host_method_id")
    )
    keyed = facts.withColumn("payment_method_id", F.col("payment_method_id").cast("bigint"))
    method = {"payment_method_id": "host_method_id"}
    found = left_lookup(keyed, host_methods, method, ["user_id", "to_id"])
    return found.withColumn("paid_by_host", F.col("host_method_id").isNotNull()).drop(
        "payment_method_id", "host_method_id"
    )


def _one_row_per_link(df: DataFrame) -> DataFrame:
    """A row that matches several ADMIN memberships appears once for each of them."""
    copies = F.greatest(F.coalesce(F.col("admin_links"), F.lit(1)), F.lit(1))
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).drop(
        "_copy"
    )


def classify_expenses(t: Tables, cfg: Config) -> DataFrame:
    """One row per created expense and membership: id, user, slug and label."""
    facts = log_facts(t.activities, cfg).filter(F.col("act") == "expense")
    people = user_directory(t.users, t.collectives).filter("has_account")
    related = relate(facts, t.collectives, t.members).join(people, "user_id")
    return _one_row_per_link(related).select(
        "id", "user_id", "user_slug", expense_label().alias("expense_type")
    )


def classify_contributions(t: Tables, cfg: Config) -> DataFrame:
    """One row per order and membership: id, user, slug and label."""
    facts = mark_host_payment(order_facts(t.orders, cfg), t.payment_methods)
    people = user_directory(t.users, t.collectives)
    related = relate(facts, t.collectives, t.members).join(people, "user_id")
    return _one_row_per_link(related).select(
        "id", "user_id", "user_slug", contribution_label(cfg).alias("contribution_type")
    )


def counted_acts(t: Tables, cfg: Config, log: DataFrame | None = None) -> DataFrame:
    """Long frame of everything that counts: user, class, host, recipient and number of rows.

    Facts are first reduced to one row per (user, act, payee, payer) with a count, so a user or an
    account with a large share of the log becomes few rows before any lookup, and the lookups run
    once for all eleven classes. Only orders look up their user here, because their label depends
    on the user's own account. ``log`` is the reduced log, if it was written before.
    """
    keys = ["user_id", "act", "to_id", "from_id"]
    size = F.count(F.lit(1)).alias("n")
    if log is None:
        acts = log_facts(drop_values(t.activities, "user_id", cfg.exclude_user_ids), cfg)
        acts = acts.groupBy(*keys).agg(size)
    else:
        acts = drop_values(log, "user_id", cfg.exclude_user_ids).filter("act IS NOT NULL")
    orders = order_facts(t.orders, cfg).groupBy(*keys, "payment_method_id").agg(size)
    people = user_directory(t.users, t.collectives).drop("has_account")
    orders = mark_host_payment(orders, t.payment_methods).join(people, "user_id")

    is_order = F.col("act") == "order"
    facts = orders.unionByName(acts, allowMissingColumns=True)
    related = relate(facts, t.collectives, t.members)
    # Internal moves feed no class and get none.
    activity_class = (
        F.when(is_order, contribution_label(cfg, MEASURE_OF_LABEL))
        .when(F.col("act") == "expense", expense_label(MEASURE_OF_LABEL))
        .otherwise(F.col("act"))
    )
    # Card and admin acts carry no payer, so they match no membership.
    links = F.greatest(F.coalesce(F.col("admin_links"), F.lit(1)), F.lit(1))
    return related.select(
        "user_id",
        activity_class.alias("activity_class"),
        host_label("host_slug").alias("host"),
        F.when(is_order, host_label("payee_slug")).alias("recipient"),
        (F.col("n") * links).alias("n"),
    ).filter(F.col("activity_class").isNotNull())
