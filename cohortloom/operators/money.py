"""Money flow: roll-ups of the ledger, conversion to dollars, and the cleaning steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import NO_METHOD_LABEL, Config
from cohortloom.functions.columns import to_usd, whole_usd
from cohortloom.operators.filters import drop_zero, keep_values, month_period
from cohortloom.operators.lookups import left_lookup
from cohortloom.sources.tables import Tables, small_table

ROW_KEYS = ("collective_id", "collective_slug", "host_collective_id", "host_collective_slug")


def _period(t: Tables, cfg: Config, direction: str, kinds) -> DataFrame:
    rows = month_period(t.transactions, "created_at", cfg.money_as_of, cfg.money_months)
    return keep_values(keep_values(rows, "type", [direction]), "kind", kinds)


def _roll_up_to_parent(df: DataFrame, collectives: DataFrame, types) -> DataFrame:
    """Replace each account by its parent, if it has one, and keep accounts of some types."""
    accounts = keep_values(collectives, "type", types).select(
        F.col("id").alias("collective_id"), "parent_collective_id"
    )
    return (
        df.join(accounts, "collective_id")
        .withColumn("collective_id", F.coalesce("parent_collective_id", "collective_id"))
        .drop("parent_collective_id")
    )


def expense_rollup(t: Tables, cfg: Config) -> DataFrame:
    """Count and sum of paid expenses per (parent) account, host and currency.

    The ledger is summed per account before the account lookup, so the lookup sees one row per
    account, host and currency however many transactions an account has.
    """
    per_account = (
        _period(t, cfg, "DEBIT", cfg.expense_kinds)
        .groupBy("collective_id", "host_collective_id", "currency")
        .agg(F.count("id").alias("transaction_count"), F.sum("amount").alias("total_amount"))
    )
    return (
        _roll_up_to_parent(per_account, t.collectives, cfg.expense_account_types)
        .groupBy("collective_id", "host_collective_id", "currency")
        .agg(
            F.sum("transaction_count").alias("transaction_count"),
            F.sum("total_amount").alias("total_amount"),
        )
    )


def income_rollup(t: Tables, cfg: Config) -> DataFrame:
    """Count, sum and tips of income per (parent) account, host, payment method and currency.

    A tip belongs to an order and is added once per transaction of that order. Transactions are
    first summed per order, so each lookup sees a smaller frame than the one before.
    """
    keys = ["collective_id", "host_collective_id", "currency", "payment_method_id"]
    measures = ["transaction_count", "total_amount", "platform_tip_amount"]
    totals = [F.sum(m).alias(m) for m in measures]

    per_order = (
        _period(t, cfg, "CREDIT", cfg.income_kinds)
        .withColumn("payment_method_id", F.col("payment_method_id").cast("bigint"))
        .groupBy(*keys, "order_id")
        .agg(F.count("id").alias("transaction_count"), F.sum("amount").alias("total_amount"))
    )
    tips = t.orders.filter("platform_tip_amount IS NOT NULL").select(
        F.col("id").alias("tip_order_id"), F.col("platform_tip_amount").alias("tip")
    )
    per_method = (
        left_lookup(per_order, tips, {"order_id": "tip_order_id"}, keys)
        .withColumn("platform_tip_amount", F.col("tip") * F.col("transaction_count"))
        .groupBy(*keys)
        .agg(*totals)
    )
    methods = t.payment_methods.select(
        F.col("id").cast("bigint").alias("method_id"), F.col("type").alias("method")
    )
    per_account = left_lookup(
        per_method, methods, {"payment_method_id": "method_id"}, ["collective_id", "currency"]
    ).withColumn("payment_method_type", F.coalesce("method", F.lit(NO_METHOD_LABEL)))
    return (
        _roll_up_to_parent(per_account, t.collectives, cfg.income_account_types)
        .groupBy("collective_id", "host_collective_id", "payment_method_type", "currency")
        .agg(*totals)
    )


def convert(df: DataFrame, rates: DataFrame, amounts: dict[str, str]) -> DataFrame:
    """Add dollar columns: ``amounts`` maps a column in cents to its name in dollars.

    ``rates`` has one row per currency, some hundreds at most, and must hold every currency.
    """
    known = rates.select("currency", F.col("rate").cast("double").alias("rate"))
    joined = df.join(F.broadcast(known), "currency", "left")
    dollars = {usd: to_usd(cents, "rate", "currency") for cents, usd in amounts.items()}
    return joined.withColumns(dollars).drop("rate")


def rates_frame(df: DataFrame, cfg: Config) -> DataFrame:
    """The configured rates as a table, in the session of ``df``."""
    rates = sorted(cfg.usd_rates.items())
    return small_table(df.sparkSession, rates, "currency string, rate double")


def enrich(df: DataFrame, collectives: DataFrame) -> DataFrame:
    """Add the account's slug, and slug and fee of its host. Rows lacking any of them drop out."""
    own = collectives.select(
        F.col("id").alias("collective_id"), F.col("slug").alias("collective_slug")
    )
    host = collectives.select(
        F.col("id").alias("host_collective_id"),
        F.col("slug").alias("host_collective_slug"),
        "host_fee_percent",
    )
    return df.join(own.dropna(), "collective_id").join(host.dropna(), "host_collective_id")


def _merge_currencies(df: DataFrame, keys: list[str], amounts: list[str]) -> DataFrame:
    """Sum over currencies, in whole dollars; missing amounts count as zero.

    Slugs and fees follow from the ids, so the sums are taken before they are looked up: the lookup
    of the hosts, some of which hold very many accounts, is then the last step.
    """
    sums = [whole_usd(F.coalesce(F.sum(a), F.lit(0).cast("decimal(38,12)"))).alias(a) for a in amounts]
    known = df.dropna(subset=["collective_id", "host_collective_id"])
    return known.groupBy(*keys).agg(F.sum("transaction_count").alias("transaction_count"), *sums)


def expenses_in_usd(rollup: DataFrame, collectives: DataFrame, cfg: Config) -> DataFrame:
    """Expenses per account and host, in whole dollars."""
    amounts = {"total_amount": "amount_in_usd"}
    rows = convert(drop_zero(rollup, "total_amount"), rates_frame(rollup, cfg), amounts)
    keys = ["collective_id", "host_collective_id"]
    merged = _merge_currencies(rows, keys, list(amounts.values()))
    return enrich(merged, collectives).select(
        *ROW_KEYS, "host_fee_percent", "transaction_count", "amount_in_usd"
    )


def income_in_usd(rollup: DataFrame, collectives: DataFrame, cfg: Config) -> DataFrame:
    """Income and tips per account, host and payment method, in whole dollars."""
    amounts = {
        "total_amount": "amount_in_usd",
        "platform_tip_amount": "platform_tip_amount_in_usd",
    }
    rows = convert(drop_zero(rollup, "total_amount"), rates_frame(rollup, cfg), amounts)
    keys = ["collective_id", "host_collective_id", "payment_method_type"]
    merged = _merge_currencies(rows, keys, list(amounts.values()))
    return enrich(merged, collectives).select(
        *ROW_KEYS,
        "payment_method_type",
        "host_fee_percent",
        "transaction_count",
        *amounts.values(),
    )


def drop_spam_and_internal(df: DataFrame, cfg: Config) -> DataFrame:
    """Drop slugs of the spam pattern, and accounts hosted by the platform itself."""
    return df.filter(~F.col("collective_slug").rlike(cfg.spam_slug_pattern)).filter(
        F.col("host_collective_slug") != cfg.platform_host_slug
    )


def is_trial_account(cfg: Config):
    """A self-hosted account with few expenses: someone trying out the platform."""
    return (F.col("transaction_count") < cfg.min_transactions) & (
        F.col("collective_id") == F.col("host_collective_id")
    )


def drop_noise_income(income: DataFrame, expenses: DataFrame, cfg: Config) -> DataFrame:
    """Drop accounts without expenses that have few transactions, or only host payments."""
    noise = (
        income.groupBy("collective_id")
        .agg(
            F.sum("transaction_count").alias("transactions"),
            F.bool_and(F.col("payment_method_type").isin(*cfg.host_methods)).alias("all_host"),
        )
        .filter((F.col("transactions") < cfg.min_transactions) | F.col("all_host"))
        .join(expenses.select("collective_id"), "collective_id", "left_anti")
    )
    return income.join(noise, "collective_id", "left_anti")


@dataclass(frozen=True)
class MoneyFlow:
    """The two cleaned frames."""

    expenses: DataFrame
    income: DataFrame | None = None


def clean_expenses(expenses: DataFrame, cfg: Config) -> DataFrame:
    return drop_spam_and_internal(expenses.filter(~is_trial_account(cfg)), cfg)


def clean_money(expenses: DataFrame, income: DataFrame, cfg: Config) -> MoneyFlow:
    """The cleaning steps. Their order matters: noise in the income is judged against the expenses
    that are left."""
    trials = expenses.filter(is_trial_account(cfg)).select("collective_id")
    kept = clean_expenses(expenses, cfg)
    income = drop_spam_and_internal(income.join(trials, "collective_id", "left_anti"), cfg)
    return MoneyFlow(kept, drop_noise_income(income, kept, cfg))
