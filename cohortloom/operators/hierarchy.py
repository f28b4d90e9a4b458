"""Totals at every level of a path: the data of a tree map."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.config import Config
from cohortloom.functions.columns import percent_label
from cohortloom.operators.money import MoneyFlow


def hierarchy(df: DataFrame, path: list[str], value: str, label: str = "value") -> DataFrame:
    """Sum of ``value`` for every prefix of ``path``; ``depth`` 1 is the top level."""
    missing_levels = F.bit_count(F.grouping_id())
    return (
        df.rollup(*path)
        .agg(
            (F.lit(len(path)) - missing_levels).cast("int").alias("depth"),
            F.sum(value).cast("bigint").alias(label),
        )
        .filter(F.col("depth") > 0)
        .select("depth", *path, label)
    )


def _with_labels(df: DataFrame, cfg: Config) -> DataFrame:
    """The labels that some paths start with."""
    columns = {
        "host_fee_label": percent_label("host_fee_percent"),
        "host_fee": F.when(F.col("host_fee_percent") > 0, "Host fee").otherwise("No host fee"),
    }
    if "payment_method_type" in df.columns:
        untipped = F.col("payment_method_type").isin(*cfg.untipped_methods)
        columns["tip_possible"] = F.when(untipped, "No tip possible").otherwise("Tip possible")
        columns["crowdfunding"] = F.when(untipped, "Not crowdfunding").otherwise(
            "Maybe crowdfunding"
        )
    return df.withColumns(columns)


@dataclass(frozen=True)
class Tree:
    """One tree map: its source frame, path, value and title."""

    name: str
    source: str
    path: tuple[str, ...]
    value: str
    title: str
    keep: Callable[[DataFrame], DataFrame] | None = None

    def build(self, money: MoneyFlow, cfg: Config) -> DataFrame:
        df = _with_labels(getattr(money, self.source), cfg)
        df = self.keep(df) if self.keep else df
        return hierarchy(df, list(self.path), self.value, self.value)


def _zero_fee(df: DataFrame) -> DataFrame:
    return df.filter(F.col("host_fee_percent") == 0)


_HOST = "host_collective_slug"
_ACCOUNT = "collective_slug"
_METHOD = "payment_method_type"
_USD = "amount_in_usd"
_COUNT = "transaction_count"
_FEE = "host_fee_label"

# The ten tree maps, with path, value and title.
TREES = (
    Tree(
        "expense_amount_by_host",
        "expenses",
        (_HOST, _ACCOUNT),
        _USD,
        "Expense amount by host and collective",
    ),
    Tree(
        "expense_count_by_host",
        "expenses",
        (_HOST, _ACCOUNT),
        _COUNT,
        "Expense count by host and collective",
    ),
    Tree(
        "expense_count_by_fee",
        "expenses",
        (_FEE, _HOST, _ACCOUNT),
        _COUNT,
        "Expense count by host fee",
    ),
    Tree(
        "expense_amount_by_fee",
        "expenses",
        (_FEE, _HOST, _ACCOUNT),
        _USD,
        "Expense amount by host fee",
    ),
    Tree(
        "expense_amount_zero_fee",
        "expenses",
        (_HOST, _ACCOUNT),
        _USD,
        "Expense amount of hosts without a fee",
        _zero_fee,
    ),
    Tree(
        "expense_count_zero_fee",
        "expenses",
        (_HOST, _ACCOUNT),
        _COUNT,
        "Expense count of hosts without a fee",
        _zero_fee,
    ),
    Tree(
        "income_by_host_and_method",
        "income",
        (_HOST, _METHOD),
        _USD,
        "Income amount by host and payment method",
    ),
    Tree(
        "income_by_fee_and_method",
        "income",
        (_FEE, _HOST, "tip_possible", _METHOD),
        _USD,
        "Income amount by host fee and payment method",
    ),
    Tree(
        "tips_by_fee",
        "income",
        ("host_fee", _HOST, _ACCOUNT),
        "platform_tip_amount_in_usd",
        "Platform tips by host fee, host and collective",
    ),
    Tree(
        "income_by_crowdfunding",
        "income",
        ("crowdfunding", _HOST, _METHOD),
        _USD,
        "Income amount by crowdfunding, host and payment method",
    ),
)


def host_account_totals(expenses: DataFrame) -> DataFrame:
    """Amount and count per host and account."""
    return expenses.groupBy(_HOST, _ACCOUNT).agg(
        F.sum(_USD).alias(_USD), F.sum(_COUNT).alias(_COUNT)
    )


def top_hosts(income: DataFrame, rows: int = 10) -> DataFrame:
    """Hosts with the largest income."""
    totals = income.groupBy(_HOST).agg(F.sum(_COUNT).alias(_COUNT), F.sum(_USD).alias(_USD))
    return totals.orderBy(F.desc(_USD), _HOST).limit(rows)


def smallest_expenses(expenses: DataFrame, rows: int = 10) -> DataFrame:
    """Expense rows with the smallest amount."""
    return expenses.orderBy(_USD, "collective_id", "host_collective_id").limit(rows)
