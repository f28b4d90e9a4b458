"""From ledger to clean money frames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohortloom.config import Config
from cohortloom.operators.hierarchy import TREES
from cohortloom.operators.money import (
    MoneyFlow,
    clean_expenses,
    clean_money,
    expense_rollup,
    expenses_in_usd,
    income_in_usd,
    income_rollup,
)
from cohortloom.sources.stages import StageArea
from cohortloom.sources.tables import Tables


def money_flow(t: Tables, cfg: Config, stages: StageArea | None = None) -> MoneyFlow:
    """Clean expenses and income from the ledger."""
    return money_from_rollups(
        expense_rollup(t, cfg), income_rollup(t, cfg), t.collectives, cfg, stages
    )


def money_from_rollups(
    expense_sums: DataFrame,
    income_sums: DataFrame,
    collectives: DataFrame,
    cfg: Config,
    stages: StageArea | None = None,
) -> MoneyFlow:
    """Clean expenses and income from roll-ups, computed here or exported earlier.

    With a stage area, frames that are read again are written.
    """

    def keep(df: DataFrame, name: str) -> DataFrame:
        return stages.save(df, name) if stages else df

    # Both are read twice by the cleaning steps.
    expenses = keep(expenses_in_usd(expense_sums, collectives, cfg), "expenses_in_usd")
    income = keep(income_in_usd(income_sums, collectives, cfg), "income_in_usd")
    clean = clean_money(expenses, income, cfg)
    return MoneyFlow(clean.expenses, keep(clean.income, "income_clean"))


def expense_flow(t: Tables, cfg: Config) -> MoneyFlow:
    """Clean expenses alone; their cleaning does not depend on income."""
    expenses = expenses_in_usd(expense_rollup(t, cfg), t.collectives, cfg)
    return MoneyFlow(clean_expenses(expenses, cfg))


def all_trees(money: MoneyFlow, cfg: Config) -> dict[str, DataFrame]:
    return {tree.name: tree.build(money, cfg) for tree in TREES}
