from __future__ import annotations

import pytest

from cohortloom.operators.hierarchy import TREES, hierarchy, smallest_expenses, top_hosts
from cohortloom.operators.money import (
    clean_money,
    convert,
    expense_rollup,
    expenses_in_usd,
    income_in_usd,
    income_rollup,
)
from cohortloom.plans.moneyflow import all_trees, money_flow
from tests.helpers import CFG, deployment

ACCOUNTS = [
    {"id": 5, "slug": "host", "type": "ORGANIZATION", "host_fee_percent": 7.5},
    {"id": 6, "slug": "feeless", "type": "ORGANIZATION"},
    {"id": 7, "slug": "platform", "type": "ORGANIZATION", "host_fee_percent": 0.0},
    {"id": 10, "slug": "project", "type": "COLLECTIVE"},
    {"id": 11, "slug": "child", "type": "PROJECT", "parent_collective_id": 10},
    {"id": 12, "slug": "fund", "type": "FUND"},
    {"id": 13, "slug": "person", "type": "USER"},
]
METHODS = [{"id": 1, "type": "host"}, {"id": 2, "type": "creditcard"}]


def debit(i, account, amount, host=5, currency="USD", **more):
    return {
        "id": i,
        "created_at": "2023-05-05 00:00:00",
        "type": "DEBIT",
        "kind": "EXPENSE",
        "collective_id": account,
        "host_collective_id": host,
        "currency": currency,
        "amount": amount,
        **more,
    }


def credit(i, account, amount, **more):
    return debit(i, account, amount, **{"type": "CREDIT", "kind": "CONTRIBUTION", **more})


def ledger(spark, *rows, orders=(), accounts=ACCOUNTS):
    return deployment(
        spark,
        collectives=accounts,
        payment_methods=METHODS,
        transactions=list(rows),
        orders=list(orders),
    )


def test_expense_rollup(spark):
    t = ledger(
        spark,
        debit(1, 10, -100),
        debit(2, 11, -200),  # counts for the parent
        debit(3, 12, -300),
        debit(4, 13, -400),  # not an account of these types
        debit(5, 10, -500, currency="EUR"),
        debit(6, 10, -600, kind="HOST_FEE"),
        debit(7, 10, -700, created_at="2023-09-02 00:00:00"),  # the current month
        debit(8, 999, -800),
        debit(9, 10, None),
        debit(10, 10, -1, host=None),
    )
    rows = sorted(tuple(r) for r in expense_rollup(t, CFG).fillna(-1).collect())
    assert rows == [
        (10, -1, "USD", 1, -1),
        (10, 5, "EUR", 1, -500),
        (10, 5, "USD", 3, -300),
        (12, 5, "USD", 1, -300),
    ]


def test_income_rollup_counts_a_tip_once_per_transaction(spark):
    orders = [{"id": 1, "platform_tip_amount": 50}, {"id": 2, "platform_tip_amount": None}]
    t = ledger(
        spark,
        credit(1, 10, 1000, order_id=1, payment_method_id=2),
        credit(2, 11, 1000, order_id=1, payment_method_id=2),
        credit(3, 10, 1000, order_id=1, payment_method_id=2),
        credit(4, 10, 10, order_id=2, payment_method_id=1),
        credit(5, 10, 20),
        credit(6, 12, 30),  # funds have no income here
        orders=orders,
    )
    rows = {r.payment_method_type: r for r in income_rollup(t, CFG).collect()}
    assert set(rows) == {"creditcard", "host", "blank"}
    assert rows["creditcard"].platform_tip_amount == 150
    assert (rows["creditcard"].transaction_count, rows["creditcard"].total_amount) == (3, 3000)
    assert rows["host"].platform_tip_amount is None
    assert rows["blank"].total_amount == 20


EXPENSE = "collective_id bigint, host_collective_id bigint, currency string, transaction_count bigint, total_amount bigint"
INCOME = (
    "collective_id bigint, host_collective_id bigint, payment_method_type string, currency string, "
    "transaction_count bigint, total_amount bigint, platform_tip_amount bigint"
)


def test_currencies_merge_and_unknown_keys_drop(spark):
    accounts = ledger(spark).collectives
    rows = [
        (10, 5, "USD", 2, -1050),
        (10, 5, "EUR", 1, -1000),
        (10, 5, "USD", 0, 0),  # zero amounts go
        (10, None, "USD", 9, -9000),  # no host
        (10, 6, "USD", 9, -9000),  # host fee unknown
        (999, 5, "USD", 9, -9000),  # no slug
        (12, 5, "USD", 3, None),  # missing amounts stay and count as zero
    ]
    df = spark.createDataFrame(rows, EXPENSE)
    got = {r.collective_id: r for r in expenses_in_usd(df, accounts, CFG).collect()}
    assert set(got) == {10, 12}
    # -10.50 - 10.80 = -21.30, truncated, without sign
    assert (got[10].transaction_count, got[10].amount_in_usd) == (3, 21)
    assert (got[10].host_collective_slug, got[10].host_fee_percent) == ("host", 7.5)
    assert (got[12].transaction_count, got[12].amount_in_usd) == (3, 0)


def test_missing_tips_are_zero(spark):
    df = spark.createDataFrame([(10, 5, "blank", "USD", 1, 100, None)], INCOME)
    row = income_in_usd(df, ledger(spark).collectives, CFG).first()
    assert row.platform_tip_amount_in_usd == 0


def test_currency_without_rate(spark):
    df = spark.createDataFrame([("JPY", 100)], "currency string, cents bigint")
    rates = spark.createDataFrame([("USD", 1.0)], "currency string, rate double")
    with pytest.raises(Exception, match="no exchange rate for JPY"):
        convert(df, rates, {"cents": "usd"}).collect()


CLEAN = (
    "collective_id bigint, collective_slug string, host_collective_id bigint, "
    "host_collective_slug string, host_fee_percent double, transaction_count bigint, "
    "amount_in_usd bigint"
)
CLEAN_INCOME = CLEAN + ", payment_method_type string, platform_tip_amount_in_usd bigint"


def expense(i, slug=None, host=5, host_slug="host", count=9, usd=100):
    return (i, slug or f"p{i}", host, host_slug, 5.0, count, usd)


def income(i, method="creditcard", **more):
    return (*expense(i, **more), method, 7)


def clean(spark, expenses, incomes):
    return clean_money(
        spark.createDataFrame(expenses, CLEAN), spark.createDataFrame(incomes, CLEAN_INCOME), CFG
    )


def ids(df):
    return sorted(r.collective_id for r in df.collect())


def test_cleaning_steps(spark):
    money = clean(
        spark,
        [
            expense(1),
            expense(2, host=2, count=4),  # trial: hosts itself, few expenses
            expense(3, host=3, count=5),  # hosts itself, enough expenses
            expense(4, slug="p-1.23"),  # spam
            expense(5, host_slug="platform"),  # the platform's own
            expense(6, count=1),
        ],
        [
            income(1),
            income(2, count=99),  # goes with its trial
            income(3, count=1),  # few, but has expenses
            income(4, slug="p-1.23"),
            income(5, host_slug="platform"),
            income(7, count=2),  # few, no expenses
            income(8, count=2),  # with the next row: enough
            income(8, count=3, method="paypal"),
            income(9, method="host"),  # only host payments
            income(9, method="blank"),
            income(10, method="host"),
            income(10, method="collective"),
            income(6, method="host", count=1),  # noise by both rules, but has expenses
        ],
    )
    assert ids(money.expenses) == [1, 3, 6]
    assert ids(money.income) == [1, 3, 6, 8, 8, 10, 10]


def test_noise_is_judged_against_expenses_that_are_left(spark):
    """Account 4 has expenses, but they are hosted by the platform and go first."""
    money = clean(spark, [expense(4, host_slug="platform")], [income(4, count=1)])
    assert ids(money.income) == []


def test_hierarchy_levels_have_the_same_sum(spark):
    rows = [(f"h{i % 3}", f"a{i % 7}", f"x{i % 2}", i) for i in range(50)]
    df = spark.createDataFrame(rows, "p string, q string, r string, v bigint")
    levels = {}
    for r in hierarchy(df, ["p", "q", "r"], "v").collect():
        levels.setdefault(r.depth, []).append(r)
    assert set(levels) == {1, 2, 3}
    assert {sum(r.value for r in rows) for rows in levels.values()} == {sum(range(50))}
    assert all(r.q is None and r.r is None for r in levels[1])
    assert len(levels[1]) == 3


def test_trees(spark, stages):
    orders = [{"id": 1, "platform_tip_amount": 300}]
    rows = [debit(i, 10, -1000) for i in range(9)]
    rows += [credit(100 + i, 10, 2000, order_id=1, payment_method_id=1 + i % 2) for i in range(10)]
    money = money_flow(ledger(spark, *rows, orders=orders), CFG, stages)
    trees = all_trees(money, CFG)
    assert set(trees) == {t.name for t in TREES}
    fee = trees["expense_amount_by_fee"].orderBy("depth").collect()
    assert [tuple(r) for r in fee] == [
        (1, "7%", None, None, 90),
        (2, "7%", "host", None, 90),
        (3, "7%", "host", "project", 90),
    ]
    tips = trees["tips_by_fee"].orderBy("depth").first()
    assert (tips.host_fee, tips.platform_tip_amount_in_usd) == ("Host fee", 30)
    top = {r.crowdfunding: r.amount_in_usd for r in trees["income_by_crowdfunding"].collect() if r.depth == 1}
    assert top == {"Not crowdfunding": 100, "Maybe crowdfunding": 100}
    assert trees["expense_amount_zero_fee"].count() == 0


def test_top_and_bottom(spark):
    df = spark.createDataFrame([income(i, host_slug=f"h{i % 12}", usd=i) for i in range(24)], CLEAN_INCOME)
    best = top_hosts(df).collect()
    assert len(best) == 10
    assert (best[0].host_collective_slug, best[0].amount_in_usd) == ("h11", 34)
    assert [r.collective_id for r in smallest_expenses(df).collect()] == list(range(10))
