from __future__ import annotations

import pytest

from cohortloom.operators.classify import (
    classify_contributions,
    classify_expenses,
    counted_acts,
)
from cohortloom.operators.counting import active_users, class_counts
from tests.helpers import CFG, NOW, deployment

ACCOUNTS = [
    {"id": 1, "slug": "ann", "type": "USER"},
    {"id": 2, "slug": "acme", "type": "ORGANIZATION"},
    {"id": 3, "slug": "incognito-9", "type": "USER"},
    {"id": 4, "slug": "guest-9", "type": "USER"},
    {"id": 5, "slug": "host", "type": "ORGANIZATION", "host_collective_id": 5},
    {"id": 10, "slug": "project", "type": "COLLECTIVE", "host_collective_id": 5},
    {"id": 11, "slug": "child", "type": "PROJECT", "parent_collective_id": 10},
    {"id": 12, "slug": "sibling", "type": "EVENT", "parent_collective_id": 10},
    {"id": 13, "slug": "event", "type": "EVENT", "host_collective_id": 5},
    {"id": 14, "slug": "other", "type": "COLLECTIVE"},
]
USERS = [{"id": 1, "collective_id": 1}, {"id": 2, "collective_id": 999}]
METHODS = [{"id": 1, "type": "host"}, {"id": 2, "type": "creditcard"}]
ADMIN = {"member_collective_id": 1, "collective_id": 10, "role": "ADMIN"}
BACKER = {"member_collective_id": 1, "collective_id": 14, "role": "BACKER"}


def order(i, payee, payer=1, method=2, user=1, **more):
    return {
        "id": i,
        "created_by_user_id": user,
        "created_at": NOW,
        "updated_at": NOW,
        "status": "PAID",
        "collective_id": payee,
        "from_collective_id": payer,
        "payment_method_id": method,
        **more,
    }


def log(i, kind, payee, payer=1, user=1, at=NOW):
    return {
        "id": i,
        "user_id": user,
        "created_at": at,
        "type": kind,
        "collective_id": payee,
        "from_collective_id": payer,
    }


def world(spark, members=(ADMIN, BACKER), **rows):
    return deployment(
        spark,
        collectives=ACCOUNTS,
        users=USERS,
        payment_methods=METHODS,
        members=list(members),
        **rows,
    )


def contribution_type(spark, *orders):
    t = world(spark, orders=list(orders))
    rows = classify_contributions(t, CFG).orderBy("id").collect()
    return [r.contribution_type for r in rows]


def test_contribution_rules(spark):
    labels = contribution_type(
        spark,
        order(1, 11, payer=10),  # parent pays child
        order(2, 10, payer=11),  # child pays parent
        order(3, 12, payer=11),  # same parent
        order(4, 13, method=1),  # event from host funds: the host rule comes first
        order(5, 13),
        order(6, 10),
        order(7, 14, payer=2),
        order(8, 14),  # only a backer; own slug
        order(9, 14, payer=3),
        order(10, 14, payer=4),
        order(11, 14, payer=10),
        order(12, 14, payer=None),
        order(13, 14, payer=12345),  # payer does not exist
        order(14, 14, payer=1, user=2),  # the user's own account does not exist
    )
    assert labels == [
        "Internal Collective Transfer",
        "Internal Collective Transfer",
        "Internal Collective Transfer",
        "Contribution Via Host",
        "Event Order",
        "Contribution to Own Collective",
        "Contribution Via Organization",
        "Direct Contribution",
        "Direct Contribution",
        "Direct Contribution",
        "Contribution Via Collective",
        "Contribution Via Collective",
        "Contribution Via Collective",
        "Contribution Via Collective",
    ]


def test_orders_that_do_not_count(spark):
    t = world(
        spark,
        orders=[
            order(1, 14, status="EXPIRED"),
            order(2, 14, updated_at="2022-01-01 00:00:00"),
            order(3, 777),  # payee does not exist
            order(4, 14, user=77),  # user does not exist
            order(5, 14, status="CANCELLED", created_at="2020-01-01 00:00:00"),
        ],
    )
    assert [r.id for r in classify_contributions(t, CFG).collect()] == [5]


def test_expense_rules(spark):
    kind = "collective.expense.created"
    t = world(
        spark,
        activities=[
            log(1, kind, 11, payer=10),
            log(2, kind, 10, payer=11),
            log(3, kind, 12, payer=11),
            log(4, kind, 10),
            log(5, kind, 14),
            log(6, kind, 14, payer=None),
            log(7, kind, 14, payer=2),  # neither has a parent: not siblings
            log(8, kind, 10, user=2),  # user without an account
            log(9, "collective.expense.rejected", 10),
        ],
    )
    rows = classify_expenses(t, CFG).orderBy("id").collect()
    assert [(r.id, r.expense_type) for r in rows] == [
        (1, "Internal Collective Expense"),
        (2, "Internal Collective Expense"),
        (3, "Internal Collective Expense"),
        (4, "Expense to Own Collective"),
        (5, "Expense"),
        (6, "Expense"),
        (7, "Expense"),
    ]


def test_duplicate_memberships_multiply_rows_and_counts(spark):
    t = world(spark, members=[ADMIN, ADMIN, ADMIN], orders=[order(1, 10), order(2, 10)])
    assert classify_contributions(t, CFG).count() == 6
    row = class_counts(t, CFG).first()
    assert (row.activity_class, row.n) == ("contributions_to_own_collective", 6)


def test_counts_hosts_and_recipients(spark):
    t = world(
        spark,
        orders=[order(1, 14), order(2, 14), order(3, 14, payer=3), order(4, 11, payer=10)],
        activities=[
            log(1, "virtualcard.purchase", 10),
            log(2, "virtualcard.purchase", 14),
            log(3, "collective.approved", 10),
            log(4, "user.signin", 10),
            log(5, "collective.created", 13),
        ],
    )
    rows = {r.activity_class: r for r in class_counts(t, CFG).collect()}
    assert set(rows) == {
        "direct_contributions",
        "virtual_card_purchases",
        "host_admin_activities",
        "collective_admin_activities",
    }
    direct = rows["direct_contributions"]
    assert (direct.n, direct.hosts, direct.recipients) == (3, ["_independent-or-host"], ["other"])
    cards = rows["virtual_card_purchases"]
    assert (cards.n, cards.hosts, cards.recipients) == (2, ["_independent-or-host", "host"], None)


def test_excluded_users_lose_log_classes_only(spark):
    accounts = [*ACCOUNTS, {"id": 90, "slug": "staff", "type": "USER"}]
    t = deployment(
        spark,
        collectives=accounts,
        users=[{"id": 90, "collective_id": 90}],
        payment_methods=METHODS,
        orders=[order(1, 14, payer=90, user=90)],
        activities=[
            log(1, "virtualcard.purchase", 10, user=90),
            log(2, "collective.expense.created", 14, payer=90, user=90),
        ],
    )
    assert [r.activity_class for r in class_counts(t, CFG).collect()] == ["direct_contributions"]
    assert [r.user_slug for r in active_users(t, CFG).collect()] == ["staff"]


def test_active_users_need_an_account_and_a_recent_row(spark):
    t = world(
        spark,
        activities=[
            log(1, "user.signin", None),
            log(2, "user.signin", 10),
            log(3, "user.signin", 10, user=2),
            log(4, "user.signin", 10, user=55),
        ],
    )
    assert [tuple(r) for r in active_users(t, CFG).collect()] == [(1, "ann")]
    old = world(spark, activities=[log(1, "user.signin", 10, at="2022-01-01 00:00:00")])
    assert active_users(old, CFG).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_hot_keys_give_the_same_counts(spark, settings, broadcast):
    """A payee, a payer and the missing payer with a third of the rows each."""
    rows = []
    for i in range(600):
        payee, payer = [(14, 1 + i % 4), (10 + i % 5, 2), (10 + i % 5, None)][i % 3]
        rows.append(order(i, payee, payer=payer))
    t = world(spark, orders=rows)
    expected = {}
    for r in classify_contributions(t, CFG).collect():
        expected[r.contribution_type] = expected.get(r.contribution_type, 0) + 1
    if not broadcast:
        settings(spark__sql__autoBroadcastJoinThreshold="-1")
        settings(spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    got = {r.activity_class: r.n for r in class_counts(t, CFG).collect()}
    assert sum(got.values()) == sum(
        n for label, n in expected.items() if not label.startswith("Internal")
    )
    assert got["direct_contributions"] == expected["Direct Contribution"]
    # Facts are reduced before the lookups: far fewer rows than orders.
    assert counted_acts(t, CFG).count() < 40
