"""Parameters of every operator, in one place.

All literals of the application domain live here as overridable defaults; operators take them
from a :class:`Config` or as arguments.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from cohortloom.functions.naming import title_to_snake
from cohortloom.rates import USD_RATES

# --- Fixed values: event types of the activity log, by the class that counts them -------------
EXPENSE_TYPES = ("collective.expense.created",)
VIRTUAL_CARD_TYPES = ("virtualcard.purchase",)
HOST_ADMIN_TYPES = (
    "collective.approved",
    "collective.rejected",
    "collective.expense.paid",
    "collective.expense.incomplete",
    "collective.expense.scheduledForPayment",
    "collective.virtualcard.added",
    "collective.virtualcard.deleted",
    "collective.virtualcard.request.rejected",
    "collective.virtualcard.request.approved",
    "collective.expense.putOnHold",
    "collective.expense.releasedFromHold",
    "collective.expense.reApprovalRequested",
    "collective.expense.unscheduledForPayment",
    "agreement.created",
    "agreement.edited",
)
COLLECTIVE_ADMIN_TYPES = (
    "collective.created",
    "collective.apply",
    "collective.core.member.edited",
    "collective.core.member.removed",
    "collective.expense.approved",
    "collective.expense.unapproved",
    "collective.update.created",
)

# --- Fixed values: labels given to expenses and contributions ---------------------------------
INTERNAL_EXPENSE = "Internal Collective Expense"
OWN_EXPENSE = "Expense to Own Collective"
EXPENSE = "Expense"
INTERNAL_TRANSFER = "Internal Collective Transfer"
VIA_HOST = "Contribution Via Host"
EVENT_ORDER = "Event Order"
OWN_CONTRIBUTION = "Contribution to Own Collective"
VIA_ORGANIZATION = "Contribution Via Organization"
DIRECT = "Direct Contribution"
VIA_COLLECTIVE = "Contribution Via Collective"

NO_HOST_LABEL = "_independent-or-host"
NO_METHOD_LABEL = "blank"


@dataclass(frozen=True)
class ActivityClass:
    """One counted class: the title of its count column, the stem of its other columns."""

    title: str
    stem: str
    from_orders: bool = False

    @property
    def measure(self) -> str:
        return title_to_snake(self.title)

    def column(self, part: str) -> str:
        """Name of one output column: ``column("hosts")`` -> ``expense_hosts``."""
        if part == "count":
            return self.measure
        if part == "log":
            return "log_" + self.measure
        return f"{title_to_snake(self.stem)}_{part}"

    @property
    def list_parts(self) -> tuple[str, ...]:
        return ("hosts", "recipients") if self.from_orders else ("hosts",)


# --- Fixed values: the eleven classes in the order of the cohort table -------------------------
CLASSES = (
    ActivityClass("Expense Activities", "Expense"),
    ActivityClass("Expense to Own Collective Activities", "Expense to Own Collective"),
    ActivityClass("Host Admin Activities", "Host Admin"),
    ActivityClass("Collective Admin Activities", "Collective Admin"),
    ActivityClass("Event Orders", "Event Orders", True),
    ActivityClass("Direct Contributions", "Direct Contributions", True),
    ActivityClass("Contributions to Own Collective", "Contributions to Own Collective", True),
    ActivityClass("Collective Contributions", "Collective Contributions", True),
    ActivityClass("Contributions Via Host", "Contributions Via Host", True),
    ActivityClass("Organization Contributions", "Organization Contributions", True),
    ActivityClass("Virtual Card Purchases", "Virtual Card Purchases"),
)
MEASURES = tuple(c.measure for c in CLASSES)
LIST_COLUMNS = tuple(c.column(part) for c in CLASSES for part in c.list_parts)

# The class that counts each label; internal moves are classified but belong to no class.
MEASURE_OF_LABEL = {
    EXPENSE: "expense_activities",
    OWN_EXPENSE: "expense_to_own_collective_activities",
    EVENT_ORDER: "event_orders",
    DIRECT: "direct_contributions",
    OWN_CONTRIBUTION: "contributions_to_own_collective",
    VIA_COLLECTIVE: "collective_contributions",
    VIA_HOST: "contributions_via_host",
    VIA_ORGANIZATION: "organization_contributions",
}

# --- Fixed values: sums over classes, and the measures of each step ----------------------------
CONTRIBUTION_MEASURES = (
    "direct_contributions",
    "collective_contributions",
    "contributions_to_own_collective",
    "contributions_via_host",
    "organization_contributions",
    "event_orders",
)
EXPENSE_MEASURES = (
    "expense_activities",
    "expense_to_own_collective_activities",
    "virtual_card_purchases",
)
ADMIN_MEASURES = ("host_admin_activities", "collective_admin_activities")
TOTALS = ("total_contributions", "total_expenses", "total_activities")
FEATURE_MEASURES = (
    "expense_activities",
    "expense_to_own_collective_activities",
    "host_admin_activities",
    "collective_admin_activities",
    "direct_contributions",
    "collective_contributions",
    "contributions_to_own_collective",
    "contributions_via_host",
    "organization_contributions",
    "event_orders",
    "virtual_card_purchases",
) + TOTALS
# Shown as a pie and a histogram each: everything but the total over all classes.
CHART_MEASURES = tuple(m for m in FEATURE_MEASURES if m != "total_activities")
# Virtual card purchases take no part in the clustering.
PROFILE_MEASURES = FEATURE_MEASURES[:10]
MODIFIER = "host_admin_activity_modifier"
CLUSTER_MEASURES = PROFILE_MEASURES + (MODIFIER,)

# Users profiled by activity: each pick takes the cluster whose centre leads in a measure, and shows
# its most active users by that measure. (measure, title)
TOP_PROFILES = (
    ("host_admin_activities", "Host admin"),
    ("collective_admin_activities", "Collective admin"),
    ("collective_contributions", "Contributions via collective"),
    ("expense_activities", "Expense submitter"),
)
SAMPLE_TITLE = "Random sample of users"


@dataclass(frozen=True)
class Config:
    """Overridable parameters. An ``as_of`` of ``None`` means the time the query runs."""

    # Look-back windows.
    activity_as_of: str | datetime | None = None
    activity_window: str = "INTERVAL '12' MONTH"
    order_as_of: str | datetime | None = None
    order_window: str = "INTERVAL '12' MONTH"
    money_as_of: str | datetime | None = None
    money_months: int = 12

    # Activity log and orders. Excluded ids are the staff's, empty by default.
    exclude_user_ids: tuple[int, ...] = ()
    expense_types: tuple[str, ...] = EXPENSE_TYPES
    virtual_card_types: tuple[str, ...] = VIRTUAL_CARD_TYPES
    host_admin_types: tuple[str, ...] = HOST_ADMIN_TYPES
    collective_admin_types: tuple[str, ...] = COLLECTIVE_ADMIN_TYPES
    order_statuses: tuple[str, ...] = ("PAID", "ACTIVE", "CANCELLED")
    direct_slug_prefixes: tuple[str, ...] = ("incognito-", "guest-")

    # Scores.
    rank_width: float = 0.33
    tiles: int = 20

    # Users. Blocked accounts are those with scripted activity.
    blocked_slugs: tuple[str, ...] = ()
    # The list of virtual card hosts is not searched for blocked accounts.
    blocked_list_columns: tuple[str, ...] = tuple(
        c for c in LIST_COLUMNS if c != "virtual_card_purchases_hosts"
    )
    active_threshold: int = 0
    high_threshold: int = 11
    modifier_threshold: int = 25
    histogram_cap: int = 20
    cluster_histogram_cap: int = 10

    # Clustering.
    clusters: int = 13
    restarts: int = 10
    max_iter: int = 1000
    seed: int = 42
    elbow_ks: tuple[int, ...] = tuple(range(1, 20))
    # An analyst's names for the clusters of a saved model: number -> (short, full), and the order in
    # which the short names are shown. Without them a cluster is called by its number.
    cluster_names: dict = field(default_factory=dict)
    cluster_display_order: tuple[str, ...] = ()
    users_per_cluster: int = 8
    links_per_cluster: int = 10
    profile_url: str = "https://example.org/"

    # Money.
    expense_account_types: tuple[str, ...] = ("COLLECTIVE", "EVENT", "FUND", "PROJECT")
    expense_kinds: tuple[str, ...] = ("EXPENSE",)
    income_account_types: tuple[str, ...] = ("COLLECTIVE", "EVENT", "PROJECT")
    income_kinds: tuple[str, ...] = ("ADDED_FUNDS", "CONTRIBUTION", "PREPAID_PAYMENT_METHOD")
    usd_rates: dict = field(default_factory=lambda: dict(USD_RATES))
    # Slug of the account that hosts the platform's own funds; set it to your own.
    platform_host_slug: str = "platform-internal"
    # Slugs of the hosts whose share the headline numbers state apart.
    main_hosts: tuple[str, ...] = ()
    spam_slug_pattern: str = r"-\d+\.\d+$"
    min_transactions: int = 5
    host_methods: tuple[str, ...] = ("host", "blank")
    untipped_methods: tuple[str, ...] = ("host", "blank", "collective")
