"""Scalar expressions. Every function takes and returns Spark columns, so all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from cohortloom.config import NO_HOST_LABEL, Config
from cohortloom import config as C


def as_of_literal(as_of, dtype: DataType) -> Column:
    """The reference time as a constant of the column's own type, so that filters reach the scan."""
    moment = F.localtimestamp() if as_of is None else F.lit(str(as_of))
    return moment.cast(dtype)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def first_match(
    rules: Sequence[tuple[Column, str]],
    default: str | None = None,
    names: dict[str, str] | None = None,
) -> Column:
    """Label of the first rule that holds; unknown (null) conditions fall through.

    ``names`` gives other names to the labels; a label without one becomes null.
    """

    def shown(label: str | None) -> Column:
        return F.lit(names.get(label) if names else label).cast("string")

    condition, label = rules[0]
    chain = F.when(condition, shown(label))
    for condition, label in rules[1:]:
        chain = chain.when(condition, shown(label))
    return chain if default is None else chain.otherwise(shown(default))


def by_value(column: str, choices: dict[str, Column]) -> Column:
    """The expression that belongs to the value in ``column``."""
    chain = None
    for value, choice in choices.items():
        hit = F.col(column) == value
        chain = F.when(hit, choice) if chain is None else chain.when(hit, choice)
    return chain


def sum_of(names: Iterable[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(n) for n in names])


# --- Classification ----------------------------------------------------------------------------


def is_internal() -> Column:
    """Payer and payee are parent and child, child and parent, or share a parent.

    Plain equality on purpose: two accounts without a parent are not related.
    """
    return any_of(
        [
            F.col("payer_id") == F.col("payee_parent_id"),
            F.col("payee_id") == F.col("payer_parent_id"),
            F.col("payee_parent_id") == F.col("payer_parent_id"),
        ]
    )


def expense_label(names: dict[str, str] | None = None) -> Column:
    return first_match(
        [(is_internal(), C.INTERNAL_EXPENSE), (F.col("admin_links") > 0, C.OWN_EXPENSE)],
        C.EXPENSE,
        names,
    )


def contribution_label(cfg: Config, names: dict[str, str] | None = None) -> Column:
    """The order of the rules matters: an event paid from host funds is "via host"."""
    own_money = [F.col("payer_slug") == F.col("user_slug")]
    own_money += [F.col("payer_slug").startswith(p) for p in cfg.direct_slug_prefixes]
    return first_match(
        [
            (is_internal(), C.INTERNAL_TRANSFER),
            (F.col("paid_by_host"), C.VIA_HOST),
            (F.col("payee_type") == "EVENT", C.EVENT_ORDER),
            (F.col("admin_links") > 0, C.OWN_CONTRIBUTION),
            (F.col("payer_type") == "ORGANIZATION", C.VIA_ORGANIZATION),
            (any_of(own_money), C.DIRECT),
        ],
        C.VIA_COLLECTIVE,
        names,
    )


def log_act(type_col: str, cfg: Config) -> Column:
    """What a log row counts as. Expenses still await their label; other types are final."""
    t = F.col(type_col)
    return first_match(
        [
            (t.isin(*cfg.expense_types), "expense"),
            (t.isin(*cfg.virtual_card_types), "virtual_card_purchases"),
            (t.isin(*cfg.host_admin_types), "host_admin_activities"),
            (t.isin(*cfg.collective_admin_types), "collective_admin_activities"),
        ]
    )


def host_label(slug: str) -> Column:
    return F.coalesce(F.col(slug), F.lit(NO_HOST_LABEL))


# --- Lists -------------------------------------------------------------------------------------


def parse_list(name: str) -> Column:
    """``"{a, b}"`` -> ``["a", "b"]``; empty items are dropped and a missing text gives ``[]``."""
    inner = F.expr(f"substring(`{name}`, 2, greatest(length(`{name}`) - 2, 0))")
    items = F.filter(F.split(inner, ", ", -1), lambda item: item != "")
    return F.coalesce(items, F.array().cast("array<string>"))


def holds_any(list_columns: Sequence[str], values: Sequence[str]) -> Column:
    """True if any of the lists holds any of the values; missing lists hold nothing."""
    wanted = F.array(*[F.lit(v) for v in values])
    return any_of(
        [F.coalesce(F.arrays_overlap(F.col(c), wanted), F.lit(False)) for c in list_columns]
    )


# --- Numbers -----------------------------------------------------------------------------------


def log_score(count: str) -> Column:
    """Base-10 logarithm of a count."""
    return F.log10(F.col(count))


def rank_bucket(score: Column, width: float) -> Column:
    """Number of the score's bucket as a double; a missing score is rank 0."""
    return F.coalesce(F.ceil(score / F.lit(width)).cast("double"), F.lit(0.0))


def level_score(norm: Column) -> Column:
    """0 for zero, then 1, 2, 3 by thirds."""
    return F.when(norm == 0, 0).when(norm < 0.33, 1).when(norm < 0.66, 2).otherwise(3)


def percent_label(name: str) -> Column:
    return F.concat(F.col(name).cast("int").cast("string"), F.lit("%"))


def percent_of(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part, whole) * 100, 2)


def whole_usd(amount: Column) -> Column:
    """Truncate toward zero, then drop the sign."""
    return F.abs(amount.cast("bigint"))


def to_usd(cents: str, rate: str, currency: str) -> Column:
    """Cents to dollars, in decimals, so that sums do not depend on their order.

    An amount in a currency without a rate is an error.
    """
    exact = F.col(rate).cast("decimal(17,10)")
    known = F.when(F.col(rate).isNotNull(), exact).otherwise(
        F.raise_error(F.concat(F.lit("no exchange rate for "), F.col(currency))).cast("decimal(17,10)")
    )
    return F.col(cents).cast("decimal(17,0)") * (known * F.lit(Decimal("0.01")))


def profile_link(base_url: str, slug: Column) -> Column:
    return F.concat(F.lit(f'<a href="{base_url}'), slug, F.lit('">'), slug, F.lit("</a>"))


def anchor_id(title: str) -> Column:
    return F.lower(F.regexp_replace(F.col(title), "[ :]", "-"))


# --- Yeo-Johnson -------------------------------------------------------------------------------


def number(value: float) -> str:
    """A double as SQL text, without loss."""
    return f"({value!r}D)"


def yeo_johnson(x: str, power: str) -> Column:
    """Power transform that is defined for all real x and smooth at x = 0.

    Both arguments are SQL text: a column name, or a number from :func:`number`.
    """
    up = f"CASE WHEN {power} = 0 THEN log1p({x}) ELSE (power({x} + 1, {power}) - 1) / {power} END"
    rest = f"(2 - {power})"
    down = f"CASE WHEN {rest} = 0 THEN log1p(-{x}) ELSE (power(1 - {x}, {rest}) - 1) / {rest} END"
    return F.expr(f"CASE WHEN {x} >= 0 THEN {up} ELSE -({down}) END")
