"""Row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.functions.columns import as_of_literal, holds_any
from cohortloom.functions.naming import month_column


def _in_months(df: DataFrame, ts: str, start: Column, end: Column) -> DataFrame:
    """Of a table laid out by the month of ``ts``, only the months that can hold the period.

    Two days more at both ends, because the layout may have been written in another time zone.
    """
    month = month_column(ts)
    if month not in df.columns:
        return df
    spare = F.expr("INTERVAL '2' DAY")
    first, last = F.trunc(start - spare, "month"), F.trunc(end + spare, "month")
    return df.filter((F.col(month) >= first) & (F.col(month) <= last)).drop(month)


def rolling_window(df: DataFrame, ts: str, as_of=None, window="INTERVAL '12' MONTH") -> DataFrame:
    """Rows after ``as_of - window`` and not after ``as_of``."""
    end = as_of_literal(as_of, df.schema[ts].dataType)
    start = end - F.expr(window)
    return _in_months(df.filter((F.col(ts) > start) & (F.col(ts) <= end)), ts, start, end)


def month_period(df: DataFrame, ts: str, as_of=None, months: int = 12) -> DataFrame:
    """The ``months`` whole months before the current one."""
    dtype = df.schema[ts].dataType
    now = as_of_literal(as_of, dtype)

    def month_start(moment: Column) -> Column:
        return F.date_trunc("month", moment).cast(dtype)

    start, end = month_start(now - F.expr(f"INTERVAL '{months}' MONTH")), month_start(now)
    return _in_months(df.filter((F.col(ts) >= start) & (F.col(ts) < end)), ts, start, end)


def keep_values(df: DataFrame, column: str, values) -> DataFrame:
    return df.filter(F.col(column).isin(*values))


def drop_values(df: DataFrame, column: str, values) -> DataFrame:
    return df.filter(~F.col(column).isin(*values)) if values else df


def drop_blocked(df: DataFrame, list_columns, slugs) -> DataFrame:
    """Drop rows that name a blocked account in any of the lists."""
    return df.filter(~holds_any(list_columns, slugs)) if slugs else df


def drop_zero(df: DataFrame, column: str) -> DataFrame:
    """Drop zero amounts; a missing amount stays."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(0)))


def above(df: DataFrame, column: str, threshold) -> DataFrame:
    return df.filter(F.col(column) > threshold)


def activity_range(
    df: DataFrame, column: str, low, high, rows: int = 10, order=("user_id",)
) -> DataFrame:
    """The first rows, in a fixed order, with ``low < column < high``."""
    return df.filter((F.col(column) > low) & (F.col(column) < high)).orderBy(*order).limit(rows)
