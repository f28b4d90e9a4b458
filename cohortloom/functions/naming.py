"""Column and anchor names. These work on names only, never on rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

_WORD_START = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Za-z0-9])(?=[A-Z][a-z])")


def title_to_snake(title: str) -> str:
    """``"Event Orders Hosts"`` -> ``"event_orders_hosts"``."""
    name = title.lower().replace(" ", "_")
    return {"userid": "user_id", "userslug": "user_slug"}.get(name, name)


def camel_to_snake(name: str) -> str:
    """``"HostCollectiveId"`` -> ``"host_collective_id"``, ``"countryISO"`` -> ``"country_iso"``."""
    return _WORD_START.sub("_", name).lower()


def rename_titles(df: DataFrame) -> DataFrame:
    return df.toDF(*[title_to_snake(c) for c in df.columns])


def rename_camel(df: DataFrame) -> DataFrame:
    return df.toDF(*[camel_to_snake(c) for c in df.columns])


def month_column(ts: str) -> str:
    """The column by which a table is laid out in months of ``ts``."""
    return f"{ts}_month"
