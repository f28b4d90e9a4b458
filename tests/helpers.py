"""Small hand-made deployments."""

from __future__ import annotations

from dataclasses import replace

from cohortloom.config import Config
from cohortloom.functions.naming import camel_to_snake
from cohortloom.sources.tables import TABLE_SCHEMAS, Tables, schema_of

CFG = Config(
    activity_as_of="2023-09-09 12:00:00",
    order_as_of="2023-09-09 12:00:00",
    money_as_of="2023-09-09 12:00:00",
    exclude_user_ids=(90, 91),
    blocked_slugs=("blocked",),
    platform_host_slug="platform",
    usd_rates={"USD": 1.0, "EUR": 1.08},
)
NOW = "2023-09-01 00:00:00"


def table(spark, name: str, rows: list[dict]):
    """A table in snake case; columns that a row leaves out are null."""
    schema = schema_of(name)
    names = [camel_to_snake(c) for c in schema.names]
    unknown = {k for r in rows for k in r} - set(names)
    assert not unknown, unknown
    text = ", ".join(
        f"{new} {field.dataType.simpleString().replace('timestamp', 'string')}"
        for new, field in zip(names, schema.fields)
    )
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], text)
    casts = [
        f"CAST({new} AS {field.dataType.simpleString()}) AS {new}"
        for new, field in zip(names, schema.fields)
    ]
    return df.selectExpr(*casts)


def deployment(spark, **rows) -> Tables:
    names = [n for n in TABLE_SCHEMAS if n in Tables.__dataclass_fields__]
    return Tables(**{n: table(spark, n, rows.get(n, [])) for n in names})


def config(**changes) -> Config:
    return replace(CFG, **changes)


def plan_of(df) -> str:
    """Physical plan; the final one if the query ran."""
    return df._jdf.queryExecution().executedPlan().toString()
