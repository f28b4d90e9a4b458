"""Source tables: schemas, scans and the columns each operator needs.

Schemas are fixed, never inferred. The operational tables use camel-case names; scans rename them,
so everything behind this module sees snake case.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortloom.config import CLASSES
from cohortloom.functions.columns import parse_list
from cohortloom.functions.naming import (
    camel_to_snake,
    month_column,
    rename_camel,
    rename_titles,
)

# --- Fixed values: columns of the operational tables, as text in Spark's DDL notation ----------
TABLE_SCHEMAS = {
    "activities": "id bigint, UserId bigint, createdAt timestamp, type string, "
    "CollectiveId bigint, FromCollectiveId bigint",
    "users": "id bigint, CollectiveId bigint",
    "collectives": "id bigint, name string, countryISO string, currency string, "
    "description string, geoLocationLatLong string, HostCollectiveId bigint, "
    "hostFeePercent double, isHostAccount boolean, longDescription string, "
    "ParentCollectiveId bigint, platformFeePercent double, slug string, type string",
    "members": "MemberCollectiveId bigint, CollectiveId bigint, role string",
    "orders": "id bigint, CreatedByUserId bigint, createdAt timestamp, updatedAt timestamp, "
    "status string, CollectiveId bigint, FromCollectiveId bigint, PaymentMethodId int, "
    "platformTipAmount bigint",
    "payment_methods": "id int, type string",
    "transactions": "id bigint, createdAt timestamp, OrderId bigint, type string, kind string, "
    "CollectiveId bigint, HostCollectiveId bigint, currency string, PaymentMethodId int, "
    "amount bigint",
    "exchange_rates": "currency string, rate double",
    # Roll-ups that were exported earlier.
    "expense_rollup": "CollectiveId bigint, HostCollectiveId bigint, currency string, "
    "transactionCount bigint, totalAmount bigint",
    "income_rollup": "CollectiveId bigint, HostCollectiveId bigint, PaymentMethodType string, "
    "currency string, transactionCount bigint, totalAmount bigint, platformTipAmount bigint",
}


def schema_of(name: str) -> StructType:
    return StructType.fromDDL(TABLE_SCHEMAS[name])


def account_columns() -> list[str]:
    """The fourteen columns of the account table, in snake case."""
    return [camel_to_snake(c) for c in schema_of("collectives").names]


# Tables whose text can hold line breaks; such a CSV file is read by one task.
FREE_TEXT = ("collectives",)


def csv_options(free_text: bool = False) -> dict[str, str]:
    """A header is required and must name the columns in the order of the schema; a row that does not
    fit the schema is an error."""
    options = {"header": "true", "enforceSchema": "false", "mode": "FAILFAST", "escape": '"'}
    return options | ({"multiLine": "true"} if free_text else {})


def jdbc_options(
    url: str, table: str, partition_column: str, lower: int | str, upper: int | str, partitions: int
) -> dict[str, str]:
    """Options for a table read by ``partitions`` tasks, each with a range of one column."""
    return {
        "url": url,
        "dbtable": table,
        "partitionColumn": partition_column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_table(
    spark: SparkSession,
    name: str,
    path: str | None = None,
    columns: list[str] | None = None,
    source: str = "parquet",
    **options: str,
) -> DataFrame:
    """Scan one operational table and keep ``columns`` (snake case), or all of them.

    ``source`` is any Spark source (parquet, orc, csv, json, jdbc, ...); ``options`` go to it. A
    database needs the options of :func:`jdbc_options` and no path.
    """
    if source == "csv":
        options = csv_options(name in FREE_TEXT) | options
    reader = spark.read.format(source).options(**options)
    if source != "jdbc":
        reader = reader.schema(schema_of(name))
    elif path or "dbtable" not in options:
        raise ValueError(f"{name}: a database is read by its options, not by a path")
    df = rename_camel(reader.load(path) if path else reader.load())
    return df.select(*columns) if columns else df


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension of some rows that the program itself holds."""
    columns = StructType.fromDDL(schema)
    arrow = pa.Table.from_pylist(
        [dict(zip(columns.names, row)) for row in rows], to_arrow_schema(columns)
    )
    return spark.createDataFrame(arrow)


def read_csv(
    spark: SparkSession, path: str, schema: StructType | str, free_text: bool = False, **options: str
) -> DataFrame:
    """CSV export with a header. With ``free_text``, quoted line breaks are read, each file by one
    task; keep large exports in Parquet."""
    return spark.read.options(**(csv_options(free_text) | options)).schema(schema).csv(path)


def read_rollup(spark: SparkSession, name: str, path: str) -> DataFrame:
    """An exported roll-up: ``expense_rollup`` or ``income_rollup``."""
    return rename_camel(read_csv(spark, path, schema_of(name)))


def write_rollup(df: DataFrame, name: str, path: str) -> None:
    """Write a roll-up as the CSV that :func:`read_rollup` reads."""
    titles = schema_of(name).names
    df.select(*[F.col(camel_to_snake(c)).alias(c) for c in titles]).write.options(header="true", escape='"').csv(path)


def cohort_export_schema() -> StructType:
    """The exported cohort table: lists are still text, titles are still titles."""
    parts = ["`UserId` bigint", "`UserSlug` string"]
    for c in CLASSES:
        parts += [
            f"`{c.title}` bigint",
            f"`Log {c.title}` double",
            f"`{c.stem} Score` double",
            f"`{c.stem} Rank` double",
            f"`{c.stem} Percentile` int",
            f"`{c.stem} Hosts` string",
        ]
        if c.from_orders:
            parts += [f"`{c.stem} Recipients` string", f"`{c.stem} Recipient Count` int"]
    return StructType.fromDDL(", ".join(parts))


def kept_columns() -> list[str]:
    """The thirty columns that the user analysis keeps: ids, counts and lists."""
    names = ["user_id", "user_slug"]
    for c in CLASSES:
        names += [c.measure, *[c.column(part) for part in c.list_parts]]
    return names


def load_cohort_export(spark: SparkSession, path: str) -> DataFrame:
    """Read an exported cohort table, keep thirty columns and turn list texts into arrays."""
    df = rename_titles(read_csv(spark, path, cohort_export_schema()))
    lists = {c.column(part) for c in CLASSES for part in c.list_parts}
    return df.select(
        *[parse_list(n).alias(n) if n in lists else F.col(n) for n in kept_columns()]
    )


def write_list_text(df: DataFrame) -> DataFrame:
    """Arrays as ``{a, b}`` text, for a CSV sink; the inverse of the list parser."""
    return df.select(
        *[
            F.concat(F.lit("{"), F.array_join(F.col(n), ", "), F.lit("}")).alias(n)
            if t.startswith("array")
            else F.col(n)
            for n, t in df.dtypes
        ]
    )


# The large tables, and the time by which their rows are asked for.
TIME_OF = {"activities": "created_at", "orders": "updated_at", "transactions": "created_at"}


def write_by_month(df: DataFrame, name: str, path: str, mode: str = "errorifexists") -> None:
    """Write the log, the orders or the ledger with a folder for each month of its time.

    :func:`read_table` reads it with the month as one more column, which the time windows turn into a
    filter on folders. Rows are dealt out by month and id, so a task writes few months and a month with a
    third of all rows is written by many tasks. Rows without a time have a folder of their own, which no
    window reads.
    """
    ts = TIME_OF[name]
    month = month_column(ts)
    titles = schema_of(name).names
    dated = df.select(
        *[F.col(camel_to_snake(c)).alias(c) for c in titles], F.trunc(ts, "month").alias(month)
    )
    dated.repartitionByRange(month, "id").write.partitionBy(month).mode(mode).parquet(path)


@dataclass(frozen=True)
class Tables:
    """The operational tables of one deployment, in snake case."""

    activities: DataFrame
    users: DataFrame
    collectives: DataFrame
    members: DataFrame
    orders: DataFrame
    payment_methods: DataFrame
    transactions: DataFrame

    @classmethod
    def read(
        cls,
        spark: SparkSession,
        root: str | None = None,
        source: str = "parquet",
        of_table: dict[str, dict[str, str]] | None = None,
        **options,
    ) -> Tables:
        """All tables: folders below ``root``, or for a database ``of_table``, the options of each."""
        own = of_table or {}
        return cls(
            **{
                f.name: read_table(
                    spark, f.name, root and f"{root}/{f.name}", source=source, **(options | own.get(f.name, {}))
                )
                for f in fields(cls)
            }
        )
