"""The operational tables derived from an order-and-events star schema.

The text runs on Spark and, with plain table names, on other engines; modulo rules make every
branch of the classification occur.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from cohortloom.config import Config

# Columns of the source tables that the views use.
SOURCE_SCHEMAS = {
    "customer": "c_custkey bigint, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_size int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_extendedprice double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "region": "r_regionkey int",
}

VIEWS = {
    "collectives": """
SELECT id, concat('Account ', CAST(id AS STRING)) AS name,
 CASE id % 3 WHEN 0 THEN 'US' WHEN 1 THEN 'BE' ELSE CAST(NULL AS STRING) END AS country_iso,
 CASE id % 2 WHEN 0 THEN 'USD' ELSE 'EUR' END AS currency,
 CASE WHEN id % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat('About ', slug) END AS description,
 CASE WHEN id % 7 = 0 THEN '50.85,4.35' ELSE CAST(NULL AS STRING) END AS geo_location_lat_long,
 host_collective_id, host_fee_percent, type = 'ORGANIZATION' AS is_host_account,
 CASE WHEN id % 4 = 0 THEN CAST(NULL AS STRING) ELSE concat('First, a "quoted" line', chr(10), 'then another of ', slug) END AS long_description,
 parent_collective_id, CASE WHEN id % 6 = 0 THEN CAST(5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS platform_fee_percent,
 slug, type FROM (
SELECT c_custkey AS id,
 CASE WHEN c_custkey % 23 = 5 THEN concat('incognito-', CAST(c_custkey AS STRING)) WHEN c_custkey % 29 = 7 THEN concat('guest-', CAST(c_custkey AS STRING)) ELSE concat('user-', CAST(c_custkey AS STRING)) END AS slug,
 CASE WHEN c_mktsegment = 'MACHINERY' AND c_custkey % 2 = 0 THEN 'ORGANIZATION' ELSE 'USER' END AS type,
 CAST(NULL AS BIGINT) AS host_collective_id, CAST(NULL AS BIGINT) AS parent_collective_id, CAST(NULL AS DOUBLE) AS host_fee_percent
FROM {customer}
UNION ALL
SELECT 1000000 + s_suppkey, CASE WHEN s_suppkey = 3 THEN 'platform-internal' ELSE concat('host-', CAST(s_suppkey AS STRING)) END, 'ORGANIZATION',
 1000000 + s_suppkey, CAST(NULL AS BIGINT), CASE WHEN s_suppkey % 9 = 8 THEN CAST(NULL AS DOUBLE) ELSE CAST((s_nationkey % 4) * 2.5 AS DOUBLE) END
FROM {supplier}
UNION ALL
SELECT 2000000 + p_partkey,
 CASE WHEN p_partkey % 50 = 15 THEN concat('spam-', CAST(p_partkey AS STRING), '.', CAST(p_size AS STRING)) WHEN p_partkey % 389 = 17 THEN concat('blocked-', CAST(p_partkey AS STRING)) ELSE concat('project-', CAST(p_partkey AS STRING)) END,
 CASE WHEN p_partkey % 10 = 0 THEN 'EVENT' WHEN p_partkey % 10 IN (1, 2) THEN 'PROJECT' WHEN p_partkey % 10 = 3 THEN 'FUND' ELSE 'COLLECTIVE' END,
 CASE WHEN p_partkey % 14 = 6 THEN 2000000 + p_partkey WHEN p_partkey % 14 = 13 THEN CAST(NULL AS BIGINT) ELSE 1000000 + p_partkey % 7 + p_partkey % 3 END,
 CASE WHEN p_partkey % 10 IN (0, 1, 2) AND p_partkey >= 10 THEN 2000004 + p_partkey - p_partkey % 10 ELSE CAST(NULL AS BIGINT) END,
 CASE WHEN p_partkey % 14 = 6 THEN CAST(0 AS DOUBLE) ELSE CAST(NULL AS DOUBLE) END
FROM {part}
) accounts
""",
    "users": "SELECT c_custkey AS id, c_custkey AS collective_id FROM {customer}",
    "members": """
SELECT c_custkey AS member_collective_id, 2000004 + (c_custkey % 20) * 10 AS collective_id, CASE WHEN c_custkey % 5 = 4 THEN 'BACKER' ELSE 'ADMIN' END AS role FROM {customer}
UNION ALL
SELECT c_custkey, 2000004 + (c_custkey % 20) * 10, 'ADMIN' FROM {customer} WHERE c_custkey % 11 = 0
""",
    "payment_methods": """
SELECT r_regionkey + 1 AS id, CASE r_regionkey WHEN 0 THEN 'host' WHEN 1 THEN 'creditcard' WHEN 2 THEN 'collective' WHEN 3 THEN 'paypal' ELSE 'manual' END AS type FROM {region}
""",
    "activities": """
SELECT event_id AS id, user_id, ts AS created_at,
 CASE WHEN event_type = 'purchase' AND event_id % 2 = 0 THEN 'collective.expense.created'
      WHEN event_type = 'purchase' THEN 'virtualcard.purchase'
      WHEN event_type = 'click' AND user_id % 4 = 0 THEN 'collective.expense.paid'
      WHEN event_type = 'click' AND user_id % 4 = 1 THEN 'collective.approved'
      WHEN event_type = 'signup' AND user_id % 3 = 0 THEN 'collective.apply'
      WHEN event_type = 'signup' AND user_id % 3 = 1 THEN 'collective.update.created'
      WHEN event_type = 'error' THEN 'collective.expense.rejected'
      ELSE 'user.signin' END AS type,
 CASE WHEN event_id % 6 = 0 THEN 2000004 + (user_id % 20) * 10
      WHEN event_id % 6 = 2 THEN 2000010 + (user_id % 10) * 10
      ELSE 2000000 + (event_id * 7 + user_id) % 200 END AS collective_id,
 CASE WHEN event_id % 6 = 2 THEN 2000014 + (user_id % 10) * 10
      WHEN event_id % 13 = 12 THEN CAST(NULL AS BIGINT)
      ELSE user_id END AS from_collective_id
FROM {events}
""",
    "contrib_orders": """
SELECT o_orderkey AS id, o_custkey AS created_by_user_id, o_orderdate AS created_at, o_orderdate AS updated_at,
 CASE WHEN o_orderstatus = 'F' THEN 'PAID' WHEN o_orderstatus = 'O' THEN 'ACTIVE' WHEN o_orderpriority = '1-URGENT' THEN 'EXPIRED' WHEN o_orderpriority = '2-HIGH' THEN 'ERROR' ELSE 'CANCELLED' END AS status,
 CASE WHEN o_orderkey % 9 = 0 THEN 2000004 + (o_custkey % 20) * 10
      WHEN o_orderkey % 9 = 1 THEN 2000010 + (o_custkey % 10) * 10
      ELSE 2000000 + (o_orderkey * 7 + o_custkey) % 200 END AS collective_id,
 CASE WHEN o_orderkey % 9 = 1 THEN 2000014 + (o_custkey % 10) * 10
      WHEN o_orderkey % 9 = 2 THEN 2000004 + (o_custkey % 17) * 10
      WHEN o_orderkey % 9 = 3 THEN o_custkey - o_custkey % 23 + 5
      WHEN o_orderkey % 9 = 4 THEN o_custkey - o_custkey % 29 + 7
      WHEN o_orderkey % 53 = 52 THEN CAST(NULL AS BIGINT)
      ELSE o_custkey END AS from_collective_id,
 CASE WHEN o_orderkey % 8 = 7 THEN CAST(NULL AS INT) ELSE CAST(1 + o_orderkey % 5 AS INT) END AS payment_method_id,
 CASE WHEN o_orderkey % 3 = 0 THEN CAST(NULL AS BIGINT) ELSE o_orderkey % 700 END AS platform_tip_amount
FROM {orders}
""",
    "transactions": """
SELECT l_orderkey * 10 + l_linenumber AS id, l_shipdate AS created_at, l_orderkey AS order_id,
 CASE WHEN l_returnflag = 'R' THEN 'DEBIT' ELSE 'CREDIT' END AS type,
 CASE WHEN l_returnflag = 'R' AND (l_partkey % 25 IN (8, 9) OR l_linestatus = 'O' OR (l_partkey % 200 % 28 = 20 AND l_orderkey >= 3000)) THEN 'HOST_FEE' WHEN l_returnflag = 'R' THEN 'EXPENSE'
      WHEN l_linenumber % 4 = 0 AND l_partkey % 25 <> 9 THEN 'ADDED_FUNDS' WHEN l_linenumber % 4 = 3 OR (l_partkey % 25 = 9 AND l_orderkey >= 1200) THEN 'PLATFORM_TIP' ELSE 'CONTRIBUTION' END AS kind,
 CASE WHEN l_partkey % 41 = 0 THEN 1000000 + l_suppkey % 10 ELSE 2000000 + l_partkey % 200 END AS collective_id,
 CASE WHEN l_partkey % 200 % 14 = 6 THEN 2000000 + l_partkey % 200 WHEN l_partkey % 200 % 14 = 13 THEN CAST(NULL AS BIGINT) ELSE 1000000 + l_partkey % 200 % 7 + l_partkey % 200 % 3 END AS host_collective_id,
 CASE l_suppkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'EUR' WHEN 2 THEN 'GBP' ELSE 'SEK' END AS currency,
 CASE WHEN l_linenumber = 1 OR l_partkey % 25 = 8 THEN 1 WHEN l_orderkey % 8 = 7 THEN CAST(NULL AS INT) ELSE CAST(1 + l_orderkey % 5 AS INT) END AS payment_method_id,
 (CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END) * CAST(round(CASE WHEN l_partkey % 200 = 25 AND l_suppkey % 4 = 3 THEN 0 ELSE l_extendedprice END * 100) AS BIGINT) AS amount
FROM {lineitem}
""",
}

CONFIG = Config(
    activity_as_of="2024-01-20 00:00:00",
    activity_window="INTERVAL '10' DAY",
    order_as_of="2000-07-15 00:00:00",
    money_as_of="2000-07-15 00:00:00",
    exclude_user_ids=(4, 12),
    blocked_slugs=("blocked-17",),
    platform_host_slug="platform-internal",
    usd_rates={"USD": 1.0, "EUR": 1.08, "GBP": 1.25, "SEK": 0.108},
    main_hosts=("host-1", "host-4"),
    # Low enough that the sample has users on both sides.
    modifier_threshold=5,
    histogram_cap=8,
)


def sql_text(view: str) -> str:
    """The view over plain table names."""
    return VIEWS[view].format(**{name: name for name in SOURCE_SCHEMAS}).strip()


class SampleTables:
    """The tables of :class:`cohortloom.sources.tables.Tables`, each built when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._sources: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        if name not in self._sources:
            reader = self.spark.read.schema(SOURCE_SCHEMAS[name])
            self._sources[name] = reader.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._sources[name]

    def view(self, name: str) -> DataFrame:
        text = VIEWS[name]
        used = [n for n in SOURCE_SCHEMAS if "{" + n + "}" in text]
        return self.spark.sql(text, **{n: self.source(n) for n in used})

    @cached_property
    def activities(self) -> DataFrame:
        return self.view("activities")

    @cached_property
    def users(self) -> DataFrame:
        return self.view("users")

    @cached_property
    def collectives(self) -> DataFrame:
        return self.view("collectives")

    @cached_property
    def members(self) -> DataFrame:
        return self.view("members")

    @cached_property
    def orders(self) -> DataFrame:
        return self.view("contrib_orders")

    @cached_property
    def payment_methods(self) -> DataFrame:
        return self.view("payment_methods")

    @cached_property
    def transactions(self) -> DataFrame:
        return self.view("transactions")
