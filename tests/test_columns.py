from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import columns as fc
from cohortloom.functions.naming import camel_to_snake, rename_titles, title_to_snake
from cohortloom.operators.filters import (
    activity_range,
    drop_blocked,
    drop_zero,
    month_period,
    rolling_window,
)


def values(df, name="v"):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize(
    "camel, snake",
    [
        ("CollectiveId", "collective_id"),
        ("HostCollectiveId", "host_collective_id"),
        ("hostFeePercent", "host_fee_percent"),
        ("countryISO", "country_iso"),
        ("geoLocationLatLong", "geo_location_lat_long"),
        ("platformTipAmount", "platform_tip_amount"),
        ("PaymentMethodType", "payment_method_type"),
        ("id", "id"),
    ],
)
def test_camel_to_snake(camel, snake):
    assert camel_to_snake(camel) == snake


def test_titles(spark):
    assert title_to_snake("Contributions Via Host Hosts") == "contributions_via_host_hosts"
    df = rename_titles(spark.createDataFrame([(1, "a", 2)], ["UserId", "UserSlug", "Event Orders"]))
    assert df.columns == ["user_id", "user_slug", "event_orders"]


def test_parse_list(spark):
    rows = [("{a, b}",), ("{}",), ("{a, , b}",), (None,), ("[x]",), ("{",), ("",)]
    df = spark.createDataFrame(rows, "t string").select(fc.parse_list("t").alias("v"))
    assert values(df) == [["a", "b"], [], ["a", "b"], [], ["x"], [], []]


def test_spam_pattern(spark):
    slugs = ["abc-12.5", "abc-12.5x", "abc-125", "a-1.2-3.4", "abc12.5"]
    df = spark.createDataFrame([(s,) for s in slugs], "s string")
    hits = df.filter(F.col("s").rlike(r"-\d+\.\d+$"))
    assert sorted(values(hits, "s")) == ["a-1.2-3.4", "abc-12.5"]


def test_whole_usd_truncates_toward_zero(spark):
    df = spark.createDataFrame([(-2.7,), (2.7,), (-0.4,)], "x double")
    assert values(df.select(fc.whole_usd(F.col("x")).alias("v"))) == [2, 2, 0]


def test_unknown_currency_is_an_error(spark):
    df = spark.createDataFrame([(100, None, "XXX")], "cents bigint, rate double, currency string")
    with pytest.raises(Exception, match="no exchange rate for XXX"):
        df.select(fc.to_usd("cents", "rate", "currency")).collect()


def test_level_score(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.33, 0.65, 0.66, 1.0)], "x double")
    assert values(df.select(fc.level_score(F.col("x")).alias("v"))) == [0, 1, 2, 2, 3, 3]


def test_rank_bucket(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.2,), (0.5,), (1.1,)], "x double")
    assert values(df.select(fc.rank_bucket(F.col("x"), 0.33).alias("v"))) == [0, 0, 1, 2, 4]


def test_log_score_is_base_ten(spark):
    df = spark.createDataFrame([(1,), (1000,)], "n bigint")
    assert values(df.select(fc.log_score("n").alias("v"))) == pytest.approx([0.0, 3.0])


def test_labels(spark):
    df = spark.createDataFrame([(2.5, "User Clusters: Map")], "fee double, title string")
    row = df.select(fc.percent_label("fee").alias("p"), fc.anchor_id("title").alias("a")).first()
    assert (row.p, row.a) == ("2%", "user-clusters--map")


@pytest.mark.parametrize("power", [-3.0, -1.0, 0.0, 0.5, 1.0, 2.0, 3.0])
def test_yeo_johnson(spark, power):
    def expected(x):
        if x >= 0:
            return math.log1p(x) if power == 0 else ((x + 1) ** power - 1) / power
        rest = 2 - power
        return -math.log1p(-x) if rest == 0 else -((1 - x) ** rest - 1) / rest

    xs = [-2.5, -1.0, 0.0, 0.5, 7.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = values(df.select(fc.yeo_johnson("x", fc.number(power)).alias("v")))
    assert got == pytest.approx([expected(x) for x in xs])


def times(spark, moments):
    return spark.createDataFrame([(m,) for m in moments], "t string").selectExpr(
        "CAST(t AS timestamp_ntz) AS t"
    )


def test_rolling_window_is_open_then_closed(spark):
    df = times(
        spark,
        ["2022-09-09 12:00:00", "2022-09-09 12:00:01", "2023-09-09 12:00:00", "2023-09-09 12:00:01"],
    )
    kept = rolling_window(df, "t", "2023-09-09 12:00:00")
    assert [str(t) for t in values(kept, "t")] == ["2022-09-09 12:00:01", "2023-09-09 12:00:00"]


def test_month_period_is_closed_then_open(spark):
    df = times(
        spark,
        ["2022-08-31 23:59:59", "2022-09-01 00:00:00", "2023-08-31 23:59:59", "2023-09-01 00:00:00"],
    )
    kept = month_period(df, "t", "2023-09-09 12:00:00")
    assert [str(t) for t in values(kept, "t")] == ["2022-09-01 00:00:00", "2023-08-31 23:59:59"]


def test_window_without_as_of_ends_now(spark):
    df = spark.sql("SELECT localtimestamp() - INTERVAL '1' DAY AS t")
    assert rolling_window(df, "t").count() == 1
    assert rolling_window(df, "t", window="INTERVAL '1' HOUR").count() == 0


def test_drop_zero_keeps_missing(spark):
    df = spark.createDataFrame([(0,), (5,), (None,)], "v bigint")
    assert values(drop_zero(df, "v")) == [5, None]


def test_drop_blocked_ignores_missing_lists(spark):
    rows = [(1, ["a"], None), (2, None, ["bad", "x"]), (3, [], []), (4, ["bad"], None)]
    df = spark.createDataFrame(rows, "v int, p array<string>, q array<string>")
    assert values(drop_blocked(df, ["p", "q"], ("bad", "worse"))) == [1, 3]
    assert values(drop_blocked(df, ["p"], ("bad",))) == [1, 2, 3]
    assert values(drop_blocked(df, ["p"], ())) == [1, 2, 3, 4]


def test_activity_range_is_open(spark):
    df = spark.createDataFrame([(i, i) for i in range(30)], "user_id int, v int")
    assert values(activity_range(df, "v", 10, 20)) == [11, 12, 13, 14, 15, 16, 17, 18, 19]
