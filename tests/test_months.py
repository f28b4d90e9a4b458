"""Tables laid out by month, and windows that read only their months."""

from __future__ import annotations

import os
import re
from dataclasses import replace

import pytest

from cohortloom.operators.counting import class_counts
from cohortloom.operators.filters import month_period, rolling_window
from cohortloom.operators.money import expense_rollup, income_rollup
from cohortloom.sources.sample import CONFIG, SampleTables
from cohortloom.sources.tables import TABLE_SCHEMAS, TIME_OF, Tables, read_table, write_by_month
from tests.helpers import plan_of, table

SF = "/root/testdata/sf0.001"


def times(spark, *moments):
    rows = [{"id": i, "user_id": i, "created_at": m} for i, m in enumerate(moments)]
    return table(spark, "activities", rows)


def files_read(df) -> int:
    df.collect()
    metrics = []

    def walk(node):
        name = node.nodeName()
        if "AdaptiveSparkPlan" in name:
            return walk(node.executedPlan())
        if name.startswith("Scan parquet"):
            metrics.append(node.metrics().apply("numFiles").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    assert len(metrics) == 1
    return metrics[0]


@pytest.mark.parametrize("zone", ["UTC", "Pacific/Kiritimati", "Pacific/Pago_Pago"])
def test_windows_read_their_months_and_find_the_same_rows(spark, tmp_path, settings, zone):
    months = [f"{y}-{m:02d}" for y in (2021, 2022, 2023) for m in range(1, 13)]
    moments = [f"{m}-{d}" for m in months for d in ("01 00:00:00", "01 13:00:00", "15 08:00:00", "28 23:59:59")]
    plain = times(spark, *moments, None)
    path = str(tmp_path / "activities")
    settings(spark__sql__session__timeZone=zone)
    write_by_month(plain, "activities", path)
    settings(spark__sql__session__timeZone="UTC")
    laid = read_table(spark, "activities", path)
    assert laid.count() == plain.count()
    for as_of in ("2023-03-01 00:00:00", "2023-02-28 23:59:59", "2022-07-15 08:00:00"):
        for window in (
            lambda df: rolling_window(df, "created_at", as_of),
            lambda df: rolling_window(df, "created_at", as_of, "INTERVAL '1' MONTH"),
            lambda df: month_period(df, "created_at", as_of),
            lambda df: month_period(df, "created_at", as_of, 3),
        ):
            found, expected = window(laid), window(plain)
            assert found.columns == expected.columns
            assert sorted(r.id for r in found.collect()) == sorted(r.id for r in expected.collect())
    total = sum(len([f for f in fs if f.endswith(".parquet")]) for _, _, fs in os.walk(path))
    year = rolling_window(laid, "created_at", "2022-12-31 12:00:00")
    assert re.search(r"PartitionFilters: \[[^]]*created_at_month", plan_of(year))
    assert files_read(year) <= total / 2
    assert files_read(month_period(laid, "created_at", "2022-12-15 12:00:00", 1)) <= total / 8


def test_results_are_the_same_from_tables_by_month(spark, tmp_path):
    t = SampleTables(spark, SF)
    laid = {}
    for name in TIME_OF:
        path = str(tmp_path / name)
        write_by_month(getattr(t, name), name, path)
        laid[name] = read_table(spark, name, path)
    names = [n for n in TABLE_SCHEMAS if n in Tables.__dataclass_fields__]
    by_month = Tables(**{n: laid.get(n, getattr(t, n)) for n in names})
    for build in (class_counts, expense_rollup, income_rollup):
        assert sorted(map(str, build(by_month, CONFIG).collect())) == sorted(map(str, build(t, CONFIG).collect()))
    ledger = plan_of(expense_rollup(by_month, CONFIG))
    assert re.search(r"PartitionFilters: \[[^]]*created_at_month", ledger)
    # Without a fixed time the period ends now; the months are known when the query starts.
    now = plan_of(expense_rollup(by_month, replace(CONFIG, money_as_of=None)))
    assert re.search(r"PartitionFilters: \[[^]]*created_at_month[^]]*(>=|<=)", now)


def test_an_empty_table_by_month(spark, tmp_path):
    path = str(tmp_path / "activities")
    write_by_month(times(spark), "activities", path)
    assert rolling_window(read_table(spark, "activities", path), "created_at", "2023-01-01").collect() == []
