from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortloom.functions.naming import rename_camel
from cohortloom.operators.money import expense_rollup
from cohortloom.plans.cohort import all_users, wide_cohort
from cohortloom.plans.report import write_report
from cohortloom.sources import stages as stage_module
from cohortloom.sources.sample import CONFIG, SampleTables
from cohortloom.sources.stages import StageArea, read_result
from cohortloom.sources.tables import (
    TABLE_SCHEMAS,
    Tables,
    account_columns,
    cohort_export_schema,
    jdbc_options,
    kept_columns,
    load_cohort_export,
    read_csv,
    read_rollup,
    read_table,
    schema_of,
    write_list_text,
    write_rollup,
)
from tests.helpers import config

SF = "/root/testdata/sf0.001"


def test_account_table_has_fourteen_columns():
    assert len(account_columns()) == 14
    assert {"host_collective_id", "host_fee_percent", "country_iso"} <= set(account_columns())


@pytest.mark.parametrize("source", ["parquet", "orc", "json", "csv"])
def test_read_table_renames_and_projects(spark, tmp_path, source):
    path = f"{tmp_path}/collectives"
    rows = [(i, f"slug-{i}") for i in range(3)]
    schema = schema_of("collectives")
    full = spark.createDataFrame(rows, "id bigint, slug string").select(
        *[F.col(f.name) if f.name in ("id", "slug") else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    )
    options = {"header": "true"} if source == "csv" else {}
    full.write.format(source).options(**options).save(path)
    df = read_table(spark, "collectives", path, ["slug", "id"], source)
    assert df.columns == ["slug", "id"]
    assert sorted(tuple(r) for r in df.collect()) == [("slug-0", 0), ("slug-1", 1), ("slug-2", 2)]


def csv_file(folder, text):
    (folder / "part.csv").write_text(text)
    return str(folder)


def test_csv_reads_quoted_line_breaks(spark, tmp_path):
    names = schema_of("collectives").names
    cells = {"id": "1", "slug": "a", "longDescription": '"one ""quoted""\ntwo"'}
    path = csv_file(tmp_path, ",".join(names) + "\n" + ",".join(cells.get(n, "") for n in names) + "\n")
    rows = read_table(spark, "collectives", path, ["id", "slug", "long_description"], "csv").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 'one "quoted"\ntwo')]


@pytest.mark.parametrize(
    "text", ["CollectiveId,id\n1,2\n", "1,2\n3,4\n", "id,CollectiveId\nx,2\n"], ids=["swapped", "no header", "text"]
)
def test_csv_that_does_not_fit_is_an_error(spark, tmp_path, text):
    with pytest.raises(Exception, match="(?i)header|malformed|parse"):
        read_table(spark, "users", csv_file(tmp_path, text), source="csv").collect()


def test_database_options(spark):
    options = jdbc_options("jdbc:x", "public.Users", "id", 1, 100, 8)
    assert options["numPartitions"] == "8" and options["dbtable"] == "public.Users"
    with pytest.raises(ValueError, match="not by a path"):
        Tables.read(spark, "folder", source="jdbc", of_table={"activities": options})
    with pytest.raises(ValueError, match="not by a path"):
        Tables.read(spark, source="jdbc")


def test_rollup_files(spark, tmp_path):
    rows = [(1, 2, "blank", "USD", 3, 400, None)]
    names = "collective_id bigint, host_collective_id bigint, payment_method_type string, currency string, transaction_count bigint, total_amount bigint, platform_tip_amount bigint"
    write_rollup(spark.createDataFrame(rows, names), "income_rollup", f"{tmp_path}/r")
    assert [tuple(r) for r in read_rollup(spark, "income_rollup", f"{tmp_path}/r").collect()] == rows


def test_stages_are_deleted_when_closed(spark, tmp_path):
    with StageArea(spark, str(tmp_path)) as area:
        area.save(spark.range(3), "t")
        assert list(tmp_path.iterdir())
    assert not list(tmp_path.iterdir())


def test_default_settings_drop_nothing():
    from cohortloom.config import Config

    assert Config().exclude_user_ids == Config().blocked_slugs == ()
    assert not Config().cluster_names


def test_tables_read_a_deployment(spark, tmp_path):
    for name in Tables.__dataclass_fields__:
        spark.createDataFrame([], schema_of(name)).write.parquet(f"{tmp_path}/{name}")
    t = Tables.read(spark, str(tmp_path))
    assert "host_collective_id" in t.transactions.columns
    assert expense_rollup(t, config()).count() == 0


def test_rollup_export(spark, tmp_path):
    """A roll-up that was exported as CSV can be read back."""
    path = f"{tmp_path}/rollup"
    rows = [(1, 2, "USD", 3, 400)]
    spark.createDataFrame(rows, TABLE_SCHEMAS["expense_rollup"]).write.csv(path, header=True)
    df = rename_camel(read_csv(spark, path, schema_of("expense_rollup")))
    assert df.first().asDict() == {
        "collective_id": 1,
        "host_collective_id": 2,
        "currency": "USD",
        "transaction_count": 3,
        "total_amount": 400,
    }


def test_cohort_export_round_trip(spark, tmp_path, stages):
    """Cohort table to CSV with list texts and titles, and back to arrays."""
    t = SampleTables(spark, SF)
    titles = cohort_export_schema().names
    wide = wide_cohort(t, CONFIG, stages)
    assert len(titles) == len(wide.columns) == 80
    path = f"{tmp_path}/export"
    write_list_text(wide).toDF(*titles).write.csv(path, header=True)
    loaded = load_cohort_export(spark, path)
    assert loaded.columns == kept_columns()
    assert loaded.exceptAll(all_users(t, CONFIG, stages)).isEmpty()
    assert loaded.count() == wide.count()


def test_stages_use_the_shared_folder(spark):
    area = StageArea(spark)
    assert area.root.startswith(spark.conf.get("spark.checkpoint.dir"))
    first = area.save(spark.range(3), "t")
    second = area.save(first.selectExpr("id + 1 AS id"), "t")
    assert (first.count(), second.agg(F.max("id")).first()[0]) == (3, 3)


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    class Cluster:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://elsewhere"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        stage_module.shared_folder(Cluster)


def test_report_bundle(spark, tmp_path):
    out = f"{tmp_path}/report"
    write_report(SampleTables(spark, SF), config_for_sample(), out)
    entries = read_result(spark, out, "manifest").collect()
    sections = [e.section_id for e in entries]
    assert sections[0] == "intro" and "crowdfunding" in sections and "user-profiles" in sections
    assert len(set(sections)) == 13
    for e in entries:
        if e.result_name:
            assert read_result(spark, out, e.result_name).count() == e.result_rows
    titled = [e for e in entries if e.title]
    assert all(e.item_id == e.title.lower().replace(" ", "-").replace(":", "-") for e in titled)
    numbers = {r.metric: r.value for r in read_result(spark, out, "headline_numbers").collect()}
    assert numbers["all_users"] == read_result(spark, out, "cohort_table").count()
    assert numbers["usd_tips"] == numbers["usd_tips_host_fee"] + numbers["usd_tips_no_host_fee"]
    assert read_result(spark, out, "pca_map").count() == numbers["active_users"]


def config_for_sample():
    from dataclasses import replace

    return replace(CONFIG, clusters=4, restarts=2, max_iter=20)
