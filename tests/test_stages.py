"""Life of stage tables, and reports that break and go on."""

from __future__ import annotations

import os

import pytest

from catalogue.queries import QUERIES
from cohortloom.plans import report
from cohortloom.sources.sample import CONFIG, SampleTables
from cohortloom.sources.stages import StageArea, is_done, latest_run, read_result, stage_run, sweep

SF = "/root/testdata/sf0.001"


def folders(path) -> set[str]:
    return {n for n in os.listdir(path) if n.startswith("stages-")}


@pytest.mark.parametrize("name", ["class_scores", "cohort_table_wide", "yeo_johnson_features", "headline_figures"])
def test_no_table_is_left_when_the_result_was_written(spark, tmp_path, name):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = folders(shared)
    with stage_run():
        QUERIES[name](spark, SF).write.parquet(str(tmp_path / "result"))
        assert folders(shared) > before
    assert folders(shared) == before
    assert spark.read.parquet(str(tmp_path / "result")).count() > 0


def test_a_run_that_breaks_leaves_no_table(spark):
    shared = spark.conf.get("spark.checkpoint.dir")
    before = folders(shared)
    with pytest.raises(ZeroDivisionError), stage_run():
        StageArea(spark).save(spark.range(3), "t")
        1 / 0
    assert folders(shared) == before


def test_nested_runs_delete_their_own_tables(spark):
    with stage_run():
        outer = StageArea(spark)
        kept = outer.save(spark.range(3), "t")
        with stage_run():
            inner = StageArea(spark)
            inner.save(spark.range(3), "t")
        assert not os.path.exists(inner.root)
        assert kept.count() == 3
    assert not os.path.exists(outer.root)


def test_sweep_deletes_what_a_lost_process_left(spark, tmp_path):
    with stage_run():
        old, new = (StageArea(spark, str(tmp_path)) for _ in range(2))
        for area in (old, new):
            area.save(spark.range(3), "t")
        day_ago = os.path.getmtime(old.root) - 86_400
        for path in (old.root, *[os.path.join(old.root, n) for n in os.listdir(old.root)]):
            os.utime(path, (day_ago, day_ago))
        assert sweep(spark, 12, str(tmp_path)) == [os.path.basename(old.root)]
        assert folders(tmp_path) == {os.path.basename(new.root)}
    assert sweep(spark, 0, str(tmp_path / "none")) == []


def test_a_kept_area_reads_what_is_whole(spark, tmp_path):
    folder = str(tmp_path / "kept")
    first = StageArea(spark, folder=folder)
    assert [first.save(spark.range(n), "t").count() for n in (3, 4)] == [3, 4]
    os.remove(os.path.join(folder, "t-1", "_done"))
    again = StageArea(spark, folder=folder)
    # The first is read as it is, the second, not marked as whole, is written anew.
    assert [again.save(spark.range(n), "t").count() for n in (30, 40)] == [3, 40]
    again.close()
    assert not os.path.exists(folder)


class Broken(Exception):
    pass


def few_results(t, cfg, stages, with_elbow=False):
    """Three results of the report, of which two read one stage table."""
    users = report.stage_active(t, cfg, stages)
    return {
        "class_pies": report.stats.class_pies(users),
        "funnel": report.stats.funnel(stages.tables["all_users"], cfg),
        "class_histogram": report.stats.histogram(users, cap=cfg.histogram_cap),
    }


def test_a_broken_report_is_not_read_and_goes_on(spark, tmp_path, monkeypatch):
    out, t = str(tmp_path), SampleTables(spark, SF)
    monkeypatch.setattr(report, "build_results", few_results)
    report.write_report(t, CONFIG, out, run_id="old")
    old = read_result(spark, out, "funnel").collect()

    write, todo = report._write_once, []

    def breaks(df, path):
        if path.endswith("/funnel"):
            raise Broken
        write(df, path)

    monkeypatch.setattr(report, "_write_once", breaks)
    with pytest.raises(Broken):
        report.write_report(t, CONFIG, out, run_id="new")
    # Readers still get the whole old report.
    assert latest_run(spark, out) == "old"
    assert read_result(spark, out, "funnel").collect() == old
    with pytest.raises(ValueError, match="no complete run new"):
        read_result(spark, out, "class_pies", "new")
    pies = f"{out}/run-new/class_pies"
    tables = f"{out}/run-new/_stages"
    assert is_done(spark, pies) and not is_done(spark, f"{out}/run-new/funnel")
    files = {p: os.path.getmtime(os.path.join(p, f)) for p in (pies, *[f"{tables}/{n}" for n in os.listdir(tables)]) for f in ["_done"]}
    assert len(files) >= 3

    def watched(df, path):
        todo.append((os.path.basename(path), is_done(spark, path)))
        now = {p: os.path.getmtime(os.path.join(p, "_done")) for p in files}
        assert now == files
        write(df, path)

    monkeypatch.setattr(report, "_write_once", watched)
    report.write_report(t, CONFIG, out, run_id="new")
    assert todo == [("class_pies", True), ("funnel", False), ("class_histogram", False), ("manifest", False)]
    assert latest_run(spark, out) == "new"
    assert read_result(spark, out, "funnel").collect() == old
    assert not os.path.exists(tables)
    # A complete run is left as it is.
    todo.clear()
    assert report.write_report(t, CONFIG, out, run_id="new") == "new" and not todo
