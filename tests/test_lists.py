"""Lists in parts, and a user with very many recipients."""

from __future__ import annotations

import os
import subprocess
import sys

from pyspark.sql import functions as F

from cohortloom.operators.counting import class_counts, class_lists, list_parts, whole_lists
from cohortloom.sources.sample import CONFIG, SampleTables
from tests.helpers import plan_of

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_whole_lists_are_the_class_counts(spark, stages):
    t = SampleTables(spark, SF)
    expected = sorted(map(str, class_counts(t, CONFIG).collect()))
    for size in (1, 3, 10_000):
        lists = class_lists(t, CONFIG, stages, size=size)
        assert sorted(map(str, whole_lists(lists).collect())) == expected
        assert lists.parts.agg(F.max(F.size("items"))).first()[0] <= size


def test_parts_are_full_sorted_and_numbered(spark, stages, settings):
    # Ranges as small as these would be put together again.
    settings(spark__sql__adaptive__coalescePartitions__enabled="false")
    # A third of the rows are items of one key, the last key has a single one.
    rows = [("hot", f"i{i:05d}") for i in range(5_000)] + [(f"k{i % 50}", f"i{i:05d}") for i in range(10_000)]
    items = spark.createDataFrame([*rows, ("z", "one")], "k string, item string").repartition(7)
    parts = list_parts(items, ["k"], stages, 64)
    found = {}
    for r in sorted(parts.collect()):
        found.setdefault(r.k, []).append(r)
    assert {k: [i for r in rs for i in r["items"]] for k, rs in found.items()} == {
        k: sorted(i for q, i in [*rows, ("z", "one")] if q == k) for k in {q for q, _ in rows} | {"z"}
    }
    for rs in found.values():
        assert [r.part for r in rs] == list(range(len(rs)))
        assert all(len(r["items"]) == 64 for r in rs[:-1])
    # The ranges cut the hot key, too.
    assert stages.tables["ranged_items"].filter("k = 'hot'").select("dealt").distinct().count() > 1
    assert "collect_set" not in plan_of(parts)


def test_no_items_give_no_parts(spark, stages):
    none = spark.createDataFrame([], "k string, item string")
    assert list_parts(none, ["k"], stages, 4).collect() == []


SMALL_HEAP = """
import sys
from pyspark.sql import functions as F
from cohortloom.operators.counting import list_parts
from cohortloom.session import local_session
from cohortloom.sources.stages import StageArea
spark = local_session(2, 16, "600m", **{"spark.checkpoint.dir": sys.argv[1]})
hot = spark.range(1_000_000).selectExpr("1L AS user_id", "concat('recipient-', md5(string(id))) AS item")
rest = spark.range(500_000).selectExpr("id % 1000 + 2 AS user_id", "concat('recipient-', md5(string(id))) AS item")
with StageArea(spark) as area:
    parts = list_parts(hot.unionByName(rest), ["user_id"], area, 10_000)
    area.save(parts, "parts")
    sums = area.tables["parts"].groupBy((F.col("user_id") == 1).alias("hot")).agg(
        F.sum(F.size("items")).alias("items"), F.count("*").alias("parts"), F.max(F.size("items")).alias("longest"))
    print("FOUND", sorted(tuple(r) for r in sums.collect()))
spark.stop()
"""


def test_a_million_recipients_under_a_small_heap(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SMALL_HEAP, str(tmp_path)], cwd=ROOT, capture_output=True, text=True, timeout=240
    )
    assert "FOUND [(False, 500000, 1000, 500), (True, 1000000, 100, 10000)]" in done.stdout, done.stderr[-3000:]
