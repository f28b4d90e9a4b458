"""Top and random rows per group.

``row_number() <= n`` is cut to n rows per group inside each task before any shuffle, so a group
with most of the rows costs no more than a small one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortloom.functions.columns import profile_link


def top_per_group(
    df: DataFrame, group: str, order: Sequence[Column | str], rows: int, position: str = "position"
) -> DataFrame:
    window = W.partitionBy(group).orderBy(*order)
    return df.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= rows)


def random_order(seed: int, key: str = "user_id") -> list[Column]:
    """A reproducible random order: the digest of seed and key, then the key."""
    return [F.md5(F.concat(F.lit(f"{seed}-"), F.col(key).cast("string"))), F.col(key)]


def sample_per_group(
    df: DataFrame, group: str, rows: int, seed: int, key: str = "user_id"
) -> DataFrame:
    return top_per_group(df, group, random_order(seed, key), rows)


def group_links(sample: DataFrame, group: str, base_url: str) -> DataFrame:
    """Per group, links to the profiles of its sampled users, in sample order."""
    link = F.struct("position", profile_link(base_url, F.col("user_slug")).alias("link"))
    links = F.transform(F.array_sort(F.collect_list(link)), lambda item: item["link"])
    return sample.groupBy(group).agg(F.array_join(links, ", ").alias("links"))
