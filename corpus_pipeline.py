"""From raw documents to tokens: five stages, each over all that the one before kept.

``run`` writes what a stage returns as Parquet into the shared folder and reads it again as the next
one's documents. All stages but the last return the columns of ``documents``.

Cases: a null or empty text is kept by every filter (it is not toxic, has no repeats and no leaks) but
counts as a copy of any other such text; a row without ``doc_id`` cannot be named as a copy and is
kept; of rows that repeat a ``doc_id`` and its text one stays, and different texts under one ``doc_id`` are
different documents; further columns are carried along; empty tables give empty results. Benchmark items
of fewer than ``LEAST_ITEM`` characters, a few common words, remove no document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortloom.llm import decontaminate, line_dedup, simhash, toxicity
from cohortloom.llm.queries import SIMHASH_BITS, SIMHASH_WORDS, token_digests, toxicity_model
from cohortloom.sources.stages import StageArea


LEAST_ITEM = 20


def fresh(name: str, docs: DataFrame) -> str:
    """A name that no column has."""
    while name in docs.columns:
        name = f"_{name}"
    return name


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = toxicity_model(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = fresh("score", docs)
    return toxicity.score(docs, model, out=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier one has."""
    kept = line_dedup.remove_repeats(docs, StageArea(spark), counts=None)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, of these that of the smallest digest.

    Rows are named by id and text, so that different texts under one id are told apart.
    """
    id_, text, nth = (fresh(name, docs) for name in ("id", "digest", "nth"))
    named = docs.where("doc_id IS NOT NULL").withColumns({id_: F.col("doc_id"), text: F.coalesce(F.md5("text"), F.lit(""))})
    rows = named.select(F.struct(F.col(id_).alias("id"), F.col(text).alias("digest")).alias("name"), "text")
    area = StageArea(spark)
    found = simhash.near_duplicates(rows, SIMHASH_WORDS, SIMHASH_BITS, area, key="name")
    first = area.save(found.where("name = component").groupBy("name").agg(F.count("*").alias("n")), "first")
    leaders = first.select(F.col("name.id").alias(id_), F.col("name.digest").alias(text))
    kept = named.join(leaders.hint("merge"), [id_, text], "left_semi")
    if not first.where("n > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy(id_, text).orderBy(F.lit(0)))
        kept = kept.withColumn(nth, place).where(F.col(nth) == 1)
    return kept.select(*docs.columns).unionAll(docs.where("doc_id IS NULL"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    leaks = fresh("leaks", docs)
    found = decontaminate.with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), out=leaks, least=LEAST_ITEM)
    return found.where(F.size(leaks) == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of the bytes that they decode to."""
    return token_digests(docs, ids=True)


STAGES = [
    ("toxicity", keep_civil),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("byte_bpe", tokens),
]

# Trained classifiers and hash-chosen boundaries have no SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    area = StageArea(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = area.save(stage(spark, docs, sf_dir), name)
    return docs
