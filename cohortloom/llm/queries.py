"""One query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import (
    align,
    bpe,
    decontaminate,
    html_text,
    jaccard,
    language,
    line_dedup,
    maxscore,
    periodic,
    secrets,
    simhash,
    substring_dedup,
    toxicity,
)
from cohortloom.sources.stages import StageArea


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


def token_digests(docs: DataFrame, ids: bool = False) -> DataFrame:
    """Number of tokens of each document, and digests of its ids and of the decoded bytes."""
    vocab = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    outputs = ("ids_text", "decoded", *(("token_ids",) if ids else ()))
    return bpe.encode(docs, vocab, keep=("doc_id",), outputs=outputs).select(
        "doc_id",
        "n_tokens",
        F.sha2("ids_text", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(("token_ids",) if ids else ()),
    )


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(_table(spark, sf_dir, "pages"), keep=["page_id", "url"])
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# A fifth of the ids is held out of training; a row without an id is never learned from.
def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    return toxicity.fit(docs, labels.where(~held_out()))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity_model(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~held_out()))
    found = language.predict(docs, model, keep=["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.remove_repeats(docs, StageArea(spark))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


REPEAT_BYTES = 400


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = substring_dedup.remove_repeats(docs, REPEAT_BYTES, StageArea(spark), keep=["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(_table(spark, sf_dir, "documents"), keep=["doc_id"])

    def named(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(k) for k in secrets.KINDS]
    return found.select("doc_id", *counts, F.sha2(named("base"), 256).alias("base_sha256"), named("spans").alias("spans"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each benchmark item that a document holds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.with_leaks(docs, _table(spark, sf_dir, "benchmark"))
    rows = found.select("doc_id", F.explode("leaks").alias("leak"))
    return rows.select("doc_id", F.col("leak.item").alias("item_id"), "leak.distance", F.col("leak.end").alias("passage_end"))


SIMHASH_WORDS, SIMHASH_BITS = 4, 4


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = simhash.near_duplicates(docs, SIMHASH_WORDS, SIMHASH_BITS, StageArea(spark))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op10_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    rows = vectors.select("vec_id", maxscore.scaled(F.col("embedding"), 256).alias("ints"))
    return maxscore.top_k(rows, F.col("vec_id") % 50 == 0, 5)


def repeated_words(text: str, key: str):
    """The text with a tenth of the rows, by a hash of the key, made periodic from some word on."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    spec = F.crc32(F.col(key).cast("string"))
    rest = F.floor(spec / 10)

    def planted(words):
        n = F.size(words).cast("long")
        a = rest % n
        p = 1 + F.floor((n - a) / (3 + rest % 8))
        places = F.sequence(F.lit(0).cast("long"), n - 1)
        at = F.transform(places, lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(at, lambda i: F.get(words, i)), " ")).otherwise("")

    made = F.element_at(F.transform(F.array(words), planted), 1)
    return F.when((spec % 10 == 0) & F.col(text).isNotNull(), made).otherwise(F.col(text))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", repeated_words("text", "doc_id").alias("text"))
    found = periodic.with_runs(docs, keep=["doc_id"])
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("early"), (-r["period"]).alias("small"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", longest)
    start, length, period = -F.col("best.early"), F.col("best.length"), -F.col("best.small")
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    files = align.Tokenizers.read(path("byte_bpe_50k.json"), path("piece_bpe_32k.model"), public_tokenizers.PATTERN)
    linked = align.align(_table(spark, sf_dir, "documents"), files, keep=["doc_id"])
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    found = align.scored(linked.withColumn("groups_sha256", digest).drop("groups"), StageArea(spark))
    return found.select("doc_id", *align.COUNTS, "n_best", "count_sum", "groups_sha256")


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = jaccard.near_duplicates(docs, 5, 80, StageArea(spark))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_html_text": op2_html_text,
    "op3_toxicity": op3_toxicity,
    "op4_language": op4_language,
    "op5_line_dedup": op5_line_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_secrets": op7_secrets,
    "op8_decontaminate": op8_decontaminate,
    "op9_simhash": op9_simhash,
    "op10_maxscore": op10_maxscore,
    "op11_periodic": op11_periodic,
    "op12_alignment": op12_alignment,
    "op13_jaccard": op13_jaccard,
}
# The others train, tokenize, hash as no SQL function does, or recurse within a text.
ORACLE: dict[str, str] = {
    "op10_maxscore": """
WITH v AS (
 SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS ints FROM embeddings
 WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)
SELECT query_id, rank, vec_id, score FROM (
 SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
 FROM (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.ints, c.ints) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0))
WHERE rank <= 5""",
    "op13_jaccard": """
WITH RECURSIVE words AS (
 SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS w FROM documents),
grams AS (
 SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
   ELSE [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
linked AS (
 SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM grams a JOIN grams b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY ALL) JOIN sizes x ON x.doc_id = u JOIN sizes y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
reached AS (
 SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.v FROM reached r JOIN linked l ON l.u = r.other)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id""",
}
