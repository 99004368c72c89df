"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import blocks, compaction, decontaminate, hard_negatives, jaccard, language, language_model, near_vectors, packing, periodic, quality, token_counts, token_files, toxicity
from loomgraph.llm.blocks import remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out(rows: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    return rows.withColumn("held_out", F.coalesce(remainder("doc_id", folds) == fold, F.lit(False)))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return _held_out(toxicity.score(docs, model)).select("doc_id", "held_out", "score", "predicted", F.size("spans").alias("n_spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.coalesce(F.array_max(F.col("matches.n_words")), F.lit(0).cast("long")).alias("longest"),
    )


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = blocks.shared_path(spark, "token-files")
    files = token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), "byte", end_id=0)
    return token_files.read_digests(spark, files)


def op4_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compaction.compacted(_table(spark, sf_dir, "documents"), blocks.shared_path(spark, "shards"))
    return rows.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return _held_out(language.identify(docs, language.train(docs))).select("doc_id", "held_out", "lang_pred", "score")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_components(_table(spark, sf_dir, "embeddings"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.interpolated_scores(_table(spark, sf_dir, "documents"))


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=turned)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(periodic.looped_texts(_table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    # the longest run; of equal ones the first, then the shortest period
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), (-best["less"]).alias("length"), best["period"].alias("period"),
        F.floor(-best["less"] * 1000 / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    return _held_out(quality.score(docs, model), 3, 1).select("doc_id", "held_out", "score", "predicted", "n_passages", "attention")


HARD_NEGATIVES_SQL = """
WITH v AS MATERIALIZED (
    SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
    SELECT p.*, s.other_id AS negative_id, s.score AS negative_score,
        CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank
    FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_decontamination": op2_decontamination,
        "op3_token_binary": op3_token_binary,
        "op4_compaction": op4_compaction,
        "op5_language": op5_language,
        "op6_near_vectors": op6_near_vectors,
        "op7_token_counts": op7_token_counts,
        "op8_language_model": op8_language_model,
        "op9_jaccard": op9_jaccard,
        "op10_packing": op10_packing,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_quality": op13_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        # the compacted shards hold each row once, unchanged
        "op4_compaction": "SELECT doc_id, lang, source, n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5 FROM documents",
        "op11_hard_negatives": HARD_NEGATIVES_SQL,
    }
