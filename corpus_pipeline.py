"""The corpus pipeline: language ID, toxicity, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Language ID rejects texts in which no
language is found; toxicity rejects scores of 0.5 or more; the join keeps the
smallest doc_id of each component; decontamination removes documents that hold
a benchmark window.

Defined cases: rows are decided one by one, so repeated rows share their fate
but in the near-copies stage, of which one row a component stays, whatever its
id; null, empty and letterless texts go at language ID, and would stay in the
next three stages, as they are neither toxic nor copies nor contaminated; null
ids are kept and never learned from; texts of any length are read whole; an
empty table gives an empty table; other columns, of whatever names, are kept up
to packing, which has columns of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import blocks, decontaminate, jaccard, language, packing, toxicity


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs, language.train(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), "word", end_id=1)


STAGES = [
    ("language", identify_language),
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL expresses none of the model, similarity and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = blocks.stored(stage(spark, docs, sf_dir), f"stage {name}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {}
