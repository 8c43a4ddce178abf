"""The training-data pipeline over ``documents``: quality, toxicity, near duplicates, packing.

Each stage takes what the one before kept and decides on all of it; all but the last return the columns
of ``documents``. Models are fitted on the labelled rows of the stage's own input, outside the held-out
quarter.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import ngram_join, packing, quality, toxicity
from larkspur.llm.shared import fresh, shared_dir

#: Rows of all kinds are decided on: a null or empty text is scored as one without words, repeated rows alike; other columns pass through.
QUALITY_LEAST, TOXIC_LEAST, SIMILARITY = 0.7, 0.3, 0.8


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    labels, name = spark.read.parquet(f"{sf_dir}/labels.parquet"), fresh(docs.columns, "quality_score")
    scored = quality.score(docs, quality.fit(docs, labels), score_col=name)
    return scored.filter(F.col(name) >= QUALITY_LEAST).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    labels, name = spark.read.parquet(f"{sf_dir}/labels.parquet"), fresh(docs.columns, "toxicity_score")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), score_col=name)
    return scored.filter(F.col(name) < TOXIC_LEAST).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-equal texts."""
    return ngram_join.drop_near_duplicates(docs, threshold=SIMILARITY)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in their sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("packing", pack)]

#: Learned models and similarity joins are not expressible in SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each result but the last is written as Parquet to the shared folder and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
