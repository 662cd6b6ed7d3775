"""A corpus pipeline: quality, exact and near duplicates, mixing, tokens.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written and read again as the next one's docs.
All but the last give the columns of documents; columns beyond these pass through, whatever their names.

Rows are judged one by one, also those that repeat an id or have none. An empty table stays empty at every stage. Null and empty texts
are scored as an empty text, are copies of one another, are near duplicates of nothing, and have no words, so the mix never takes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import exact_dedup, minhash_dedup, mixing, quality, sentencepiece_codec
from millrace.llm.common import staged
from millrace.llm.queries import MODEL


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject; it learns from labels of these documents. Without a trusted positive all stay."""
    net = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, net)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest original, then the smallest id (null last)."""
    return exact_dedup.drop_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id (null last): five-word shingles, similarity 0.8 or more."""
    return minhash_dedup.drop_near_duplicates(docs, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those of a null source are a source of their own."""
    return mixing.mixed_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their whole texts, none for an empty one."""
    return sentencepiece_codec.encode(docs, MODEL)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: Training and signatures aren't expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
