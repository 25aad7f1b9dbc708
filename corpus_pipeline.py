"""The training-data pipeline over ``documents``: each stage reads what its predecessor wrote as Parquet."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pricetrail.llm.bpe import encode
from pricetrail.llm.decontamination import decontaminate
from pricetrail.llm.quality import keep_good
from pricetrail.llm.rows import prepare, table
from pricetrail.llm.simhash import first_of_group
from pricetrail.llm.toxicity import keep_civil
from pricetrail.session import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones of them, calls toxic go."""
    return keep_civil(docs, table(prepare(spark), sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the likelihood ratio go."""
    return keep_good(docs, table(prepare(spark), sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest doc_id."""
    prepare(spark)
    return first_of_group(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; in others, spans that occur in a test item are cut out."""
    return decontaminate(docs, table(prepare(spark), sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and decoded text of every document."""
    prepare(spark)
    return encode(docs)


STAGES = [
    ("toxicity", toxicity),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("bpe", bpe_encoding),
]

#: Trained models and hashes decide, which SQL cannot express; the tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Between them, rows are written to the shared folder and read again."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
