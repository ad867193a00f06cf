"""The corpus pipeline: from raw documents to packed training sequences.

Each stage works on all rows that the one before it kept. The first four return the columns of
documents: toxic documents go, of equal texts the row with the largest id stays, of each group of near
copies the row with the smallest id stays, and secrets are replaced in the texts. The last returns the
pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm.common import read_table, shared_path
from veilspark.llm.exact_dedup import drop_copies
from veilspark.llm.packing import best_fit_pack
from veilspark.llm.queries import tokenizer
from veilspark.llm.secrets import redact_secrets
from veilspark.llm.simhash import drop_near_copies
from veilspark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_pack(docs, tokenizer())


STAGES = [("toxicity", toxicity), ("exact dedup", exact_dedup), ("SimHash near-dedup", simhash), ("secret scan", secret_scan), ("best-fit packing", packing)]

#: The classifier and the packing are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = shared_path(spark, f"stage-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
