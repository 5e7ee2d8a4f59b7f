"""A corpus pipeline over ``documents``: each stage's rows are written as Parquet and read again as the next one's.

Quality rejects go; one document of each near-duplicate group stays; benchmark passages are cut out; secrets are masked;
what is left is encoded. Null texts are kept as they are by every stage but the last, where they have no ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import byte_bpe, decontaminate, quality, secret_scan, simhash
from quern.llm.common import dropped, shared_folder, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the classifier, trained from ``labels``, rejects."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each component of near-duplicates."""
    return simhash.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut out the spans that ``benchmark`` items share; a document with no word left goes."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask secrets."""
    return secret_scan.redacted(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids."""
    import public_tokenizers

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("simhash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL can express neither the classifier nor the merges; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{n}")
        docs = spark.read.parquet(f"{folder}/{n}")
        if n:  # what the stage has read is done with
            dropped(spark, f"{folder}/{n - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
