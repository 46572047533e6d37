"""A corpus through five stages, each of which is an operator of skysonde.llm."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from skysonde.llm import byte_bpe, contamination, disclosure, minhash, quality_fm
from skysonde.llm.common import Scratch

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, learnt from the labels, doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_fm.without_low_quality(docs, quality_fm.trained(docs, labels))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.without_near_duplicates(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return contamination.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and terms that disclose it taken out."""
    return disclosure.sanitised(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and digests of them and of the text decoded from them."""
    return byte_bpe.encoded(docs, byte_bpe.read_ranks(spark, VOCABULARY), PATTERN)


STAGES = [
    ("quality classifier", good_documents),
    ("near-duplicates", distinct_documents),
    ("benchmark decontamination", unseen_documents),
    ("personal data", private_documents),
    ("byte-level BPE", token_ids),
]

#: A trained classifier has no SQL form; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as scratch:
        for name, stage in STAGES[:-1]:
            docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            scratch.drop_before(1)
        return scratch.result(STAGES[-1][1](spark, docs, sf_dir), "tokens")
