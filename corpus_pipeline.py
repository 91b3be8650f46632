"""From raw documents to token ids: the training-data pipeline.

Each stage works on all rows that the stage before it kept. ``run`` writes each stage's rows as Parquet to
the shared work folder and reads them again, so a lost executor costs one stage at most.

All stages read texts of any length whole, take rows of an empty table for none, and all but the last keep further
columns, whatever their names. What they make of nulls and repeated rows stands with each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.llm import bpe, decontaminate, minhash, pii, quality_rules
from paperloom.llm.common import stored, work_dir
from paperloom.llm.registry import BYTE_BPE


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and their host's verdict keep.

    Null and empty texts fail; documents without source are a host of their own; repeated rows are judged alike, and each counts.
    """
    return quality_rules.keep_good(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    It is the one with the lowest id, null last, then the lowest hash of the text; one of repeated rows. Texts that are null
    or have no word are like no other, and all stay.
    """
    return minhash.keep_one(docs, shingle=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark. Null and empty texts hold none and are none; repeated rows go or stay together."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def no_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked and n_chars set to the new length. A null text stays null; repeated rows are masked alike."""
    return pii.mask_pii(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and n_tokens of each document. A null or empty text has no ids; each repeated row has its own."""
    return bpe.bpe_encode(docs, BYTE_BPE)


STAGES = [
    ("quality_rules", good_quality),
    ("near_dedup", one_of_each),
    ("decontaminate", no_benchmark),
    ("pii", no_personal_data),
    ("bpe", token_ids),
]

#: SQL can express neither the components nor the byte-pair merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for sf_dir's documents."""
    path = work_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"{path}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
