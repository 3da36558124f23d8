"""A corpus from raw documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; it works on all that its
predecessor kept. ``run`` writes every stage's result into the shared folder and rereads
it, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm import decontaminate, lexicon_codec, line_dedup, shingle_join, toxicity
from careflow.llm.catalog import BYTE_BPE, tokenizer
from careflow.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents hold stay in one; n_chars follows."""
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, the one with the smallest doc_id."""
    return shingle_join.representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a test item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ids (little-endian unsigned 32-bit integers) and n_tokens."""
    return lexicon_codec.encode(docs, tokenizer(BYTE_BPE))


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_stage),
    ("n-gram jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-pair encoding", token_stage),
]
#: Training, hashes and byte-pair merges are beyond SQL; tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
