"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept and returns the columns of documents, the last one the packed pieces.
Between stages the rows are Parquet files in the folder that spark.checkpoint.dir names, which every executor shares.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from yore.llm import decontaminate, jaccard, langid, packing, pii, simhash
from yore.llm.common import table
from yore.sources.shared import folder


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones have. What has no letters, null texts among them, and what the languages' trigrams do not explain goes."""
    return langid.known_language(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (SimHash fingerprints that differ in two bits or fewer, as in op4_simhash, or 0.8 or more of their five-word shingles in common): the one with the smallest id. Null and empty texts are copies of each other, a null id is the last choice, of repeated rows one stays."""
    return jaccard.one_of_each(docs, tau=simhash.TAU)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark; null and empty texts have none."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; null texts stay null, repeated rows are repeated."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens; a null or empty text is its end alone, repeated rows are packed each."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language ID", language), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", benchmarks), ("PII", private), ("packing", pack)]

#: The language model and the tokenizer are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is written and read again. An empty table gives no pieces; columns beyond those of documents stay up to the last stage, whatever their names."""
    shared = folder(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        at = f"{shared}/stages-{uuid.uuid4().hex}/{i}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
    return docs
