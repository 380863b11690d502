"""The corpus pipeline: language ID, near-duplicate removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickwise.llm.common import read_table, written
from tickwise.llm.langid import keep_identified
from tickwise.llm.mixing import mix_documents
from tickwise.llm.sentencepiece_nbest import encode_documents
from tickwise.llm.simhash import deduplicate


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any letter, their lang filled in where it is missing; also where no language could be learned."""
    return keep_identified(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id."""
    return deduplicate(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words of the mix: a row per document and pass with the text taken in it."""
    return mix_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, with the best encodings' scores and the round trip's result."""
    return encode_documents(docs)


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: Hash votes, permutations and lattices have no SQL form: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
