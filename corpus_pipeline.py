"""The training-data pipeline over `documents`: language ID, near-duplicates, benchmark decontamination, packing.

Nulls: a null or empty text has no letters, so its document goes in the first stage; a null id is neither learned from nor linked to others.
Repeated rows are copies of each other; rows that repeat an id stay or go together with it. Texts are taken whole, whatever their length. An empty table
gives no rows. Other columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.llm.common import drop_durable, durable, spread, table
from pagewright.llm.decontamination import drop_contaminated
from pagewright.llm.language_id import keep_identified
from pagewright.llm.minhash import drop_near_duplicates
from pagewright.llm.packing import pack, pieces
from pagewright.llm.queries import word_bpe_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labels teach; those without letters, and longer ones in anything else, go."""
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each component over five-word shingles at Jaccard 0.8."""
    return drop_near_duplicates(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no ten words in a row, and no whole shorter item, with the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in windows of 2048 tokens."""
    cut = pieces(docs, word_bpe_path())
    slim = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(slim).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_languages),
    ("near_dedup", drop_copies),
    ("decontamination", decontaminate),
    ("packing", pack_windows),
]

#: Neither the naive Bayes model nor the tokenizer is expressible in SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table; what one returns is on shared storage before the next reads it, and goes when that is done."""
    docs, read = spread(table(spark, sf_dir, "documents")), []
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        for used in read:
            drop_durable(used)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
