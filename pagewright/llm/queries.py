"""The registered queries of the training-data operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_text, licenses
from .chat import perspectives
from .common import spread, table
from .decontamination import digest, find_contamination
from .language_id import identify
from .minhash import near_duplicates
from .oracles import ORACLE_SQL
from .packing import pack, pieces
from .sharding import shard
from .url_filter import judge


def op1_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each of its participants."""
    return perspectives(table(spark, sf_dir, "conversations"))


def op2_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.digest(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, law `rows`."""
    return shard(table(spark, sf_dir, "documents"), shards=40).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op5_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 2-word shingle sets have a Jaccard similarity of 0.8 and more."""
    return near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), k=2, percent=80)


def op6_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of them is never learned from."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return digest(find_contamination(docs, table(spark, sf_dir, "benchmark")))


def word_bpe_path() -> str:
    """The public tokenizer file that op9 and the pipeline use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op8_url_language_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on the URL of every page."""
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    cut = pieces(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), word_bpe_path())
    slim = cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return pack(slim).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses named in every document."""
    return licenses.digest(licenses.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))))


QUERIES = {
    "op1_perspective_rotation": op1_perspective_rotation,
    "op2_bottom_k_fingerprints": op2_bottom_k_fingerprints,
    "op3_feistel_shards": op3_feistel_shards,
    "op4_main_text": op4_main_text,
    "op5_circulant_minhash": op5_circulant_minhash,
    "op6_naive_bayes_language": op6_naive_bayes_language,
    "op7_winnowing": op7_winnowing,
    "op8_url_language_models": op8_url_language_models,
    "op9_nnls_packing": op9_nnls_packing,
    "op10_license_scan": op10_license_scan,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
