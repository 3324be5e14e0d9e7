"""The registered queries of the operators, with production parameters and whole tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import dropout, extraction, langid, licenses, merkle, mixing, ngram_join, tokencount, topk, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edit_fingerprints(spark, _table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, _table(spark, sf_dir, "pages"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropout.round_trip(spark, _table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), dropout=0.1, seed=42)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document (doc_id) and every page (page_id)."""
    docs, pages = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages")
    rows = langid.document_rows(docs, F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("long").alias("page_id"))
    return langid.identify(spark, rows.unionByName(langid.page_rows(pages)), langid.fit(docs))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.prefix_counts(spark, _table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), store=False)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_components(spark, _table(spark, sf_dir, "documents"), size=5, threshold=Fraction(4, 5))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(spark, _table(spark, sf_dir, "pages"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(_table(spark, sf_dir, "embeddings"))
    return topk.top_k(spark, vectors, F.col("vec_id") % 100 == 0, 10)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark, _table(spark, sf_dir, "documents"), threshold=0.8)


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_warc, op3_sentencepiece, op4_language_id, op5_token_counts, op6_ngram_join, op7_mixing, op8_main_text, op9_top_k, op10_licenses)}

ORACLES = {"op2_warc": warc.ORACLE, "op6_ngram_join": ngram_join.ORACLE, "op7_mixing": mixing.ORACLE, "op9_top_k": topk.ORACLE}
