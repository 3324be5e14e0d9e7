"""A corpus pipeline of four stages over `documents`: language, near duplicates, mixture, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet before the next one
reads it. Ids may repeat or be null: the stages that join number the rows of a staged copy. Rows that repeat in all columns
are documents of their own, of which near duplicates keep one where they have words. Empty tables pass through.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.llm import dropout, langid, mixing, ngram_join
from lattice.llm.common import lookup, new_path, scratch, staged
from lattice.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A staged copy of the documents, each row with a number of its own."""
    return staged(spark, docs.select(*COLUMNS).withColumn("key", F.monotonically_increasing_id()), "pipeline-rows")


def _content() -> Column:
    """Names the same document on every run, whatever its row's number."""
    return F.concat_ws(":", *[F.xxhash64(F.lit(i), *COLUMNS).cast("string") for i in (1, 2)])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text (with source and declared language) some language explains; the others go."""
    return langid.accepted(spark, docs.select(*COLUMNS), langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays: the one with the least id. Documents without words stay."""
    docs = _numbered(spark, docs)
    groups = ngram_join.near_components(spark, docs.select(F.col("key").alias("doc_id"), "text"), size=5, threshold=Fraction(4, 5))
    groups = groups.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group"))
    ids = docs.select(F.col("key").alias("of"), F.col("doc_id").alias("id"), _content().alias("content"))
    groups = staged(spark, groups.join(ids, F.col("key") == F.col("of")).drop("of"), "pipeline-groups")
    order = F.struct(F.col("id").isNull(), "id", "content", "key")
    first = groups.groupBy("group").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("members"))
    first = first.where("members > 1").select("group", F.col("first.key").alias("stays"), "members")
    goes = lookup(groups, first, "group", "members").where("key <> stays").select(F.col("key").alias("goes"))
    return docs.join(staged(spark, goes, "pipeline-goes"), F.col("key") == F.col("goes"), "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes: a document once for each time it is taken whole, and the words that are left where a budget cuts it."""
    docs = _numbered(spark, docs)
    taken = mixing.mix(spark, docs.select(F.col("key").alias("doc_id"), "text", "source", _content().alias("content")), told_by="content")
    rows = docs.join(taken.where("taken > 0").select(F.col("doc_id").alias("of"), "size", "taken"), F.col("key") == F.col("of"))
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    none = F.lit(None).cast("int")
    rows = rows.withColumn("limit", F.explode(F.concat(F.array_repeat(none, whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))))
    words = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")  # each word with the white space before it
    text = F.when(F.col("limit").isNull(), F.col("text")).otherwise(F.array_join(F.slice(words, F.lit(1), F.coalesce("limit", F.lit(0))), ""))
    n_chars = F.when(F.col("limit").isNull(), F.col("n_chars")).otherwise(F.char_length(text).cast("long"))
    return rows.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens of every row, by merge-dropout with a fixed seed."""
    encoded = dropout.encode(spark, docs.select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), dropout=0.1, seed=42)
    return encoded.withColumn("n_tokens", F.size("ids"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mixture", mixture), ("tokens", tokens)]

#: SQL cannot express the first and the last stage; tests/llm holds each stage against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


QUERIES = {"pipeline": run}

ORACLES = {"pipeline": ORACLE_SQL}
