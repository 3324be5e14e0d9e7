"""Mixing sources to target weights.

Sources, in code-point order with null last, have weights (a cycle of given numbers) and share a part of all
words by weight; none gets more than `epochs` times its own words, and what is over is shared again. Each
document has a hash-random key. Within a source, documents in the order of their keys have prefix sums of their
sizes; a source's budget takes every document as often as it fits whole and then, in that order, cuts at the
exact word. Prefix sums are distributed: ranges of keys are summed first, a source's ranges (4,096 at most) give
offsets, and only the documents of one range of one source are summed in order together.

A null text has size 0 and is never taken; a null source is a source of its own. Rows that repeat an id have
the same key and are ordered by size. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.llm.common import WORD, columns_only, lookup, ranked, staged, text_of

_RANGE = 3  # hex digits of the key that name its range


def targets(spark: SparkSession, sizes: DataFrame, weights: Sequence[float], share: float, epochs: float) -> DataFrame:
    """source key, weight, source_size, target, n (rows): one row a source.

    The common level (words for each unit of weight) only rises, so each round is one aggregate over sources
    until no further source is at its cap; only sums come to the driver.
    """
    sources = staged(spark, sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), "mix-sources")
    sources = ranked(spark, sources, F.col("source").asc_nulls_last(), name="at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.lit(float(epochs)) * F.col("source_size"))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, open_weight = sources.agg(F.count_if(full), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (share * total - caps) / open_weight
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return sources.select("source", "weight", "source_size", target.alias("target"), "n")


def mix(spark: SparkSession, df: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 42, told_by: str = "doc_id") -> DataFrame:
    """doc_id, size, source_size, target (of its source), taken (words, repeats counted).

    The hash-random key is a hash of the seed and the column `told_by`.
    """
    rows = columns_only(df, "text", "source", *dict.fromkeys(["doc_id", told_by]))
    size = F.regexp_count(text_of("text"), F.lit(WORD)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(f"`{told_by}`").cast("string")))
    sizes = staged(spark, rows.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), key.alias("key")), "mix-sizes")
    named = F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("named")
    goal = targets(spark, sizes, weights, share, epochs).select(named, "source_size", "target", "n")
    rows = lookup(sizes.select("doc_id", named, "size", "key"), staged(spark, goal, "mix-targets"), "named", "n")
    rows = staged(spark, rows.withColumn("range", F.concat(F.substring("key", 1, _RANGE), "named")), "mix-rows")
    ranges = rows.groupBy("range", "named").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("named").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("range", before.alias("before"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("range").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(offsets, "range").withColumn("at", F.col("before") + inside)
    budget = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("at")))
    return placed.select("doc_id", "size", "source_size", "target", (whole * F.col("size") + part).cast("long").alias("taken"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42:' || doc_id) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS weight
  FROM d GROUP BY source
), c AS (SELECT *, 2.0::DOUBLE * source_size AS cap FROM s
), levels(round, level, capped) AS (
  SELECT 0, 0.0::DOUBLE, -1::BIGINT
  UNION ALL
  SELECT round + 1, coalesce((1.5::DOUBLE * t.total - t.caps) / t.open_weight, level), t.n
  FROM levels, LATERAL (
    SELECT count(*) FILTER (cap <= level * weight) AS n, coalesce(sum(cap) FILTER (cap <= level * weight), 0.0) AS caps,
           nullif(coalesce(sum(weight) FILTER (cap > level * weight), 0.0), 0.0) AS open_weight, sum(source_size)::DOUBLE AS total
    FROM c) t
  WHERE t.n <> capped AND t.open_weight IS NOT NULL AND round < 1000
), l AS (SELECT level FROM levels ORDER BY round DESC LIMIT 1
), g AS (SELECT source, source_size, least(cap, (SELECT level FROM l) * weight) AS target FROM c
), p AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, floor(g.target)::BIGINT AS budget,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
), w AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, budget - whole * source_size - before)))::BIGINT AS taken
FROM w
"""
