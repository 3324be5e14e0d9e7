"""Exact top-k inner products by distributed histogram selection.

Queries are taken in blocks of bounded bytes; a block's vectors are broadcast and every candidate is scored against
them where it lies, a tile of queries and candidates at a time. A query's k-th best score is found by histograms: each pass
counts its scores in equal bins of the range still open, counts are added over all partitions, and the bin that holds the
k-th becomes the next range, until it is a single score. If more candidates have that score than are wanted, the same refinement
over their ids finds the k-th of them. A last pass keeps what is within both bounds: exactly k rows a query (all rows, if
there are fewer), however many scores tie. A tile sends only bins that can hold one of its own k best.

Vectors that are null or hold null, NaN or infinite components take no part, and neither do rows without an id.
A vector whose length is not the query's is no candidate of it. Rows that repeat an id are rows of their own; a
query is never its own candidate, and neither are rows with its id. Ids may be any 64-bit integers. Components and scores are exact
64-bit integers; where finite components are so large that one could pass 64 bits, the job fails with a message that says so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattice.llm.common import columns_only, new_path, rows_out, ship, staged

BLOCK_BYTES = 16 << 20  # query vectors that are broadcast at once
_BINS = 1 << 12
_ROWS = 1 << 14  # candidates of a tile
_TILE = 256  # queries of a tile
_TOP = np.uint64(1 << 63)


def quantized(df: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, as long; only whole, finite vectors."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    large = F.raise_error(F.lit(f"a component times {scale} passes 64 bits")).cast("long")
    v = F.transform(x, lambda c: F.when(F.abs(c * float(scale)) < 2.0**63, F.floor(c * float(scale)).cast("long")).otherwise(large))
    rows = columns_only(df, "vec_id", "embedding").where(F.coalesce(sound, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def _unsigned(x: np.ndarray) -> np.ndarray:
    """64-bit integers as unsigned ones in the same order."""
    return x.astype(np.int64).view(np.uint64) ^ _TOP


def _matrices(batches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of up to _ROWS candidates of one length."""
    import pyarrow as pa

    def cut(held):
        table = pa.Table.from_batches(held).combine_chunks()
        column = table[1].combine_chunks()
        ids, lengths = table[0].to_numpy(), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(lengths)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            for at in range(0, len(rows), _ROWS):
                part = rows[at : at + _ROWS]
                yield ids[part], flat[(ends[part] - n)[:, None] + np.arange(n)]

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= _ROWS:
            yield from cut(held)
            held, size = [], 0
    if size:
        yield from cut(held)


def _scores(queries: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Inner products, exact: in doubles where no sum can pass 2**53, else in 64-bit integers."""
    largest = lambda x: max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))
    most = largest(queries) * largest(m) * m.shape[1]
    if most < 2**53:
        return (queries.astype(np.float64) @ m.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("the components are so large that a score could pass 64 bits")
    return queries @ m.T


class _Block:
    """What tasks need of a block: query ids, and vectors by length."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, flat: np.ndarray, k: int):
        self.ids, self.k = ids, k
        ends = np.cumsum(lengths)
        self.groups = [(rows, flat[(ends[rows] - n)[:, None] + np.arange(n)]) for n in np.unique(lengths) for rows in [np.flatnonzero(lengths == n)]]

    def tiles(self, batches, wanted: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the wanted queries: (rows of the block, candidate ids, scores, whether the candidate has another id)."""
        for ids, m in _matrices(batches):
            for rows, vectors in self.groups:
                if vectors.shape[1] != m.shape[1]:
                    continue
                some = np.flatnonzero(wanted[rows])
                for at in range(0, len(some), _TILE):
                    part = some[at : at + _TILE]
                    yield rows[part], ids, _scores(vectors[part], m), ids[None, :] != self.ids[rows[part]][:, None]


_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _select(candidates: DataFrame, shared, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query of the block: how many rows it gets, the least score that is kept, and which ids are kept at that score."""
    import pyarrow as pa

    schema = pa.schema([("q", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("n", pa.int64())])

    def extent(batches):
        for rows, _, s, other in shared.value.tiles(batches, np.ones(n, bool)):
            lo, hi, count = np.where(other, s, _HIGH).min(axis=1), np.where(other, s, _LOW).max(axis=1), other.sum(axis=1)
            yield from rows_out(schema, [(int(q), int(a), int(b), int(c)) for q, a, b, c in zip(rows, lo, hi, count, strict=True) if c])

    found = candidates.mapInArrow(extent, "q int, lo long, hi long, n long").groupBy("q").agg(F.min("lo"), F.max("hi"), F.sum("n")).collect()
    lo, hi, count = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for q, a, b, c in found:
        lo[q], hi[q], count[q] = a, b, c
    want = np.minimum(k, count)

    # The k-th best score: highest first, so bins are counted from the top.
    score, left, at_score = _refine(candidates, shared, _unsigned(lo), _unsigned(hi), want, count, lambda ids, s: _unsigned(s), None)
    score = (score ^ _TOP).view(np.int64)
    # Where more have that score than are wanted, the smallest ids: their complements, so that the same search applies.
    ends = candidates.agg(F.min("vec_id"), F.max("vec_id")).first()
    first, last = (~_unsigned(np.array([e or 0])) for e in (ends[1], ends[0]))
    tied = at_score > left
    top = np.where(tied, last[0], first[0])
    cut, _, _ = _refine(candidates, shared, np.full(n, first[0]), top, left, at_score, lambda ids, s: np.broadcast_to(~_unsigned(ids), s.shape), score)
    return want, score, np.where(tied, cut, np.uint64(0))


def _refine(candidates: DataFrame, shared, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, count: np.ndarray, value: Callable, at: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The want-th largest value (unsigned) of each query in [lo, hi], how many of the values equal to it are wanted, and how many there are."""
    import pyarrow as pa

    spark = candidates.sparkSession
    schema = pa.schema([("q", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())])
    lo, hi, want, count = lo.copy(), hi.copy(), want.copy(), count.copy()
    while (open_ := (hi > lo) & (want > 0)).any():
        step = (hi - lo) // np.uint64(_BINS) + np.uint64(1)
        state = spark.sparkContext.broadcast((lo.copy(), hi.copy(), step, open_))  # a few numbers a query of the block

        def tally(batches, state=state):
            block = shared.value
            lo, hi, step, open_ = state.value
            for rows, ids, s, other in block.tiles(batches, open_):
                v = value(ids, s)
                inside = (v >= lo[rows][:, None]) & (v <= hi[rows][:, None]) & other
                if at is not None:
                    inside &= s == at[rows][:, None]
                r, c = np.nonzero(inside)
                bins = ((v[r, c] - lo[rows[r]]) // step[rows[r]]).astype(np.int64)
                total = np.bincount(r * _BINS + bins, minlength=len(rows) * _BINS).reshape(len(rows), _BINS)
                above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
                q, b = np.nonzero((total > 0) & (above < block.k))  # lower bins cannot hold any of the k best
                yield from rows_out(schema, list(zip(rows[q].tolist(), b.tolist(), total[q, b].tolist(), strict=True)))

        counts = candidates.mapInArrow(tally, "q int, bin int, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        wanted = spark.createDataFrame([(int(q), int(want[q])) for q in np.flatnonzero(open_)], "q int, want long")
        above = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin"))) - F.col("n")
        hit = counts.withColumn("above", above).join(F.broadcast(wanted), "q")  # a row a query of the block
        hit = hit.where((F.col("above") < F.col("want")) & (F.col("above") + F.col("n") >= F.col("want")))
        for q, b, over, n in hit.select("q", "bin", "above", "n").collect():
            want[q] -= over
            count[q] = n
            begin = lo[q] + np.uint64(b) * step[q]
            lo[q], hi[q] = begin, begin + min(step[q] - np.uint64(1), hi[q] - begin)
    return lo, want, count


def top_k(spark: SparkSession, vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query row's k best other rows, ties to smaller ids.

    vectors is what `quantized` gives. The driver holds the vectors and bounds of one block at a time, BLOCK_BYTES of them; each
    block's rows are added to one table.
    """
    import pyarrow as pa

    ship(spark)
    candidates = staged(spark, vectors, "topk-candidates")
    queries = candidates.where(is_query).select("vec_id", "v")
    blocks = max(1, -(-(queries.agg(F.sum(8 * F.size("v") + 8)).first()[0] or 0) // BLOCK_BYTES))
    queries = staged(spark, queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))), "topk-queries")
    schema = pa.schema([("query_id", pa.int64()), ("q", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    path, columns = new_path(spark, "topk-found"), "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], columns).write.parquet(path)
    for b in range(blocks):
        rows = queries.where(F.col("block") == b).select("vec_id", "v").orderBy("vec_id").toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        column = rows["v"].combine_chunks()
        lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        block = _Block(rows["vec_id"].to_numpy(), lengths, column.flatten().to_numpy(zero_copy_only=False), k)
        shared = spark.sparkContext.broadcast(block)
        want, score, last = _select(candidates, shared, rows.num_rows, k)

        def keep(batches, shared=shared, want=want, score=score, last=last):
            block = shared.value
            for rows, ids, s, other in block.tiles(batches, want > 0):
                least = score[rows][:, None]
                good = ((s > least) | (s == least) & (~_unsigned(ids)[None, :] >= last[rows][:, None])) & other
                r, c = np.nonzero(good)
                yield from rows_out(schema, list(zip(block.ids[rows[r]].tolist(), rows[r].tolist(), ids[c].tolist(), s[r, c].tolist(), strict=True)))

        kept = candidates.mapInArrow(keep, "query_id long, q int, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
        part = kept.withColumn("rank", rank).where(F.col("rank") <= k)
        part.select("query_id", "rank", "vec_id", "score").write.mode("append").parquet(path)
        shared.unpersist()
    return spark.read.schema(columns).parquet(path)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
