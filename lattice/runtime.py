"""Tables staged in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_STAGED: list[tuple[str, DataFrame]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as a URI or path. Only a local session may do without one."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Written once and read back: loops do not grow their lineage, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED.append((path, out))
    return out


def _remove(spark: SparkSession, found: list[tuple[str, DataFrame]]) -> None:
    for path, df in found:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
        _STAGED[:] = [x for x in _STAGED if x[1] is not df]


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Remove staged tables that nothing reads any more."""
    _remove(spark, [x for x in _STAGED if any(x[1] is f for f in frames)])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """What is staged inside is removed at the end, but for what is put on the list that is given."""
    kept, known = [], {path for path, _ in _STAGED}
    try:
        yield kept
    finally:
        _remove(spark, [x for x in _STAGED if x[0] not in known and not any(x[1] is k for k in kept)])


def with_rank(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """df with each row's position (from 0) in a total order: sorted by range, counted by partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id()), "rank")
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col("__part").alias("__p"), "first", before.alias("before"))  # one row a partition
    return dealt.join(F.broadcast(offsets), F.col("__part") == F.col("__p")).select(*df.columns, (F.col("before") + F.col("__at") - F.col("first")).alias(name))
