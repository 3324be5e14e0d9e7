"""What the operators share: the shared folder, staged tables, lookups by a hot key, ranks."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice import runtime
from lattice.runtime import discard, new_path, scratch

__all__ = ["WORD", "arrow_schema", "columns_only", "discard", "given", "lookup", "lookup_wide", "new_path", "ranked", "rows_out", "scratch", "ship", "staged", "text_of", "width"]

#: Words of every operator that counts words: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_SHIPPED = "lattice.llm.shipped"


#: Arrow batches between JVM and Python hold so much at most (and a row at least), as texts may be long.
_BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that are started elsewhere than here, and bound Arrow batches by bytes."""
    if spark.conf.get(_BATCH[0], None) is None:
        spark.conf.set(*_BATCH)
    root = Path(__file__).resolve().parents[2]
    known = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(p and Path(p).resolve() == root for p in known) or spark.conf.get(_SHIPPED, None):
        return
    path = f"{tempfile.mkdtemp()}/lattice_package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted((root / "lattice").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, "true")


def staged(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder and read back: lineage ends, a lost executor loses nothing."""
    return runtime.staged(df, label)


def given(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A few rows of the driver's as a table, by way of Arrow: lists of rows would start Python workers of their own, which stay."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(schema)
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, fields, strict=True)], schema=fields), schema)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def columns_only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that no other column can clash with an operator's own names."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def lookup_wide(left: DataFrame, right: DataFrame, key: str, weight: str, at_most: int = 64) -> DataFrame:
    """left JOIN right USING (key), LEFT, as `lookup`, for right rows of any size: none is broadcast.

    Of the `at_most` heaviest keys only the number of copies is broadcast: a key with a share x of the left rows has about x times
    the partitions of them, and its left rows are dealt over the copies by a hash of the whole row.
    """
    spark, parts = left.sparkSession, width(left.sparkSession)
    total = right.agg(F.sum(weight)).first()[0] or 1
    heaviest = right.where(F.col(key).isNotNull()).orderBy(F.desc(weight), key).limit(at_most).select(key, weight).collect()
    copies = [(k, max(1, -(-w * parts // total))) for k, w in heaviest]
    heavy = F.broadcast(given(spark, copies, T.StructType([T.StructField("__h", right.schema[key].dataType), T.StructField("__copies", T.IntegerType())])))
    copied = right.join(heavy, F.col(key) == F.col("__h"), "left")
    copied = copied.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.coalesce("__copies", F.lit(1)) - 1))).drop("__h", "__copies")
    dealt = F.coalesce(F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.col("__copies")).cast("int"), F.lit(0))
    out = left.join(heavy, F.col(key) == F.col("__h"), "left").withColumn("__copy", dealt).drop("__h", "__copies")
    return out.join(copied, [key, "__copy"], "left").select(*left.columns, *[c for c in right.columns if c != key])


def lookup(left: DataFrame, right: DataFrame, key: str, weight: str, at_most: int = 256) -> DataFrame:
    """left JOIN right USING (key), LEFT; right has one row a key, with the left rows of each key in `weight`.

    The `at_most` heaviest keys are broadcast; any other key has less than 1/at_most of the rows. Rows of heavy keys go
    through the second join under keys of their own, spread over all partitions by a hash of the whole row: a task that is run
    again sends each row to the same place, whatever their order. Null keys find nothing.
    """
    values = [c for c in right.columns if c != key]
    right = right.where(F.col(key).isNotNull())
    heavy = right.where(F.col(weight) > 1).orderBy(F.desc(weight), key).limit(at_most)
    pack = lambda df, name: df.select(F.col(key).alias(f"__{name}"), F.struct(*values).alias(f"__{name}_v"))
    out = left.join(F.broadcast(pack(heavy, "h")), F.col(key) == F.col("__h"), "left")
    spread = F.when(F.col("__h").isNull() & F.col(key).isNotNull(), F.concat(F.lit("k"), F.col(key).cast("string")))
    spread = F.coalesce(spread, F.concat(F.lit("s"), F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]).cast("string")))
    light = pack(right, "l").withColumn("__l", F.concat(F.lit("k"), F.col("__l").cast("string")))
    out = out.withColumn("__k", spread).join(light, F.col("__k") == F.col("__l"), "left")
    found = F.coalesce("__h_v", "__l_v")
    return out.select(*left.columns, *[found[v].alias(v) for v in values])


def ranked(spark: SparkSession, df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """df with the 0-based position of each row in the given total order, without one task for all rows."""
    return runtime.with_rank(df, *order, name=name)


def arrow_schema(schema: str) -> T.StructType:
    return T._parse_datatype_string(schema)


def rows_out(schema, rows: list) -> Iterator:
    """One Arrow batch of the rows (tuples in the order of an Arrow schema)."""
    import pyarrow as pa

    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
