"""CSV and JSON into a given schema: nothing is guessed, and what doesn't fit is refused with its place.

CSV: quotes as RFC 4180, a byte-order mark, empty lines skipped, nothing trimmed; an empty cell is the empty string and
\\N (or what the options say) is null. Cells are read as text and cast strictly by Spark, file splits and all.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattice.errors import DataError
from lattice.types import Field, Schema, Type, shaped

_NEVER = "\u0001"  # stands for no cell of a CSV file


@dataclass(frozen=True)
class CsvOptions:
    delimiter: str = ","
    has_header: bool = True
    null_values: tuple[str, ...] = ("\\N",)
    multi_line: bool = True  # quoted cells may hold line ends; without, files are split


def _strict(c: Column, t: Type) -> tuple[Column, Column]:
    """(value, whether the text is one). Decimals must fit exactly; dates and times have one notation."""
    if t.kind == "utf8":
        return c, F.lit(True)
    if t.kind == "bool":
        return F.when(c == "true", True).when(c == "false", False), c.isin("true", "false")
    if t.kind == "int64":
        v = c.try_cast("bigint")
        return v, c.rlike(r"^-?\d+$") & v.isNotNull()
    if t.kind == "float64":
        v = c.try_cast("double")
        return v, c.rlike(r"^(-?\d+(\.\d*)?([eE][+-]?\d+)?|-?\.\d+([eE][+-]?\d+)?|NaN|-?Infinity)$") & v.isNotNull()
    if t.kind == "decimal":
        whole, part = t.precision - t.scale, t.scale
        shape = rf"^-?0*\d{{0,{max(whole, 1)}}}(\.\d{{0,{part}}}0*)?$" if whole else rf"^-?0*(\.\d{{0,{part}}}0*)?$"
        v = c.try_cast(t.sql)
        return v, c.rlike(shape) & c.rlike(r"\d") & v.isNotNull()
    if t.kind == "date":
        v = c.try_cast("date")
        return v, c.rlike(r"^\d{4}-\d{2}-\d{2}$") & v.isNotNull()
    if t.kind == "timestamp":
        v = c.try_cast("timestamp")
        return v, c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z$") & v.isNotNull()
    v = F.from_json(c, t.sql)  # a list is written as a JSON array
    return v, c.rlike(r"^\s*\[.*\]\s*$") & v.isNotNull() & ~F.exists(v, lambda x: x.isNull())


def strict(df: DataFrame, schema: Schema, where: str) -> DataFrame:
    """Text columns to the schema's types; the first cell that isn't one, or a null that may not be, is refused."""
    stored = [f for f in schema.fields if f.of is None]
    values, wrong = {}, None
    for f in stored:
        v, fits = _strict(F.col(f.name), f.type)
        values[f.name] = v
        bad = F.col(f.name).isNotNull() & ~F.coalesce(fits, F.lit(False)) if f.nullable else ~F.coalesce(fits, F.lit(False))
        said = F.when(bad, F.concat(F.lit(f"{f.name}: "), F.coalesce(F.col(f.name), F.lit("null")), F.lit(f" is no {f.type.sql}")))
        wrong = said if wrong is None else F.coalesce(wrong, said)
    first = df.select(wrong.alias("w")).where("w is not null").first()
    if first:
        raise DataError(f"{where}: {first[0]}")
    return shaped(df.select(*[v.alias(n) for n, v in values.items()]), schema)


def read_csv(spark: SparkSession, path: str, schema: Schema, options: CsvOptions = CsvOptions()) -> DataFrame:
    names = [f.name for f in schema.fields if f.of is None]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(text).option("sep", options.delimiter).option("quote", '"').option("escape", '"').option("nullValue", _NEVER).option("emptyValue", "").option("multiLine", options.multi_line).option("mode", "FAILFAST").option("enforceSchema", "false")
    if options.has_header:
        header = spark.read.option("sep", options.delimiter).option("header", "true").option("multiLine", options.multi_line).csv(path).columns
        if header != names:
            raise DataError(f"{path}: the header is {header}, not {names}")
    df = reader.option("header", str(options.has_header).lower()).csv(path)
    cells = [F.when(~F.coalesce(F.col(n), F.lit("")).isin(*options.null_values), F.coalesce(F.col(n), F.lit(""))).alias(n) for n in names]
    return strict(df.select(*cells), schema, path)


def read_json(spark: SparkSession, path: str, schema: Schema, multi_line: bool = True) -> DataFrame:
    """An array of row objects (or one object a line): by name, unknown keys refused, missing ones null."""
    stored = [f for f in schema.fields if f.of is None]
    known = spark.read.option("multiLine", multi_line).option("primitivesAsString", "true").json(path)
    if extra := [c for c in known.columns if c not in {f.name for f in stored}]:
        raise DataError(f"{path}: unknown key {extra[0]!r}")
    columns = [(F.to_json(F.col(f.name)) if f.type.is_list else F.col(f.name).cast("string")) if f.name in known.columns else F.lit(None).cast("string") for f in stored]
    return strict(known.select(*[c.alias(f.name) for c, f in zip(columns, stored, strict=True)]), schema, path)


_GUESSES = ("bool", "int64", "float64", "timestamp", "date")


def infer(df: DataFrame) -> Schema:
    """A proposal for text columns: the first of bool, int64, float64, timestamp, date that all cells are, else utf8.

    Null cells don't count, a column of nulls is utf8, and decimals are never proposed. One aggregate over all rows.
    """
    checks = [F.bool_and(F.when(F.col(c).isNotNull(), F.coalesce(_strict(F.col(c), Type(k))[1], F.lit(False)))).alias(f"{i}_{k}") for i, c in enumerate(df.columns) for k in _GUESSES]
    row = df.agg(*checks, *[F.count_if(F.col(c).isNull()).alias(f"{i}_nulls") for i, c in enumerate(df.columns)]).first()
    fields = []
    for i, c in enumerate(df.columns):
        kind = next((k for k in _GUESSES if row[f"{i}_{k}"]), "utf8")
        fields.append(Field(c, Type(kind), row[f"{i}_nulls"] > 0))
    return Schema(fields)


def from_rows(spark: SparkSession, rows: list[dict[str, Any]], schema: Schema) -> DataFrame:
    """A few rows given in Python: each value read as a literal of its column."""
    from lattice.types import literal

    stored = [f for f in schema.fields if f.of is None]
    for r in rows:
        if extra := set(r) - {f.name for f in stored}:
            raise DataError(f"unknown key {sorted(extra)[0]!r}")
    data = [tuple([literal(x, Type(f.type.kind[5:-1]), f.name) for x in r[f.name]] if f.type.is_list and r.get(f.name) is not None else literal(r.get(f.name), f.type, f.name) for f in stored) for r in rows]
    return shaped(spark.createDataFrame(data, ", ".join(f"`{f.name}` {f.type.sql}" for f in stored)), schema)
