"""Flat queries as DataFrame operations: filter, group, aggregate, sort, page, project."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.functions.collation import collated
from lattice.plans.query import Aggregate, Query, Sort, Valid
from lattice.runtime import with_rank
from lattice.types import INT64, UTF8, Schema, Type, column_of

_COMPARE = {"eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v}
_TEXT = {
    "contains": lambda c, v: F.contains(c, v),
    "starts_with": lambda c, v: F.startswith(c, v),
    "icontains": lambda c, v: F.contains(F.lower(c), F.lower(v)),
    "istarts_with": lambda c, v: F.startswith(F.lower(c), F.lower(v)),
}


def predicate(f: tuple) -> Column:
    """A checked filter as a boolean column, in three-valued logic; rows where it is unknown are not kept."""
    op, *rest = f
    if op in ("and", "or"):
        return reduce(lambda a, b: a & b if op == "and" else a | b, map(predicate, rest), F.lit(op == "and")) if rest else F.lit(op == "and")
    if op == "not":
        return ~predicate(rest[0])
    field, value = rest[0], rest[1] if len(rest) > 1 else None
    c = F.col(field.name)
    if op == "is_null":
        return c.isNull()
    if op == "is_not_null":
        return c.isNotNull()
    if op == "is_empty":  # never unknown
        return c.isNotNull() & (F.size(c) == 0)
    element = {"list<utf8>": UTF8, "list<int64>": INT64}.get(field.type.kind, field.type)
    if op == "in":  # an empty list is false, for null too
        return c.isin([column_of(v, element) for v in value]) if value else F.lit(False)
    if op == "has_all":
        return F.when(c.isNotNull(), reduce(lambda a, b: a & b, [F.array_contains(c, column_of(v, element)) for v in value], F.lit(True)))
    v = column_of(value, element)
    if op == "has":
        return F.array_contains(c, v) if value is not None else F.lit(None).cast("boolean")
    return (_COMPARE.get(op) or _TEXT[op])(c, v)


def aggregate(a: Aggregate, schema: Schema) -> Column:
    """An aggregate with its fixed result type; sums are exact or raise."""
    if a.field is None:
        return F.count(F.lit(1)).alias(a.alias)
    c, t = F.col(a.field), schema.field(a.field).type
    if a.fn == "sum":
        out = F.sum(c.cast(Type("decimal", 38, t.scale).sql)) if t.kind == "decimal" else F.sum(c)
    elif a.fn == "avg":
        out = F.avg(c.cast("double"))
    else:
        out = {"count": F.count, "min": F.min, "max": F.max}[a.fn](c)
    return out.cast(a.result(t).sql).alias(a.alias)


def sort_keys(spark: SparkSession, sort: tuple[Sort, ...]) -> list[Column]:
    """Nulls where the key says, whatever the direction; under a locale, ties go by code points."""
    out = []
    for s in sort:
        for c in [collated(spark, F.col(s.field), s.locale), F.col(s.field)] if s.locale else [F.col(s.field)]:
            out.append(getattr(c, f"{'desc' if s.descending else 'asc'}_nulls_{'first' if s.nulls_first else 'last'}")())
    return out


def grouped(df: DataFrame, q: Query, schema: Schema) -> DataFrame:
    if q.aggregate:
        columns = [aggregate(a, schema) for a in q.aggregate]
        return df.groupBy(*q.group).agg(*columns) if q.group else df.agg(*columns)
    return df.select(*q.group).distinct() if q.group else df


#: Beyond this offset a page is found by position: a plain offset brings all rows before the page into one task.
DEEP_OFFSET = 10_000


def page(df: DataFrame, q: Query, order: list[Column]) -> DataFrame:
    """The rows of the page, in the order."""
    if order and q.offset and q.offset > DEEP_OFFSET:
        at = F.col("__position")
        here = with_rank(df, *order, name="__position").where(at >= q.offset)
        return (here if q.limit is None else here.where(at < q.offset + q.limit)).orderBy(at).drop("__position")
    df = df.orderBy(*order) if order else df
    df = df.offset(q.offset) if q.offset else df
    return df.limit(q.limit) if q.limit is not None else df


def lower(df: DataFrame, valid: Valid, schema: Schema, unique: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(the page, all rows before paging). Ties of a sort go by the group keys, or by the source's unique key."""
    q = valid.query
    rows = df if valid.filter is None else df.where(predicate(valid.filter))
    rows = grouped(rows, q, schema)
    names = [f.name for f in valid.output]
    order = []
    if q.sort:
        ties = [n for n in (q.group if q.group or q.aggregate else unique) if n in rows.columns and n not in {s.field for s in q.sort}]
        order = [*sort_keys(df.sparkSession, q.sort), *[F.col(n).asc_nulls_last() for n in ties]]
    return page(rows, q, order).select(*names), rows
