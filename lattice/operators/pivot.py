"""Pivots: one pass of grouping sets, widened by the columns that occur, with calculated measures."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattice.errors import Invalid, LimitExceeded, Malformed
from lattice.operators.flat import aggregate, predicate
from lattice.plans.query import Aggregate, Limits, check_aggregates, check_filter, check_shape, depth, fields_of, name_of
from lattice.runtime import staged
from lattice.types import Schema

CALCULATIONS = ("share_of_row", "share_of_column", "share_of_total", "running_total")


@dataclass(frozen=True)
class PivotLimits:
    max_column_dimensions: int = 2
    max_columns: int = 256
    max_rows: int = 10_000
    max_cells: int = 131_072


@dataclass(frozen=True)
class Measure:
    aggregate: Aggregate
    calc: str | None = None


@dataclass(frozen=True)
class LevelSort:
    field: str
    by: str | None = None
    descending: bool = False


@dataclass(frozen=True)
class PivotQuery:
    source: str
    rows: tuple[str, ...]
    columns: tuple[str, ...]
    values: tuple[Measure, ...]
    filter: Any = None
    sort: tuple[LevelSort, ...] = ()

    @classmethod
    def from_json(cls, j: Any) -> PivotQuery:
        d = fields_of(j, "pivot", ("source", "rows", "columns", "values", "filter", "sort"))
        values, sort = [], []
        for v in d.get("values", []):
            m = fields_of(v, "measure", ("field", "fn", "as", "calc"))
            if "calc" in m and m["calc"] not in CALCULATIONS:
                raise Malformed(f"calc {m['calc']!r}: one of {', '.join(CALCULATIONS)}")
            values.append(Measure(Aggregate.from_json({k: x for k, x in m.items() if k != "calc"}), m.get("calc")))
        for s in d.get("sort", []):
            x = fields_of(s, "sort", ("field", "by", "direction"))
            if x.get("direction", "asc") not in ("asc", "desc"):
                raise Malformed("sort: asc or desc")
            sort.append(LevelSort(name_of(x.get("field"), "sort.field"), x.get("by"), x.get("direction") == "desc"))
        check_shape(d.get("filter"))
        names = lambda k: tuple(name_of(n, k) for n in d.get(k, []))
        return cls(name_of(d.get("source"), "source"), names("rows"), names("columns"), tuple(values), d.get("filter"), tuple(sort))


@dataclass
class PivotResult:
    """df: the row dimensions, one column a (path, measure) named <alias>_<i>, and __level; in order.

    __level is the number of row dimensions that a row has: fewer than all make it a subtotal, none the grand total.
    """

    df: DataFrame
    rows: tuple[str, ...]
    columns: list[dict] = field(default_factory=list)  # {name, path, measure}
    all_rows: DataFrame | None = None  # df before it is put in order, with the columns of the order
    order: list[Column] = field(default_factory=list)


def validate_pivot(p: PivotQuery, schema: Schema, limits: PivotLimits, query_limits: Limits) -> Any:
    if not p.values:
        raise Invalid("a pivot needs a measure", "NoMeasures")
    if len(p.columns) > limits.max_column_dimensions:
        raise Invalid(f"{len(p.columns)} column dimensions; {limits.max_column_dimensions} at most", "TooManyColumnDimensions")
    dims, aliases = (*p.rows, *p.columns), {v.aggregate.alias for v in p.values}
    for i, n in enumerate(dims):
        if n in dims[:i] or n in aliases:
            raise Invalid(f"{n} twice", "DuplicateDimension")
    for v in p.values:
        if v.calc and v.calc != "running_total" and v.aggregate.fn not in ("sum", "count"):
            raise Invalid(f"{v.calc} is for sum and count, not for {v.aggregate.fn}", "Calc")
    for i, s in enumerate(p.sort):
        if s.field not in p.rows or s.field in [e.field for e in p.sort[:i]] or s.by is not None and s.by not in aliases:
            raise Invalid(f"the sort of {s.field} names no row dimension, one twice, or no measure", "Sort")
    if p.filter is not None and (d := depth(p.filter)) > query_limits.max_depth:
        raise Invalid(f"nested {d} deep", "FilterTooDeep")
    for n in dims:
        if schema.field(n) is None:
            raise Invalid(f"no field {n}", "UnknownField", "group")
        if schema.field(n).type.is_list:
            raise Invalid(f"{n} is a list", "ListNotOrdered", "group")
    found = {f.name: f for f in check_aggregates(tuple(v.aggregate for v in p.values), schema, "values")}
    for v in p.values:
        if v.calc == "running_total" and not found[v.aggregate.alias].type.is_number:
            raise Invalid(f"running_total of {v.aggregate.alias}: not a number", "Calc")
    return None if p.filter is None else check_filter(p.filter, schema, query_limits, "filter")


def _same(names, other: DataFrame, mine: str = "") -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{mine}{n}").eqNullSafe(other[f"__{n}"]) for n in names], F.lit(True))


def run_pivot(df: DataFrame, p: PivotQuery, schema: Schema, where: Any, limits: PivotLimits = PivotLimits()) -> PivotResult:
    rows = df if where is None else df.where(predicate(where))
    aliases = [v.aggregate.alias for v in p.values]
    aggs = [aggregate(v.aggregate, schema) for v in p.values]
    n = len(p.rows)
    in_total = [F.grouping(r).cast("int").alias(f"__g{i}") for i, r in enumerate(p.rows)]
    by = {s.field: s for s in p.sort}
    # A level that is sorted by a measure needs it over whole rows: one more set a level, without the column dimensions.
    whole = [i for i, r in enumerate(p.rows) if p.columns and r in by and by[r].by]
    if p.rows:
        sets = [*([*p.rows[:k], *p.columns] for k in range(n + 1)), *(list(p.rows[: i + 1]) for i in whole)]
        in_total += [F.grouping(p.columns[0]).cast("int").alias("__whole")] if whole else []
        cells = rows.groupingSets([[F.col(c) for c in s] for s in sets], *p.rows, *p.columns).agg(*aggs, *in_total)
    elif p.columns:
        cells = rows.groupBy(*p.columns).agg(*aggs)
    else:
        cells = rows.agg(*aggs)
    level = F.lit(n) - reduce(lambda a, b: a + b, [F.col(f"__g{i}") for i in range(n)], F.lit(0))
    cells = cells.withColumn("__level", level.cast("int"))
    cells = cells if whole else cells.withColumn("__whole", F.lit(0))
    most = limits.max_cells * (1 + len(whole))  # a set of whole rows has no more rows than there are cells
    cells = staged(cells.limit(most + 1), "pivot-cells")
    n_cells, n_all = cells.agg(F.count_if(F.col("__whole") == 0), F.count(F.lit(1))).first()
    if n_cells > limits.max_cells or n_all > most:
        raise LimitExceeded(f"more than {limits.max_cells} cells")
    wholes = cells.where("__whole = 1") if whole else cells
    cells = cells.where("__whole = 0").drop("__whole")

    # The columns that occur, in order, with nulls last, and the grand total's cells: at most max_columns rows.
    top = cells.where("__level = 0").select(*p.columns, *aliases)
    if p.columns:
        top = top.orderBy(*[F.col(c).asc_nulls_last() for c in p.columns]).limit(limits.max_columns + 1)
    found = top.collect()
    paths = [tuple(r)[: len(p.columns)] for r in found] if p.columns else [()]
    grand = {f"{a}_{i}": r[a] for i, r in enumerate(found) for a in aliases}
    if len(paths) * len(aliases) > limits.max_columns:
        raise LimitExceeded(f"more than {limits.max_columns} columns")
    if p.columns and paths:
        catalogue = df.sparkSession.createDataFrame([(*k, i) for i, k in enumerate(paths)], ", ".join(f"__{c} {schema.field(c).type.sql}" for c in p.columns) + ", __column int")
        cells = cells.join(F.broadcast(catalogue), _same(p.columns, catalogue))  # at most max_columns rows
    else:
        cells = cells.withColumn("__column", F.lit(0))

    shown = {v.aggregate.alias: {"calc": v.calc} if v.calc else {} for v in p.values}
    columns = [{"name": f"{a}_{i}", "path": list(k), "measure": a} | shown[a] for i, k in enumerate(paths) for a in aliases]
    wide = [F.first(F.when(F.col("__column") == i, F.col(a)), ignorenulls=True).alias(f"{a}_{i}") for i in range(len(paths)) for a in aliases]
    flags = [f"__g{i}" for i in range(n)]
    out = cells.groupBy(*p.rows, *flags, "__level").agg(*wide) if wide else cells.select(*p.rows, *flags, "__level").distinct()
    counts = {v.aggregate.alias for v in p.values if v.aggregate.fn == "count"}
    out = out.withColumns({c["name"]: F.coalesce(c["name"], F.lit(0).cast("bigint")) for c in columns if c["measure"] in counts})
    if n_cells > limits.max_rows and out.count() > limits.max_rows:  # there are no more rows than cells
        raise LimitExceeded(f"more than {limits.max_rows} rows")

    # Each level in the order of its values, or of a measure over the whole row; a subtotal after its members.
    order: list[Column] = []
    for i, r in enumerate(p.rows):
        order.append(F.col(f"__g{i}").asc())
        s = by.get(r)
        if s and s.by:
            prefix = p.rows[: i + 1]
            level_rows = wholes.where(F.col("__level") == i + 1).select(*[F.col(c).alias(f"__{c}") for c in prefix], F.col(s.by).alias(f"__by{i}"))
            out = out.join(level_rows, (F.col("__level") > i) & _same(prefix, level_rows), "left").drop(*[f"__{c}" for c in prefix])
            order.append(F.col(f"__by{i}").desc_nulls_last() if s.descending else F.col(f"__by{i}").asc_nulls_last())
            order.append(F.col(r).asc_nulls_last())
        else:
            order.append(F.col(r).desc_nulls_last() if s and s.descending else F.col(r).asc_nulls_last())
    out = _calculated(out, p, grand, paths, schema)
    return PivotResult((out.orderBy(*order) if order else out).select(*p.rows, *[c["name"] for c in columns], "__level"), p.rows, columns, out, order)


def _adding(t: str):
    return lambda total, x: (total + x).cast(t)


def _calculated(out: DataFrame, p: PivotQuery, grand: dict[str, Any], paths: list, schema: Schema) -> DataFrame:
    """Measures that are shown as shares or running totals, from the pivot's own cells."""
    wanted = [v for v in p.values if v.calc]
    if not wanted or not paths:
        return out
    new: dict[str, Column] = {}
    for v in wanted:
        a = v.aggregate.alias
        names = [f"{a}_{i}" for i in range(len(paths))]
        double = lambda n: F.col(n).cast("double")
        if v.calc == "running_total":
            cells = F.array(*names)
            t = check_aggregates((v.aggregate,), schema, "values")[0].type.sql
            for i, n in enumerate(names):
                seen = F.filter(F.slice(cells, 1, i + 1), lambda x: x.isNotNull())
                new[n] = F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0).cast(t), _adding(t)))
            continue
        whole = reduce(lambda s, n: s + F.coalesce(double(n), F.lit(0.0)), names, F.lit(0.0))
        total = sum(float(grand[n]) for n in names if grand.get(n) is not None)
        for n in names:
            of = {"share_of_row": whole, "share_of_total": F.lit(total), "share_of_column": F.lit(None if grand.get(n) is None else float(grand[n])).cast("double")}[v.calc]
            new[n] = F.try_divide(double(n), of)
    return out.withColumns(new)


def drill_down(p: PivotQuery, row: dict[str, Any], path: list[Any], level: int) -> dict:
    """The query of the rows behind a cell: the pivot's filter and an equality for each dimension."""
    own = [*((d, row[d]) for d in p.rows[:level]), *zip(p.columns, path, strict=True)]
    parts = ([p.filter] if p.filter is not None else []) + [{"field": d, "op": "is_null"} if v is None else {"field": d, "op": "eq", "value": v} for d, v in own]
    return {"source": p.source, "filter": {"and": parts}}
