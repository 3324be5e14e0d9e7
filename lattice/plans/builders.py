"""Queries that a grid asks: search, facets, groups and their children, totals, windows, summaries. All are plain JSON queries."""

from __future__ import annotations

from typing import Any

from lattice.errors import Invalid
from lattice.types import INT64, UTF8, Schema, Type, literal

GROUPABLE = ("utf8", "bool", "int64", "date")
ROWS = "og_rows"


def both(*filters: Any) -> Any:
    parts = [f for f in filters if f is not None]
    return None if not parts else parts[0] if len(parts) == 1 else {"and": parts}


def free_text(schema: Schema, text: str) -> dict | None:
    """Any text column contains it, in any case; nothing for blank text."""
    if not text.strip():
        return None
    return {"or": [{"field": f.name, "op": "icontains", "value": text} for f in schema.fields if f.type.kind == "utf8"]}


def operators(schema: Schema, name: str) -> list[str]:
    """The operators that a filter row offers for a column."""
    t = schema.field(name).type
    if t.is_list:
        return ["has", "has_all", "is_empty", "is_null", "is_not_null"]
    if t.kind == "utf8":
        return ["icontains", "contains", "istarts_with", "starts_with", "eq", "ne", "in", "is_null", "is_not_null"]
    if t.kind == "bool":
        return ["eq", "ne", "is_null", "is_not_null"]
    return ["eq", "ne", "lt", "lte", "gt", "gte", "in", "is_null", "is_not_null"]


def typed(text: str, t: Type) -> Any:
    """What a person types, as a literal of the column's type (of its elements, for lists); ValueError if it is none."""
    text = text.strip()
    element = {"list<utf8>": UTF8, "list<int64>": INT64}.get(t.kind, t)
    if element.kind == "bool":
        if text not in ("true", "1", "false", "0"):
            raise ValueError(text)
        return text in ("true", "1")
    if element.kind in ("int64", "float64") and text not in ("NaN", "Infinity", "-Infinity"):
        value = int(text) if element.kind == "int64" else float(text)
    else:
        value = text.removeprefix("+") if element.kind == "decimal" else text
    try:
        literal(value, element, "")
    except Invalid as e:
        raise ValueError(text) from e
    return value


def condition(schema: Schema, column: str, op: str, text: str = "") -> dict | None:
    """One entry of a filter row; None for a column that isn't there and for a blank value of an operator that takes one."""
    if schema.field(column) is None:
        return None
    if op in ("is_null", "is_not_null", "is_empty"):
        return {"field": column, "op": op}
    if not text.strip():
        return None
    t = schema.field(column).type
    value = [typed(x, t) for x in text.split(",") if x.strip()] if op in ("has_all", "in") else typed(text, t)
    return {"field": column, "op": op, "value": value}


def filter_row(schema: Schema, entries: list[tuple[str, str, str]]) -> tuple[dict | None, list[tuple[str, str]]]:
    """The filter of (column, operator, text) entries, all of which must hold, and the entries whose text is no value of their column."""
    parts, problems = [], []
    for column, op, text in entries:
        try:
            parts.append(condition(schema, column, op, text))
        except ValueError:
            problems.append((column, text))
    parts = [p for p in parts if p is not None]
    return (None if problems or not parts else {"and": parts}), problems


def group(kind: str, members: list[Any]) -> Any:
    """Members joined by "and" or "or": groups of the same kind are merged, a group of one is its member, none is no filter."""
    flat = [x for m in members if m is not None for x in (m[kind] if set(m) == {kind} else [m])]
    return None if not flat else flat[0] if len(flat) == 1 else {kind: flat}


def check_tree(schema: Schema, f: Any) -> None:
    """Invalid if a view's filter is more than groups of one member at least and conditions on known columns, without `not` and `in`."""
    for kind in ("and", "or"):
        if kind in f:
            if not f[kind]:
                raise Invalid("a group has no member", "FilterTree")
            for m in f[kind]:
                check_tree(schema, m)
            return
    if "not" in f or f.get("op") == "in":
        raise Invalid(f"{'not' if 'not' in f else 'in'} is not part of a view's filter", "FilterTree")
    if schema.field(f["field"]) is None:
        raise Invalid(f"no column {f['field']}", "FilterTree")


def facet_period(schema: Schema, field: str, low: str = "", high: str = "") -> dict | None:
    """A facet's period or typed range, as text, with both ends in it; a blank end is open; ValueError for a bound that is no value."""
    return both(condition(schema, field, "gte", low), condition(schema, field, "lte", high))


def facet_filter(field: str, values: list | None = None, low: Any = None, high: Any = None) -> dict | None:
    """A facet's selection: chosen values (null among them as is_null), or a range with both ends in it."""
    if values is not None:
        named = [v for v in values if v is not None]
        parts = ([{"field": field, "op": "in", "value": named}] if named else []) + ([{"field": field, "op": "is_null"}] if None in values else [])
        return parts[0] if len(parts) == 1 else {"or": parts}
    return both(None if low is None else {"field": field, "op": "gte", "value": low}, None if high is None else {"field": field, "op": "lte", "value": high})


def facet_counts(source: str, field: str, selections: dict[str, Any], base: Any = None) -> dict:
    """Rows by value under every restriction but the facet's own."""
    out = {"source": source, "select": [field], "group": [field], "aggregate": [{"fn": "count", "as": ROWS}], "sort": [{"field": field}]}
    if (f := both(base, *(s for name, s in selections.items() if name != field))) is not None:
        out["filter"] = f
    return out


def group_children(path: list[tuple[str, Any]], base: Any = None) -> Any:
    """The rows of a group: its keys, null as is_null."""
    return both(base, *({"field": f, "op": "is_null"} if v is None else {"field": f, "op": "eq", "value": v} for f, v in path))


def group_level(source: str, schema: Schema, groups: list[str], path: list[Any], aggregates: list[dict], base: Any = None) -> dict:
    """One level of groups (three at most): key, number of rows, aggregates; ascending, nulls last."""
    if len(groups) > 3 or len(path) >= len(groups):
        raise Invalid("at most three levels of groups", "Grouping")
    field = groups[len(path)]
    if schema.field(field) is None or schema.field(field).type.kind not in GROUPABLE:
        raise Invalid(f"{field} can't be grouped by", "Grouping")
    out = {"source": source, "select": [field], "group": [field], "aggregate": [{"fn": "count", "as": ROWS}, *aggregates], "sort": [{"field": field}]}
    if (f := group_children(list(zip(groups, path, strict=False)), base)) is not None:
        out["filter"] = f
    return out


def totals(source: str, aggregates: list[dict], base: Any = None) -> dict:
    return {"source": source, "aggregate": aggregates} | ({} if base is None else {"filter": base})


def summary(field: str, tokens: list[str]) -> list[dict]:
    """Aggregates of a summary row; range is the least and the greatest."""
    names = [n for t in tokens for n in (("min", "max") if t == "range" else (t,))]
    return [{"fn": n, "field": field, "as": f"{field}_{n}"} for n in dict.fromkeys(names)]


def window(source: str, select: list[str], sort: list[dict], offset: int, limit: int, base: Any = None) -> dict:
    return {"source": source, "select": select, "sort": sort, "offset": offset, "limit": limit} | ({} if base is None else {"filter": base})


def whole_view(source: str, select: list[str], groups: list[str], sort: list[dict], base: Any = None, locale: str | None = None, schema: Schema | None = None) -> dict:
    """All rows of a view: group keys lead the sort; a locale is put on text keys only."""
    keys = [*({"field": g} | next((s for s in sort if s["field"] == g), {}) for g in groups), *(s for s in sort if s["field"] not in groups)]
    if locale and schema:
        keys = [k | {"collation": locale} if schema.field(k["field"]) and schema.field(k["field"]).type.kind == "utf8" else k for k in keys]
    return {"source": source, "select": select, "sort": keys} | ({} if base is None else {"filter": base})
