"""The JSON query: strict reading, and validation against a schema in a fixed order."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from lattice.errors import Invalid, Malformed
from lattice.types import FLOAT64, INT64, NAME, UTF8, Field, Schema, Type, literal

ORDERED = ("eq", "ne", "lt", "lte", "gt", "gte")
TEXT = ("contains", "starts_with", "icontains", "istarts_with")
UNARY = ("is_null", "is_not_null", "is_empty")
LIST_ONLY = ("has", "has_all", "is_empty")
FUNCTIONS = ("count", "sum", "avg", "min", "max")
FLAT_COLUMNS = ("level", "path", "match")
_LOCALE = re.compile(r"[a-z]{2,3}(-[A-Z][a-z]{3})?(-([A-Z]{2}|\d{3}))?")


@dataclass(frozen=True)
class Limits:
    max_depth: int = 8
    max_list_values: int = 1000
    max_limit: int = 10_000


def fields_of(j: Any, what: str, known: tuple[str, ...]) -> dict:
    """An object with known keys only; null counts as absent."""
    if not isinstance(j, dict):
        raise Malformed(f"{what} must be an object")
    if extra := [k for k in j if k not in known]:
        raise Malformed(f"{what}: unknown key {extra[0]!r}")
    return {k: v for k, v in j.items() if v is not None}


def name_of(v: Any, what: str) -> str:
    if not isinstance(v, str) or not NAME.fullmatch(v):
        raise Malformed(f"{what}: {v!r} is no name")
    return v


def _list(v: Any, what: str) -> list:
    if not isinstance(v, list):
        raise Malformed(f"{what} must be a list")
    return v


@dataclass(frozen=True)
class Aggregate:
    fn: str
    alias: str
    field: str | None = None

    @classmethod
    def from_json(cls, j: Any) -> Aggregate:
        d = fields_of(j, "aggregate", ("field", "fn", "as"))
        if d.get("fn") not in FUNCTIONS:
            raise Malformed(f"aggregate: no function {d.get('fn')!r}")
        return cls(d["fn"], name_of(d.get("as"), "aggregate.as"), name_of(d["field"], "aggregate.field") if "field" in d else None)

    def result(self, t: Type | None) -> Type | None:
        """Type of the result, or None where the function doesn't apply."""
        if self.fn == "count":
            return INT64
        if self.fn in ("min", "max"):
            return None if t.is_list else t
        if not t.is_number:
            return None
        return FLOAT64 if self.fn == "avg" else Type("decimal", 38, t.scale) if t.kind == "decimal" else t


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False
    nulls_first: bool = False
    locale: str | None = None

    @classmethod
    def from_json(cls, j: Any) -> Sort:
        d = fields_of(j, "sort", ("field", "direction", "nulls", "collation"))
        direction, nulls, collation = d.get("direction", "asc"), d.get("nulls", "last"), d.get("collation", "binary")
        if direction not in ("asc", "desc") or nulls not in ("first", "last") or not isinstance(collation, str):
            raise Malformed("sort: no such direction, null placement or collation")
        if collation != "binary" and not _LOCALE.fullmatch(collation) and collation != "und":
            raise Malformed(f"sort: no locale {collation!r}")
        return cls(name_of(d.get("field"), "sort.field"), direction == "desc", nulls == "first", None if collation == "binary" else collation)


@dataclass(frozen=True)
class Tree:
    key: str
    parent: str
    under: Any = None
    scope: Any = None
    aggregate: tuple[Aggregate, ...] = ()
    flat: bool = False

    @classmethod
    def from_json(cls, j: Any) -> Tree:
        d = fields_of(j, "tree", ("key", "parent", "under", "scope", "aggregate", "flat"))
        if not isinstance(d.get("flat", False), bool):
            raise Malformed("tree.flat must be true or false")
        return cls(name_of(d.get("key", "id"), "tree.key"), name_of(d.get("parent"), "tree.parent"), d.get("under"), d.get("scope"), tuple(map(Aggregate.from_json, _list(d.get("aggregate", []), "tree.aggregate"))), d.get("flat", False))


@dataclass(frozen=True)
class Query:
    source: str
    select: tuple[str, ...] = ()
    filter: Any = None
    group: tuple[str, ...] = ()
    aggregate: tuple[Aggregate, ...] = ()
    sort: tuple[Sort, ...] = ()
    offset: int | None = None
    limit: int | None = None
    tree: Tree | None = None

    @classmethod
    def from_json(cls, j: Any) -> Query:
        d = fields_of(j, "query", ("source", "select", "filter", "group", "aggregate", "sort", "offset", "limit", "tree"))
        for k in ("offset", "limit"):
            if k in d and (not isinstance(d[k], int) or isinstance(d[k], bool) or d[k] < 0):
                raise Malformed(f"{k} must be a whole number")
        names = lambda k: tuple(name_of(x, k) for x in _list(d.get(k, []), k))
        check_shape(d.get("filter"))
        return cls(name_of(d.get("source"), "source"), names("select"), d.get("filter"), names("group"), tuple(map(Aggregate.from_json, _list(d.get("aggregate", []), "aggregate"))), tuple(map(Sort.from_json, _list(d.get("sort", []), "sort"))), d.get("offset"), d.get("limit"), Tree.from_json(d["tree"]) if "tree" in d else None)


def check_shape(f: Any) -> None:
    """Whether f is written as a filter; what it names is checked against a schema later."""
    if f is None:
        return
    if not isinstance(f, dict):
        raise Malformed("a filter must be an object")
    for k in ("and", "or"):
        if k in f:
            fields_of(f, "filter", (k,))
            for x in _list(f[k], k):
                if x is None:
                    raise Malformed("a filter must be an object")
                check_shape(x)
            return
    if "not" in f:
        fields_of(f, "filter", ("not",))
        if f["not"] is None:
            raise Malformed("a filter must be an object")
        check_shape(f["not"])
        return
    fields_of(f, "filter", ("field", "op", "value"))
    name_of(f.get("field"), "filter.field")
    op = f.get("op")
    if op not in (*ORDERED, *TEXT, *UNARY, *LIST_ONLY, "in"):
        raise Malformed(f"filter: no operator {op!r}")
    if (op in UNARY) == ("value" in f):
        raise Malformed(f"filter: {op} takes {'no' if op in UNARY else 'a'} value")


def depth(f: Any) -> int:
    for k in ("and", "or"):
        if k in f:
            return 1 + max(map(depth, f[k]), default=0)
    return 1 + depth(f["not"]) if "not" in f else 1


@dataclass
class Valid:
    """A query that a schema accepts."""

    query: Query
    output: list[Field]
    filter: Any = None  # with read literals
    scope: Any = None
    under: Any = None
    tree_output: list[Field] = field(default_factory=list)


def check_filter(f: Any, schema: Schema, limits: Limits, path: str) -> Any:
    """The filter as nested tuples with typed literals: (op, ...)."""

    def long(n: int, at: str) -> None:
        if n > limits.max_list_values:
            raise Invalid(f"{n} entries; {limits.max_list_values} at most", "ListTooLong", at)

    for k in ("and", "or"):
        if k in f:
            long(len(f[k]), f"{path}.{k}")
            return (k, *(check_filter(x, schema, limits, f"{path}.{k}[{i}]") for i, x in enumerate(f[k])))
    if "not" in f:
        return ("not", check_filter(f["not"], schema, limits, f"{path}.not"))
    name, op = f["field"], f["op"]
    found = schema.field(name)
    if found is None:
        raise Invalid(f"no field {name}", "UnknownField", f"{path}.field")
    t = found.type
    if op in ("is_null", "is_not_null"):
        return (op, found)
    if (op in LIST_ONLY) != t.is_list or op in TEXT and t != UTF8:
        raise Invalid(f"{op} doesn't apply to {t.sql}", "OperatorNotSupported", f"{path}.op")
    if op == "is_empty":
        return (op, found)
    value, at = f["value"], f"{path}.value"
    element = {"list<utf8>": UTF8, "list<int64>": INT64}.get(t.kind, t)
    if op in ("in", "has_all"):
        if not isinstance(value, list):
            raise Invalid("a list is expected", "ListExpected", at)
        long(len(value), at)
        for i, x in enumerate(value):
            if x is None:
                raise Invalid("null in a list", "NullInList", f"{at}[{i}]")
        return (op, found, [literal(x, element, f"{at}[{i}]") for i, x in enumerate(value)])
    return (op, found, literal(value, element, at))


def check_aggregates(aggregates: tuple[Aggregate, ...], schema: Schema, path: str) -> list[Field]:
    out: list[Field] = []
    for i, a in enumerate(aggregates):
        t = None
        if a.field is not None:
            if schema.field(a.field) is None:
                raise Invalid(f"no field {a.field}", "UnknownField", f"{path}[{i}].field")
            t = schema.field(a.field).type
        elif a.fn != "count":
            raise Invalid(f"{a.fn} needs a field", "AggregateFieldRequired", f"{path}[{i}].fn")
        result = a.result(t)
        if result is None:
            raise Invalid(f"{a.fn} doesn't apply to {t.sql}", "AggregateTypeMismatch", f"{path}[{i}].fn")
        if schema.field(a.alias):
            raise Invalid(f"{a.alias} is a field", "AliasConflictsWithField", f"{path}[{i}].as")
        if any(f.name == a.alias for f in out):
            raise Invalid(f"{a.alias} twice", "DuplicateAlias", f"{path}[{i}].as")
        out.append(Field(a.alias, result, a.fn != "count"))
    return out


def _output(q: Query, schema: Schema, aliases: list[Field]) -> list[Field]:
    plain = lambda n: Field(n, schema.field(n).type, schema.field(n).nullable)
    out: list[Field] = []
    by_alias = {f.name: f for f in aliases}
    for i, n in enumerate(q.select):
        if q.group or q.aggregate:
            if n in q.group:
                out.append(plain(n))
            elif n in by_alias:
                out.append(by_alias[n])
            else:
                raise Invalid(f"{n} is neither a group key nor an aggregate", "SelectNotGrouped", f"select[{i}]")
        elif schema.field(n) is None:
            raise Invalid(f"no field {n}", "UnknownField", f"select[{i}]")
        else:
            out.append(plain(n))
    out += [f for f in aliases if f.name not in q.select]
    if not out:
        raise Invalid("no columns", "EmptyProjection")
    for j, f in enumerate(out):
        if any(g.name == f.name for g in out[:j]):
            raise Invalid(f"{f.name} twice", "DuplicateOutputColumn", f"select[{j}]")
    return out


def validate(q: Query, schema: Schema, limits: Limits = Limits()) -> Valid:
    """The order of the checks is part of the contract: it decides which error a query with several gets."""
    if q.filter is not None and (d := depth(q.filter)) > limits.max_depth:
        raise Invalid(f"nested {d} deep; {limits.max_depth} at most", "FilterTooDeep")
    for i, n in enumerate(q.group):
        if schema.field(n) is None:
            raise Invalid(f"no field {n}", "UnknownField", f"group[{i}]")
        if schema.field(n).type.is_list:
            raise Invalid(f"{n} is a list", "ListNotOrdered", f"group[{i}]")
    output = _output(q, schema, check_aggregates(q.aggregate, schema, "aggregate"))
    by_name = {f.name: f for f in output}
    for i, s in enumerate(q.sort):
        if s.field not in by_name:
            raise Invalid(f"no output column {s.field}", "SortUnknownColumn", f"sort[{i}].field")
        if by_name[s.field].type.is_list:
            raise Invalid(f"{s.field} is a list", "ListNotOrdered", f"sort[{i}].field")
        if s.locale and by_name[s.field].type != UTF8:
            raise Invalid(f"{s.field} is no text", "CollationNotText", f"sort[{i}].collation")
    if q.offset is not None and not q.sort:
        raise Invalid("an offset needs a sort", "OffsetWithoutSort")
    if q.offset is not None and q.offset >= 2**63:
        raise Invalid("the offset is too large", "OffsetTooLarge")
    if q.limit is not None and q.limit > limits.max_limit:
        raise Invalid(f"limit {q.limit}; {limits.max_limit} at most", "LimitTooLarge")
    valid = Valid(q, output, None if q.filter is None else check_filter(q.filter, schema, limits, "filter"))
    if (t := q.tree) is not None:
        if q.group or q.aggregate:
            raise Invalid("a tree has no groups", "TreeWithGroup")
        for n, at in ((t.key, "tree.key"), (t.parent, "tree.parent")):
            if schema.field(n) is None:
                raise Invalid(f"no field {n}", "UnknownField", at)
        key = schema.field(t.key).type
        if key != schema.field(t.parent).type:
            raise Invalid("key and parent differ in type", "TreeParentTypeMismatch")
        valid.tree_output = check_aggregates(t.aggregate, schema, "tree.aggregate")
        if t.flat:
            if t.under is not None:
                raise Invalid("a flat tree is the whole tree", "TreeFlatWithUnder")
            if t.aggregate:
                raise Invalid("a flat tree has no aggregates", "TreeFlatWithAggregate")
            for n in FLAT_COLUMNS[: 3 if q.filter is not None else 2]:
                if schema.field(n):
                    raise Invalid(f"the flat tree adds a column {n}", "TreeFlatColumnTaken")
        valid.under = literal(t.under, key, "tree.under")
        if t.scope is not None:
            check_shape(t.scope)
            valid.scope = check_filter(t.scope, schema, limits, "tree.scope")
    return valid
