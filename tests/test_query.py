"""Reading and validation: shapes, error codes, and which error wins."""

import pytest

from lattice.errors import Invalid, Malformed
from lattice.plans.query import Limits, Query, validate
from lattice.types import Field, Schema, Type, literal

S = Schema([Field("id", Type("int64"), False), Field("name", Type("utf8")), Field("price", Type("decimal", 8, 2)), Field("ok", Type("bool")), Field("day", Type("date")), Field("tags", Type("list<utf8>")), Field("x", Type("float64")), Field("up", Type("int64")), Field("year", Type("int64"), True, "year", "day")])


def code(j, limits=Limits()):
    with pytest.raises(Invalid) as e:
        validate(Query.from_json({"source": "s"} | j), S, limits)
    return e.value.code, e.value.path


def leaf(field, op, *value):
    return {"field": field, "op": op} | ({"value": value[0]} if value else {})


@pytest.mark.parametrize(
    ("j", "expected"),
    [
        ({"select": ["nope"]}, ("UnknownField", "select[0]")),
        ({"select": ["id", "id"]}, ("DuplicateOutputColumn", "select[1]")),
        ({}, ("EmptyProjection", None)),
        ({"select": ["id"], "filter": leaf("id", "contains", "1")}, ("OperatorNotSupported", "filter.op")),
        ({"select": ["id"], "filter": leaf("tags", "eq", "a")}, ("OperatorNotSupported", "filter.op")),
        ({"select": ["id"], "filter": {"and": [leaf("id", "eq", 1), leaf("price", "eq", 1.5)]}}, ("ValueTypeMismatch", "filter.and[1].value")),
        ({"select": ["id"], "filter": leaf("price", "eq", "1.005")}, ("ValueTypeMismatch", "filter.value")),
        ({"select": ["id"], "filter": leaf("day", "eq", "2024-02-30")}, ("ValueTypeMismatch", "filter.value")),
        ({"select": ["id"], "filter": leaf("id", "in", 3)}, ("ListExpected", "filter.value")),
        ({"select": ["id"], "filter": leaf("id", "in", [1, None])}, ("NullInList", "filter.value[1]")),
        ({"select": ["id"], "sort": [{"field": "tags"}]}, ("SortUnknownColumn", "sort[0].field")),
        ({"select": ["tags"], "sort": [{"field": "tags"}]}, ("ListNotOrdered", "sort[0].field")),
        ({"group": ["tags"]}, ("ListNotOrdered", "group[0]")),
        ({"select": ["id"], "group": ["name"]}, ("SelectNotGrouped", "select[0]")),
        ({"aggregate": [{"fn": "sum", "as": "a"}]}, ("AggregateFieldRequired", "aggregate[0].fn")),
        ({"aggregate": [{"fn": "sum", "field": "name", "as": "a"}]}, ("AggregateTypeMismatch", "aggregate[0].fn")),
        ({"aggregate": [{"fn": "min", "field": "tags", "as": "a"}]}, ("AggregateTypeMismatch", "aggregate[0].fn")),
        ({"aggregate": [{"fn": "count", "as": "id"}]}, ("AliasConflictsWithField", "aggregate[0].as")),
        ({"aggregate": [{"fn": "count", "as": "n"}, {"fn": "count", "as": "n"}]}, ("DuplicateAlias", "aggregate[1].as")),
        ({"select": ["id"], "sort": [{"field": "id", "collation": "de"}]}, ("CollationNotText", "sort[0].collation")),
        ({"select": ["id"], "offset": 1}, ("OffsetWithoutSort", None)),
        ({"select": ["id"], "limit": 10_001}, ("LimitTooLarge", None)),
        ({"select": ["id"], "sort": [{"field": "id"}], "offset": 2**63}, ("OffsetTooLarge", None)),
        ({"select": ["id"], "tree": {"parent": "up"}, "group": ["id"]}, ("TreeWithGroup", None)),
        ({"select": ["id"], "tree": {"parent": "name"}}, ("TreeParentTypeMismatch", None)),
        ({"select": ["id"], "tree": {"parent": "up", "flat": True, "under": 1}}, ("TreeFlatWithUnder", None)),
        ({"select": ["id"], "tree": {"parent": "up", "flat": True, "aggregate": [{"fn": "count", "as": "n"}]}}, ("TreeFlatWithAggregate", None)),
        # the first check wins
        ({"select": ["nope"], "group": ["gone"], "filter": leaf("also", "is_null")}, ("UnknownField", "group[0]")),
        ({"select": ["id"], "limit": 99_999, "filter": leaf("gone", "is_null")}, ("LimitTooLarge", None)),
    ],
)
def test_codes(j, expected):
    assert code(j) == expected


def test_limits():
    deep = leaf("id", "is_null")
    for _ in range(8):
        deep = {"not": deep}
    assert code({"select": ["id"], "filter": deep})[0] == "FilterTooDeep"
    assert code({"select": ["id"], "filter": leaf("id", "in", list(range(1001)))}) == ("ListTooLong", "filter.value")


@pytest.mark.parametrize("j", [{"source": "s", "extra": 1}, {"source": 3}, {"source": "s", "limit": -1}, {"source": "s", "filter": {"and": [None]}}, {"source": "s", "filter": leaf("id", "like", "x")}, {"source": "s", "filter": leaf("id", "is_null", 1)}, {"source": "s", "filter": leaf("id", "eq")}, {"source": "s", "select": "id"}, {"source": "s", "sort": [{"field": "a", "direction": "up"}]}, {"source": "s", "sort": [{"field": "a", "collation": "german"}]}, []])
def test_malformed(j):
    with pytest.raises(Malformed):
        Query.from_json(j)


def test_types_of_results():
    q = Query.from_json({"source": "s", "aggregate": [{"fn": f, "field": "price", "as": f} for f in ("count", "sum", "avg", "min")]})
    assert [(f.type.sql, f.nullable) for f in validate(q, S).output] == [("bigint", False), ("decimal(38,2)", True), ("double", True), ("decimal(8,2)", True)]


def test_literals():
    assert literal(3, Type("decimal", 4, 1), "") == 3 and literal("NaN", Type("float64"), "") != literal("NaN", Type("float64"), "")
    for bad, t in (("123456.7", Type("decimal", 5, 1)), (True, Type("int64")), (2**63, Type("int64")), ("2024-01-01 00:00:00", Type("timestamp")), (1, Type("utf8"))):
        with pytest.raises(Invalid):
            literal(bad, t, "")


def test_schema_round_trip():
    assert Schema.from_json(S.to_json()).to_json() == S.to_json()
    with pytest.raises(Malformed):
        Schema([Field("y", Type("int64"), True, "year", "missing")])
