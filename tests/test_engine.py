"""The engine on small data of its own: corners of null, NaN, order, pivots, trees, policies, files."""

import pytest
from pyspark.sql import functions as F

from lattice.engine import Engine
from lattice.errors import DataError, Invalid, LatticeError, LimitExceeded, UnknownSource
from lattice.operators.pivot import PivotLimits, PivotQuery, drill_down
from lattice.plans import builders
from lattice.policy import Policy
from lattice.sources import export, ingest
from lattice.types import Field, Schema, Type

T = {k: Type(k) for k in ("int64", "utf8", "float64", "bool", "date", "timestamp", "list<utf8>")}
ORDERS = Schema([Field("id", T["int64"], False), Field("who", T["utf8"]), Field("amount", Type("decimal", 12, 2)), Field("qty", T["int64"]), Field("ratio", T["float64"]), Field("flag", T["bool"]), Field("at", T["timestamp"]), Field("tags", T["list<utf8>"]), Field("year", T["int64"], True, "year", "at")])
ROWS = [
    {"id": 1, "who": "a", "amount": "1.10", "qty": 1, "ratio": "NaN", "flag": True, "at": "2025-12-31T23:59:59.999999Z", "tags": ["x", "y"]},
    {"id": 2, "who": "", "amount": "2.20", "qty": None, "ratio": 0.5, "flag": False, "at": "2026-01-01T00:00:00Z", "tags": []},
    {"id": 3, "who": None, "amount": None, "qty": 3, "ratio": None, "flag": None, "at": None, "tags": None},
    {"id": 4, "who": "ä", "amount": "-12345.67", "qty": 4, "ratio": "-Infinity", "flag": True, "at": "2026-05-01T10:00:00.500000Z", "tags": ["x,\"", "x"]},
    {"id": 5, "who": "z", "amount": "999999999.99", "qty": 5, "ratio": -0.0, "flag": True, "at": "2026-05-01T10:00:00Z", "tags": ["y"]},
    {"id": 6, "who": "a", "amount": "0.00", "qty": 6, "ratio": 2.0, "flag": False, "at": "2025-06-01T00:00:00Z", "tags": ["x"]},
]


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark, count_ttl=60)
    e.register("orders", ingest.from_rows(spark, ROWS, ORDERS), ORDERS, ("id",))
    tree = spark.createDataFrame([(1, None, "root", 5), (2, 1, "b", 7), (3, 1, "a", None), (4, 2, "leaf", 1), (5, 99, "orphan", 2), (6, 4, "deep", 3)], "id long, parent_id long, name string, revenue long")
    e.register("tree", tree, unique=("id",))
    return e


def ids(engine, f, **more):
    return sorted(r[0] for r in engine.execute({"source": "orders", "select": ["id"], "filter": f} | more).df.collect())


def leaf(field, op, *value):
    return {"field": field, "op": op} | ({"value": value[0]} if value else {})


@pytest.mark.parametrize(
    ("f", "expected"),
    [
        (leaf("who", "ne", "a"), [2, 4, 5]),
        ({"not": leaf("who", "eq", "a")}, [2, 4, 5]),
        (leaf("who", "in", []), []),
        ({"not": leaf("who", "in", [])}, [1, 2, 3, 4, 5, 6]),
        (leaf("who", "eq", None), []),
        (leaf("ratio", "eq", "NaN"), [1]),
        (leaf("ratio", "gt", 1.0), [1, 6]),
        (leaf("ratio", "eq", 0.0), [5]),
        (leaf("tags", "has", "x"), [1, 4, 6]),
        (leaf("tags", "has_all", ["x", "y"]), [1]),
        (leaf("tags", "has_all", []), [1, 2, 4, 5, 6]),
        (leaf("tags", "is_empty"), [2]),
        ({"not": leaf("tags", "is_empty")}, [1, 3, 4, 5, 6]),
        (leaf("year", "eq", 2025), [1, 6]),
        (leaf("at", "lt", "2026-01-01T00:00:00Z"), [1, 6]),
        (leaf("flag", "lt", True), [2, 6]),
        (leaf("who", "icontains", "Ä"), [4]),
        ({"and": []}, [1, 2, 3, 4, 5, 6]),
        ({"or": []}, []),
    ],
)
def test_filters(engine, f, expected):
    assert ids(engine, f) == expected


def test_groups_and_result_types(engine):
    r = engine.execute({"source": "orders", "select": ["who"], "group": ["who"], "aggregate": [{"fn": "sum", "field": "amount", "as": "total"}, {"fn": "avg", "field": "amount", "as": "mean"}, {"fn": "count", "field": "qty", "as": "n"}], "sort": [{"field": "who", "nulls": "first"}]})
    rows = r.df.collect()
    assert [x.who for x in rows] == [None, "", "a", "z", "ä"] and r.total_count == 5 and r.total_count == 5
    assert str(rows[2].total) == "1.10" and rows[2].mean == pytest.approx(0.55) and rows[2].n == 2
    assert dict(r.df.dtypes) == {"who": "string", "total": "decimal(38,2)", "mean": "double", "n": "bigint"}
    locale = engine.execute({"source": "orders", "select": ["who"], "filter": leaf("who", "is_not_null"), "sort": [{"field": "who", "collation": "de"}]}).df.collect()
    assert [x.who for x in locale] == ["", "a", "a", "ä", "z"]


def test_sum_overflow_is_an_error(spark):
    e = Engine(spark)
    e.register("big", spark.createDataFrame([(2**62,), (2**62,)], "v long"))
    with pytest.raises(Exception, match="OVERFLOW"):
        e.execute({"source": "big", "aggregate": [{"fn": "sum", "field": "v", "as": "s"}]}).df.collect()


def test_pages_counts_and_global_aggregates(engine):
    r = engine.execute({"source": "orders", "select": ["id"], "sort": [{"field": "id", "direction": "desc"}], "offset": 2, "limit": 2})
    assert [x.id for x in r.df.collect()] == [4, 3] and r.total_count == 6
    none = engine.execute({"source": "orders", "filter": {"or": []}, "aggregate": [{"fn": "count", "as": "n"}, {"fn": "max", "field": "qty", "as": "m"}]})
    assert [tuple(x) for x in none.df.collect()] == [(0, None)] and none.total_count == 1
    assert engine.execute({"source": "orders", "select": ["who"], "group": ["who"], "filter": {"or": []}}).df.count() == 0
    with pytest.raises(UnknownSource):
        engine.execute({"source": "nothing", "select": ["id"]})


def test_pivot_levels_order_and_calculations(engine):
    p = {"source": "orders", "rows": ["flag", "who"], "columns": ["year"], "values": [{"fn": "count", "as": "n"}, {"fn": "sum", "field": "qty", "as": "q", "calc": "running_total"}], "sort": [{"field": "flag", "by": "n", "direction": "desc"}]}
    r = engine.pivot(p)
    assert [c["path"] for c in r.columns if c["measure"] == "n"] == [[2025], [2026], [None]]
    rows = [tuple(x) for x in r.df.collect()]
    assert rows[0] == (True, "a", 1, 1, 0, 1, 0, 1, 2) and rows[3] == (True, None, 1, 1, 2, 10, 0, 10, 1)
    assert [x[0] for x in rows] == [True, True, True, True, False, False, False, None, None, None] and rows[-1][-1] == 0
    drilled = drill_down(PivotQuery.from_json(p), {"flag": None, "who": None}, [None], 2)
    assert ids(engine, drilled["filter"]) == [3]
    shares = engine.pivot({"source": "orders", "rows": [], "columns": ["flag"], "values": [{"fn": "count", "as": "n", "calc": "share_of_row"}]}).df.collect()
    assert [tuple(x) for x in shares] == [(pytest.approx(2 / 6), pytest.approx(3 / 6), pytest.approx(1 / 6), 0)]
    assert engine.pivot({"source": "orders", "values": [{"fn": "count", "as": "n"}]}).df.collect()[0].n_0 == 6


def test_pivot_limits_and_errors(spark, engine):
    small = Engine(spark, pivot_limits=PivotLimits(max_columns=2))
    small.register("orders", engine.sources["orders"].df, ORDERS)
    with pytest.raises(LimitExceeded):
        small.pivot({"source": "orders", "columns": ["id"], "values": [{"fn": "count", "as": "n"}]})
    for values, why in (([], "NoMeasures"), ([{"fn": "max", "field": "qty", "as": "m", "calc": "share_of_row"}], "Calc"), ([{"fn": "min", "field": "who", "as": "m", "calc": "running_total"}], "Calc")):
        with pytest.raises(Invalid) as e:
            engine.pivot({"source": "orders", "rows": ["flag"], "values": values})
        assert e.value.code == why


def _tree(engine, **q):
    return engine.execute({"source": "tree", "select": ["id"], "tree": {"parent": "parent_id"} | q.pop("tree", {})} | q)


def test_tree_levels_context_and_aggregates(engine):
    r = _tree(engine, sort=[], tree={"aggregate": [{"fn": "sum", "field": "revenue", "as": "total"}, {"fn": "count", "as": "n"}]})
    assert [tuple(x) for x in r.df.collect()] == [(1, 2, True), (5, 0, True)] and r.tree.orphans == 1
    assert sorted(map(tuple, r.tree.aggregates.collect())) == [(1, 16, 5), (5, 2, 1)]
    f = _tree(engine, filter=leaf("name", "eq", "deep"), tree={"under": 1})
    assert [tuple(x) for x in f.df.collect()] == [(2, 1, False)] and f.tree.matches == 1
    assert _tree(engine, tree={"under": 77}).df.count() == 0
    scoped = _tree(engine, tree={"scope": leaf("id", "gt", 1)})
    assert [x.id for x in scoped.df.collect()] == [2, 3, 5] and scoped.tree.orphans == 3


def test_flat_tree(engine):
    r = _tree(engine, select=["id", "name"], sort=[{"field": "name", "direction": "desc"}], tree={"flat": True})
    assert [(x.id, x.level, x.path) for x in r.df.collect()] == [(1, 0, ["1"]), (2, 1, ["1", "2"]), (4, 2, ["1", "2", "4"]), (6, 3, ["1", "2", "4", "6"]), (3, 1, ["1", "3"]), (5, 0, ["5"])]
    f = _tree(engine, filter=leaf("id", "eq", 3), tree={"flat": True})
    assert [(x.id, x.match) for x in f.df.collect()] == [(1, False), (3, True)] and f.total_count == 2


def test_broken_trees(spark):
    e = Engine(spark)
    e.register("loop", spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, None)], "id long, parent_id long"))
    with pytest.raises(DataError, match="cycle"):
        e.execute({"source": "loop", "select": ["id"], "tree": {"parent": "parent_id"}})
    e.register("twice", spark.createDataFrame([(1, None), (1, None)], "id long, parent_id long"))
    with pytest.raises(DataError, match="unique"):
        e.execute({"source": "twice", "select": ["id"], "tree": {"parent": "parent_id"}})


def test_policy(spark, engine):
    e = Engine(spark)
    df = engine.sources["orders"].df
    e.register("orders", df, ORDERS, ("id",), Policy(("id", "flag", "year"), leaf("who", "eq", {"context": "who"}), {"who": "a"}))
    assert sorted(r.id for r in e.execute({"source": "orders", "select": ["id"]}).df.collect()) == [1, 6]
    with pytest.raises(Invalid) as hidden:
        e.execute({"source": "orders", "select": ["amount"]})
    assert hidden.value.code == "UnknownField"
    with pytest.raises(LatticeError):
        e.register("orders", df, ORDERS, (), Policy(None, leaf("who", "eq", {"context": "who"}), {}))
    assert e.pivot({"source": "orders", "values": [{"fn": "count", "as": "n"}]}).df.first().n_0 == 2


def test_counts_are_remembered_until_told(spark):
    e = Engine(spark, count_ttl=1000)
    q = {"source": "t", "select": ["id"], "sort": [{"field": "id"}], "limit": 1}
    e.register("t", spark.range(5))
    assert e.execute(q).total_count == 5
    e.sources["t"].df = spark.range(7)
    assert e.execute(q).total_count == 5
    e.notify_changed("t")
    assert e.execute(q).total_count == 7


def test_csv_and_json_files(spark, tmp_path):
    schema = Schema([Field("id", T["int64"], False), Field("who", T["utf8"]), Field("amount", Type("decimal", 5, 2)), Field("day", T["date"])])
    (tmp_path / "a.csv").write_text('id,who,amount,day\n1," a ""b""\nc",1.10,2024-02-29\n2,,\\N,\\N\n3,\\N,-0.5,2024-01-01\n')
    rows = [tuple(r) for r in ingest.read_csv(spark, str(tmp_path / "a.csv"), schema).orderBy("id").collect()]
    assert rows[0][1] == ' a "b"\nc' and str(rows[0][2]) == "1.10" and rows[1][1:] == ("", None, None) and rows[2][1] is None
    for bad in ("id,who,amount,day\n1,a,1.005,\\N\n", "id,who,amount,day\nx,a,1,\\N\n", "id,who,amount,day\n1,a,1,2024-02-30\n", "id,amount,who,day\n", "id,who,amount,day\n\\N,a,1,\\N\n"):
        (tmp_path / "b.csv").write_text(bad)
        with pytest.raises(DataError):
            ingest.read_csv(spark, str(tmp_path / "b.csv"), schema)
    (tmp_path / "a.json").write_text('[{"id": 1, "who": "x", "amount": "2.50"}, {"id": 2}]')
    assert [(r.id, r.who, r.day) for r in ingest.read_json(spark, str(tmp_path / "a.json"), schema).orderBy("id").collect()] == [(1, "x", None), (2, None, None)]
    (tmp_path / "b.json").write_text('[{"id": 1, "other": 2}]')
    with pytest.raises(DataError):
        ingest.read_json(spark, str(tmp_path / "b.json"), schema)
    text = spark.createDataFrame([("1", "true", "2024-01-01", "x", None), ("2.5", "false", "2024-01-02", None, None)], "a string, b string, c string, d string, e string")
    assert [f.type.kind for f in ingest.infer(text).fields] == ["float64", "bool", "date", "utf8", "utf8"]


def test_exports(engine):
    df = engine.sources["orders"].df.orderBy("id")
    lines = [r.line for r in export.csv_lines(df.select("id", "who", "amount", "at", "tags")).collect()]
    assert lines[0] == '1,a,1.10,2025-12-31T23:59:59.999999Z,"[""x"",""y""]"' and lines[1].startswith('2,"",2.20,2026-01-01T00:00:00Z') and lines[2] == "3,,,,"
    guarded = df.limit(1).select(F.lit("=1+1").alias("f"), F.lit("a,b").alias("g"))
    assert [r.line for r in export.csv_lines(guarded).collect()] == ["'=1+1,\"a,b\""]
    assert export.csv_header(["a", "b;c"], export.CsvFormat(bom=False)) == 'a,"b;c"\r\n'
    rows = [r.line for r in export.json_rows(df.select("id", "amount", "ratio", "tags")).collect()]
    assert rows[0] == '{"id":1,"amount":"1.10","ratio":"NaN","tags":["x","y"]}' and rows[2] == '{"id":3,"amount":null,"ratio":null,"tags":null}'
    wire = export.to_wire(df.select("id", "ratio", "at"), 6)
    assert wire["row_count"] == 6 and wire["columns"][1]["values"][:2] == ["NaN", 0.5] and wire["columns"][2]["values"][3] == "2026-05-01T10:00:00.5Z"


def test_grid_queries(engine):
    q = builders.facet_counts("orders", "who", {"who": builders.facet_filter("who", ["a"]), "qty": builders.facet_filter("qty", low=3)})
    assert {r.who: r.og_rows for r in engine.execute(q).df.collect()} == {None: 1, "a": 1, "z": 1, "ä": 1}
    assert ids(engine, builders.free_text(ORDERS, "Z")) == [5] and builders.free_text(ORDERS, "  ") is None
    assert ids(engine, builders.facet_filter("who", ["a", None])) == [1, 3, 6]
    level = builders.group_level("orders", ORDERS, ["flag", "who"], [None], [{"fn": "sum", "field": "qty", "as": "q"}])
    assert [tuple(r) for r in engine.execute(level).df.collect()] == [(None, 1, 3)]


def test_a_stream_drops_counts(spark, tmp_path):
    from lattice.streaming.changes import watch

    e = Engine(spark, count_ttl=1000)
    spark.range(3).write.parquet(str(tmp_path / "data"))
    spark.range(10, 14).write.parquet(str(tmp_path / "new"))
    read = lambda: spark.read.parquet(str(tmp_path / "data"))
    e.register("t", read())
    q = {"source": "t", "select": ["id"], "sort": [{"field": "id"}], "limit": 1}
    assert e.execute(q).total_count == 3
    stream = watch(e, "t", spark.readStream.schema("id long").parquet(str(tmp_path / "new")), str(tmp_path / "cp"), str(tmp_path / "data"))
    stream.processAllAvailable()
    stream.stop()
    e.register("t", read())
    assert e.execute(q).total_count == 7


def test_plans_push_filters_and_prune_columns(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS k", "cast(id as string) AS s").write.parquet(str(tmp_path / "p"))
    e = Engine(spark)
    e.register("p", spark.read.parquet(str(tmp_path / "p")))
    df = e.execute({"source": "p", "select": ["k"], "filter": leaf("id", "gte", 50), "group": ["k"], "aggregate": [{"fn": "count", "as": "n"}]}).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(id,50)" in plan and "ReadSchema: struct<id:bigint,k:bigint>" in plan and "Cartesian" not in plan


def test_trees_are_prepared_once(spark, monkeypatch):
    from lattice import engine as module

    e, calls = Engine(spark), []
    e.register("t", spark.createDataFrame([(1, None), (2, 1), (3, 1)], "id long, parent_id long"))
    prepare = module.prepare
    monkeypatch.setattr(module, "prepare", lambda *a: calls.append(1) or prepare(*a))
    level = lambda under: sorted(map(tuple, e.execute({"source": "t", "select": ["id"], "tree": {"parent": "parent_id", "under": under}}).df.collect()))
    assert level(None) == [(1, 2, True)] and level(1) == [(2, 0, True), (3, 0, True)] and len(calls) == 1
    e.register("t", spark.createDataFrame([(5, None)], "id long, parent_id long"))
    assert level(None) == [(5, 0, True)] and len(calls) == 2


def test_deep_offsets(spark):
    e = Engine(spark)
    e.register("t", spark.range(30_000), unique=("id",))
    q = {"source": "t", "select": ["id"], "sort": [{"field": "id", "direction": "desc"}], "limit": 3}
    assert [r.id for r in e.execute(q | {"offset": 20_000}).df.collect()] == [9_999, 9_998, 9_997]
    assert "TakeOrderedAndProject(limit=2000" not in e.execute(q | {"offset": 20_000}).df._jdf.queryExecution().toString()
    assert e.execute(q | {"offset": 10**12}).df.count() == 0


def test_pivot_sorts_come_from_one_pass(engine):
    p = {"source": "orders", "rows": ["flag", "who"], "columns": ["year"], "values": [{"fn": "sum", "field": "qty", "as": "q"}, {"fn": "min", "field": "ratio", "as": "least"}], "sort": [{"field": "flag", "by": "q", "direction": "desc"}, {"field": "who", "by": "q"}]}
    rows = [(r.flag, r.who) for r in engine.pivot(p).df.collect()]
    assert rows == [(True, "a"), (True, "ä"), (True, "z"), (True, None), (False, "a"), (False, ""), (False, None), (None, None), (None, None), (None, None)]


def test_nan_and_negative_shares(spark):
    e = Engine(spark)
    e.register("t", spark.createDataFrame([("a", "x", 1.0), ("a", "y", -1.0), ("b", "x", float("nan")), ("b", "y", 2.0)], "r string, c string, v double"))
    share = lambda calc, f: [tuple(r) for r in e.pivot({"source": "t", "rows": ["r"], "columns": ["c"], "values": [{"fn": "sum", "field": "v", "as": "s", "calc": calc}], "filter": f}).df.collect()]
    a = leaf("r", "eq", "a")
    assert share("share_of_row", a) == [("a", None, None, 1), (None, None, None, 0)]  # a total of zero has no shares
    assert share("share_of_column", a) == [("a", 1.0, 1.0, 1), (None, 1.0, 1.0, 0)]
    rows = share("share_of_row", {"and": []})
    assert rows[1][1] != rows[1][1] and rows[1][2] != rows[1][2]  # NaN


def test_least_and_greatest_under_two_columns(engine):
    r = engine.pivot({"source": "orders", "columns": ["flag", "year"], "values": [{"fn": "min", "field": "amount", "as": "lo"}, {"fn": "max", "field": "who", "as": "hi"}]})
    assert [c["path"] for c in r.columns if c["measure"] == "lo"] == [[False, 2025], [False, 2026], [True, 2025], [True, 2026], [None, None]]
    row = r.df.first()
    assert (str(row.lo_0), row.hi_0, str(row.lo_3), row.hi_3, row.lo_4, row.hi_4) == ("0.00", "a", "-12345.67", "ä", None, None)


def test_context_never_crosses_the_scope(engine):
    r = _tree(engine, filter=leaf("name", "eq", "deep"), tree={"scope": leaf("id", "ne", 2)})
    assert [tuple(x) for x in r.df.collect()] == [(4, 1, False)]  # node 2 is out of scope, so 4 is a root there


def test_files_of_results(engine, spark, tmp_path):
    read = lambda p: next((tmp_path / p).glob("part-*")).read_bytes().decode()
    df = engine.sources["orders"].df
    assert export.write_csv(df.select("id", "who"), str(tmp_path / "c"), order=[F.col("id").desc()]) == 6
    assert read("c") == "\ufeffid,who\r\n6,a\r\n5,z\r\n4,ä\r\n3,\r\n2,\"\"\r\n1,a\r\n"
    export.write_json(df.select("id", "amount"), str(tmp_path / "j"), order=[F.col("id")])
    import json

    assert json.loads(read("j"))[:2] == [{"id": 1, "amount": "1.10"}, {"id": 2, "amount": "2.20"}]
    export.write_json(df.select("id").limit(0), str(tmp_path / "e"))
    assert json.loads(read("e")) == []
    p = engine.pivot({"source": "orders", "rows": ["flag", "who"], "columns": ["year"], "values": [{"fn": "count", "as": "n", "calc": "share_of_total"}], "filter": leaf("flag", "eq", False)})
    export.write_pivot_csv(p, str(tmp_path / "p"), export.CsvFormat(bom=False))
    assert read("p").split("\r\n") == ["flag,who,2025 · n · share of total,2026 · n · share of total", "false,(empty),0.0,0.5", "false,a,0.5,0.0", "Total false,,0.5,0.5", "Total,,0.5,0.5", ""]
    wire = export.pivot_to_wire(p)
    assert wire["levels"] == [2, 2, 1, 0] and wire["row_dimensions"] == ["flag", "who"] and [c["name"] for c in wire["result"]["columns"]] == ["flag", "who", "n_0", "n_1"]
    for write in (lambda: export.to_wire(df, 6, at_most=5), lambda: export.write_csv(df, str(tmp_path / "x"), at_most=5)):
        with pytest.raises(LimitExceeded):
            write()


def test_typed_filters():
    f, wrong = builders.filter_row(ORDERS, [("qty", "gt", "x"), ("amount", "gte", "1.5"), ("flag", "eq", "maybe")])
    assert f is None and wrong == [("qty", "x"), ("flag", "maybe")]
    assert builders.filter_row(ORDERS, [("tags", "has_all", "x, y,"), ("flag", "eq", "1"), ("who", "eq", " ")])[0] == {"and": [leaf("tags", "has_all", ["x", "y"]), leaf("flag", "eq", True)]}
    assert builders.filter_row(ORDERS, []) == (None, [])
    one = leaf("qty", "gt", 1)
    assert builders.group("or", [{"or": [one, one]}, None, {"and": [one]}]) == {"or": [one, one, {"and": [one]}]} and builders.group("and", [one]) == one
    builders.check_tree(ORDERS, {"or": [one, {"and": [one]}]})
    for bad in ({"and": []}, {"not": one}, leaf("qty", "in", [1]), leaf("none", "eq", 1)):
        with pytest.raises(Invalid):
            builders.check_tree(ORDERS, {"or": [bad]})
