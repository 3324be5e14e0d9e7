"""The registered queries of the engine: each operator over whole tables, with the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattice.engine import Engine
from lattice.operators.tree import TreeResult, run_tree
from lattice.plans import builders
from lattice.plans.query import Query, validate
from lattice.policy import Policy
from lattice.runtime import with_rank
from lattice.sources import export
from lattice.types import Field, Schema, Type

_MONEY = Type("decimal", 12, 2)
_T = {"i": Type("int64"), "s": Type("utf8"), "m": _MONEY, "t": Type("timestamp"), "f": Type("float64"), "l": Type("list<utf8>"), "b": Type("bool")}


def _schema(spec: str, *derived: Field) -> Schema:
    return Schema([*(Field(n, _T[k]) for n, _, k in (x.partition(":")[::1] for x in spec.split())), *derived])


#: Sources: schema, unique key, the DataFrame from the tables, and the same in SQL.
_LINEITEM = _schema("l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:m l_extendedprice:m l_discount:m l_tax:m l_returnflag:s l_linestatus:s l_shipdate:t", Field("l_year", _T["i"], True, "year", "l_shipdate"), Field("l_month", _T["i"], True, "month", "l_shipdate"))
_ORDERS = _schema("o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:m o_orderdate:t o_orderpriority:s", Field("o_year", _T["i"], True, "year", "o_orderdate"), Field("o_month", _T["i"], True, "month", "o_orderdate"))
_EVENTS = _schema("event_id:i user_id:i event_type:s value:f note:s score:i ratio:f flag:b")
_PARTS = _schema("p_partkey:i p_name:s p_brand:s p_size:i tags:l")
_NODES = _schema("id:s parent:s name:s segment:s amount:m")

_SQL = {
    "lineitem": """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber::BIGINT AS l_linenumber, l_quantity::DECIMAL(12,2) AS l_quantity,
        l_extendedprice::DECIMAL(12,2) AS l_extendedprice, l_discount::DECIMAL(12,2) AS l_discount, l_tax::DECIMAL(12,2) AS l_tax, l_returnflag, l_linestatus,
        l_shipdate, year(l_shipdate) AS l_year, month(l_shipdate) AS l_month FROM lineitem""",
    "orders": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice::DECIMAL(12,2) AS o_totalprice, o_orderdate, o_orderpriority,
        year(o_orderdate) AS o_year, month(o_orderdate) AS o_month FROM orders""",
    "events": """SELECT event_id, user_id, event_type, value,
        CASE user_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE upper(substr(event_type, 1, 1)) || substr(event_type, 2) END AS note,
        CASE WHEN user_id % 5 <> 0 THEN user_id * 10 END AS score,
        CASE user_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'NaN'::DOUBLE ELSE value END AS ratio,
        CASE WHEN user_id % 13 <> 0 THEN value > 50 END AS flag FROM events""",
    "parts": """SELECT p_partkey, p_name, p_brand, p_size::BIGINT AS p_size,
        CASE p_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN []::VARCHAR[] ELSE string_split(p_name, ' ') END AS tags FROM part""",
    "nodes": """SELECT 'r' || r_regionkey AS id, NULL::VARCHAR AS parent, r_name AS name, NULL::VARCHAR AS segment, NULL::DECIMAL(12,2) AS amount FROM region
        UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, NULL, NULL FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_mktsegment, c_acctbal::DECIMAL(12,2) FROM customer""",
}


def _events(t: Callable[[str], DataFrame]) -> DataFrame:
    u, v = F.col("user_id"), F.col("value")
    note = F.when(u % 7 == 0, None).when(u % 7 == 1, "").otherwise(F.concat(F.upper(F.substring("event_type", 1, 1)), F.expr("substring(event_type, 2)")))
    ratio = F.when(u % 11 == 0, None).when(u % 11 == 1, F.lit(float("nan"))).otherwise(v)
    return t("events").select("event_id", "user_id", "event_type", "value", note.alias("note"), F.when(u % 5 != 0, u * 10).alias("score"), ratio.alias("ratio"), F.when(u % 13 != 0, v > 50).alias("flag"))


def _parts(t: Callable[[str], DataFrame]) -> DataFrame:
    k = F.col("p_partkey") % 9
    tags = F.when(k == 0, None).when(k == 1, F.array().cast("array<string>")).otherwise(F.split("p_name", " "))
    return t("part").select("p_partkey", "p_name", "p_brand", "p_size", tags.alias("tags"))


def _nodes(t: Callable[[str], DataFrame]) -> DataFrame:
    none = F.lit(None)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    regions = t("region").select(key("r", "r_regionkey").alias("id"), none.cast("string").alias("parent"), F.col("r_name").alias("name"), none.cast("string").alias("segment"), none.cast("double").alias("amount"))
    nations = t("nation").select(key("n", "n_nationkey"), key("r", "n_regionkey"), "n_name", none.cast("string"), none.cast("double"))
    return regions.union(nations).union(t("customer").select(key("c", "c_custkey"), key("n", "c_nationkey"), "c_name", "c_mktsegment", "c_acctbal"))


_SOURCES = {
    "lineitem": (_LINEITEM, ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), lambda t: t("lineitem")),
    "orders": (_ORDERS, ("o_orderkey",), lambda t: t("orders")),
    "events": (_EVENTS, ("event_id",), _events),
    "parts": (_PARTS, ("p_partkey",), _parts),
    "nodes": (_NODES, ("id",), _nodes),
}


def engine(spark: SparkSession, sf_dir: str, *names: str, **policies: Policy) -> Engine:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    out = Engine(spark)
    for n in names:
        schema, unique, make = _SOURCES[n]
        out.register(n, make(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet")), schema, unique, policies.get(n, Policy()))
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | None] = {}


def _with(source: str, sql: str) -> str:
    return f"WITH s AS ({_SQL[source]}) {sql}"


def _whole(spark: SparkSession, sf_dir: str, q: dict, **policies: Policy) -> DataFrame:
    """The answer without the limit that a request without one is given: all its rows."""
    e = engine(spark, sf_dir, q["source"], **policies)
    from lattice.operators.flat import lower
    from lattice.plans.query import Query, validate

    if "limit" in q:
        return e.execute(q).df
    s = e.sources[q["source"]]
    where = e._where(s)
    from lattice.operators.flat import predicate

    df = s.df if where is None else s.df.where(predicate(where))
    return lower(df, validate(Query.from_json(q), e._client(s), e.limits), s.schema, s.unique)[0]


def _query(name: str, q: dict, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _whole(spark, sf_dir, q)
    ORACLES[name] = None if sql is None else _with(q["source"], sql)


def _filter(name: str, source: str, key: str, f: dict | None, where: str, *more: str) -> None:
    columns = [key, *more]
    _query(f"flt_{name}", {"source": source, "select": columns, "filter": f}, f"SELECT {', '.join(columns)} FROM s WHERE {where}")


def _leaf(field: str, op: str, *value) -> dict:
    return {"field": field, "op": op} | ({"value": value[0]} if value else {})


# Filters.
_filter("and", "events", "event_id", {"and": [_leaf("score", "gte", 100), _leaf("event_type", "eq", "click")]}, "score >= 100 AND event_type = 'click'")
_filter("and_empty", "events", "event_id", {"and": []}, "TRUE")
_filter("or", "events", "event_id", {"or": [_leaf("score", "lt", 50), _leaf("note", "is_null")]}, "score < 50 OR note IS NULL")
_filter("or_empty", "events", "event_id", {"or": []}, "FALSE")
_filter("not", "events", "event_id", {"not": _leaf("score", "gt", 200)}, "NOT (score > 200)")
_filter("eq", "orders", "o_orderkey", _leaf("o_totalprice", "eq", "144449.04"), "o_totalprice = 144449.04")
_filter("ne", "events", "event_id", _leaf("note", "ne", "Click"), "note <> 'Click'")
_filter("lt", "lineitem", "l_orderkey", _leaf("l_quantity", "lt", "5.00"), "l_quantity < 5", "l_linenumber", "l_partkey")
_filter("lte", "events", "event_id", _leaf("flag", "lte", False), "flag <= FALSE")
_filter("gt", "orders", "o_orderkey", _leaf("o_orderdate", "gt", "1998-06-01T00:00:00Z"), "o_orderdate > TIMESTAMP '1998-06-01 00:00:00'")
_filter("gte", "events", "event_id", _leaf("note", "gte", "Purchase"), "note >= 'Purchase'")
_filter("in", "events", "event_id", _leaf("score", "in", [10, 20, 30]), "score IN (10, 20, 30)")
_filter("in_empty", "events", "event_id", {"not": _leaf("score", "in", [])}, "TRUE")
_filter("contains", "parts", "p_partkey", _leaf("p_name", "contains", "ld wi"), "contains(p_name, 'ld wi')")
_filter("starts_with", "parts", "p_partkey", _leaf("p_name", "starts_with", "small"), "starts_with(p_name, 'small')")
_filter("icontains", "events", "event_id", _leaf("note", "icontains", "CLI"), "contains(lower(note), 'cli')")
_filter("istarts_with", "events", "event_id", _leaf("note", "istarts_with", "sI"), "starts_with(lower(note), 'si')")
_filter("is_null", "events", "event_id", _leaf("note", "is_null"), "note IS NULL")
_filter("is_not_null", "events", "event_id", _leaf("score", "is_not_null"), "score IS NOT NULL")
_filter("has", "parts", "p_partkey", _leaf("tags", "has", "widget"), "list_contains(tags, 'widget')")
_filter("has_all", "parts", "p_partkey", _leaf("tags", "has_all", ["red", "widget"]), "list_contains(tags, 'widget') AND list_contains(tags, 'red')")
_filter("has_all_empty", "parts", "p_partkey", _leaf("tags", "has_all", []), "tags IS NOT NULL")
_filter("is_empty", "parts", "p_partkey", _leaf("tags", "is_empty"), "coalesce(len(tags) = 0, FALSE)")
_filter("not_is_empty", "parts", "p_partkey", {"not": _leaf("tags", "is_empty")}, "NOT coalesce(len(tags) = 0, FALSE)")
_filter("float_nan", "events", "event_id", _leaf("ratio", "eq", "NaN"), "isnan(ratio)")
_filter("float_gt", "events", "event_id", _leaf("ratio", "gt", 90), "ratio > 90 OR isnan(ratio)")

# Projection, grouping and aggregation.
_query("prj_select", {"source": "orders", "select": ["o_orderstatus", "o_orderkey", "o_totalprice"]}, "SELECT o_orderstatus, o_orderkey, o_totalprice FROM s")
_query("prj_derived", {"source": "orders", "select": ["o_orderkey", "o_year", "o_month"], "filter": _leaf("o_year", "eq", 1998)}, "SELECT o_orderkey, o_year, o_month FROM s WHERE o_year = 1998")
_query("prj_unselected_key", {"source": "orders", "group": ["o_orderstatus"], "aggregate": [{"fn": "count", "as": "n"}]}, "SELECT count(*) AS n FROM s GROUP BY o_orderstatus")


def _agg(name: str, source: str, group: list[str], aggregates: list[tuple], sql: str, **more) -> None:
    specs = [{"fn": fn, "as": alias} | ({"field": field} if field else {}) for fn, field, alias in aggregates]
    _query(f"agg_{name}", {"source": source, "select": group, "group": group, "aggregate": specs, **more}, sql)


_agg("group", "lineitem", ["l_returnflag", "l_linestatus"], [("sum", "l_extendedprice", "revenue"), ("count", None, "n")], "SELECT l_returnflag, l_linestatus, sum(l_extendedprice)::DECIMAL(38,2) AS revenue, count(*) AS n FROM s GROUP BY ALL")
_agg("null_group", "events", ["note"], [("count", None, "n"), ("count", "score", "scored")], "SELECT note, count(*) AS n, count(score) AS scored FROM s GROUP BY note")
_agg("sum_int", "events", ["event_type"], [("sum", "score", "total")], "SELECT event_type, sum(score)::BIGINT AS total FROM s GROUP BY 1")
_agg("sum_decimal", "orders", ["o_orderpriority"], [("sum", "o_totalprice", "total")], "SELECT o_orderpriority, sum(o_totalprice)::DECIMAL(38,2) AS total FROM s GROUP BY 1")
_agg("sum_float", "events", ["flag"], [("sum", "ratio", "total")], "SELECT flag, 'NaN'::DOUBLE AS total FROM s GROUP BY 1")
_agg("avg", "events", ["event_type"], [("avg", "score", "mean")], "SELECT event_type, sum(score)::DOUBLE / count(score) AS mean FROM s GROUP BY 1")
_agg("min_max", "events", ["event_type"], [("min", "note", "least"), ("max", "ratio", "most"), ("min", "flag", "flag_min"), ("max", "score", "top")], "SELECT event_type, min(note) AS least, max(ratio) AS most, bool_and(flag) AS flag_min, max(score) AS top FROM s GROUP BY 1")
_agg("global", "lineitem", [], [("count", None, "n"), ("sum", "l_quantity", "q"), ("max", "l_tax", "t")], "SELECT count(*) AS n, sum(l_quantity)::DECIMAL(38,2) AS q, max(l_tax) AS t FROM s")
_agg("global_empty", "lineitem", [], [("count", None, "n"), ("sum", "l_quantity", "q")], "SELECT count(*) AS n, sum(l_quantity)::DECIMAL(38,2) AS q FROM s WHERE FALSE", filter={"or": []})
_query("agg_distinct_keys", {"source": "orders", "select": ["o_orderstatus", "o_orderpriority"], "group": ["o_orderstatus", "o_orderpriority"]}, "SELECT DISTINCT o_orderstatus, o_orderpriority FROM s")
_query("agg_summary", builders.totals("events", builders.summary("score", ["sum", "range", "count"])), "SELECT sum(score)::BIGINT AS score_sum, min(score) AS score_min, max(score) AS score_max, count(score) AS score_count FROM s")

# Sorting and paging; the limit is what is tested.
_page = {"offset": 20, "limit": 50}
_query("srt_top_k", {"source": "orders", "select": ["o_orderkey", "o_totalprice"], "sort": [{"field": "o_totalprice", "direction": "desc"}, {"field": "o_orderkey"}], "limit": 100}, "SELECT o_orderkey, o_totalprice FROM s ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
_query("srt_multi_key", {"source": "events", "select": ["event_id", "note", "score"], "sort": [{"field": "note", "nulls": "first"}, {"field": "score", "direction": "desc"}, {"field": "event_id"}], **_page}, "SELECT event_id, note, score FROM s ORDER BY note NULLS FIRST, score DESC NULLS LAST, event_id LIMIT 50 OFFSET 20")
_query("srt_by_alias", {"source": "orders", "select": ["o_custkey", "total"], "group": ["o_custkey"], "aggregate": [{"fn": "sum", "field": "o_totalprice", "as": "total"}], "sort": [{"field": "total", "direction": "desc"}, {"field": "o_custkey"}], "limit": 25}, "SELECT o_custkey, sum(o_totalprice)::DECIMAL(38,2) AS total FROM s GROUP BY 1 ORDER BY total DESC, o_custkey LIMIT 25")
_query("srt_past_the_end", {"source": "orders", "select": ["o_orderkey"], "sort": [{"field": "o_orderkey"}], "offset": 10_000_000, "limit": 10}, "SELECT o_orderkey FROM s WHERE FALSE")
_query("srt_deep_offset", {"source": "lineitem", "select": ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "sort": [{"field": "l_extendedprice", "direction": "desc"}, *({"field": f} for f in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))], "offset": 40_000, "limit": 25}, "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM s ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25 OFFSET 40000")
_query("srt_locale", {"source": "events", "select": ["event_id", "note"], "sort": [{"field": "note", "collation": "de"}, {"field": "event_id"}], "limit": 100}, "SELECT event_id, note FROM s ORDER BY note NULLS LAST, event_id LIMIT 100")


def _total_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = {"source": "events", "select": ["event_id"], "filter": _leaf("score", "gte", 100), "sort": [{"field": "event_id"}], "limit": 10}
    r = engine(spark, sf_dir, "events").execute(q)
    return spark.createDataFrame([(r.total_count, r.df.count())], "total_count long, page_rows long")


QUERIES["srt_total_count"] = _total_count
ORACLES["srt_total_count"] = _with("events", "SELECT count(*) AS total_count, 10::BIGINT AS page_rows FROM s WHERE score >= 100")


# Pivots.
def _pivot(name: str, p: dict, sql: str | None) -> None:
    QUERIES[name] = lambda spark, sf_dir: engine(spark, sf_dir, p["source"]).pivot(p).df
    ORACLES[name] = None if sql is None else _with(p["source"], sql)


def _measures(*specs: tuple) -> list[dict]:
    return [{"fn": fn, "as": alias} | ({"field": field} if field else {}) | ({"calc": calc} if calc else {}) for fn, field, alias, calc in specs]


_YEARS = range(1995, 2002)
_REVENUE = ", ".join(f"sum(l_extendedprice) FILTER (l_year = {y})::DECIMAL(38,2) AS revenue_{i}, count(*) FILTER (l_year = {y}) AS n_{i}" for i, y in enumerate(_YEARS))
_LEVEL = "(2 - grouping(l_returnflag) - grouping(l_linestatus))::INTEGER AS __level"
_SETS = "GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())"
_rows2 = ["l_returnflag", "l_linestatus"]
_pivot("flagship_pivot", {"source": "lineitem", "rows": _rows2, "columns": ["l_year"], "values": _measures(("sum", "l_extendedprice", "revenue", None), ("count", None, "n", None))}, f"SELECT l_returnflag, l_linestatus, {_REVENUE}, {_LEVEL} FROM s GROUP BY {_SETS}")
_pivot("pvt_sets", {"source": "events", "rows": ["event_type", "note"], "columns": ["flag"], "values": _measures(("count", None, "n", None), ("sum", "score", "total", None))}, "SELECT event_type, note, " + ", ".join(f"count(*) FILTER (flag IS NOT DISTINCT FROM {v}) AS n_{i}, (sum(score) FILTER (flag IS NOT DISTINCT FROM {v}))::BIGINT AS total_{i}" for i, v in enumerate(("FALSE", "TRUE", "NULL"))) + ", (2 - grouping(event_type) - grouping(note))::INTEGER AS __level FROM s GROUP BY GROUPING SETS ((event_type, note), (event_type), ())")
_pivot("pvt_no_rows", {"source": "orders", "rows": [], "columns": ["o_orderstatus"], "values": _measures(("sum", "o_totalprice", "total", None))}, "SELECT " + ", ".join(f"(sum(o_totalprice) FILTER (o_orderstatus = '{v}'))::DECIMAL(38,2) AS total_{i}" for i, v in enumerate("FOP")) + ", 0::INTEGER AS __level FROM s")
_pivot("pvt_no_columns", {"source": "orders", "rows": ["o_orderpriority"], "columns": [], "values": _measures(("avg", "o_custkey", "mean", None), ("max", "o_totalprice", "most", None))}, "SELECT o_orderpriority, sum(o_custkey)::DOUBLE / count(o_custkey) AS mean_0, max(o_totalprice) AS most_0, (1 - grouping(o_orderpriority))::INTEGER AS __level FROM s GROUP BY GROUPING SETS ((o_orderpriority), ())")
_pivot("pvt_two_columns", {"source": "orders", "rows": ["o_orderpriority"], "columns": ["o_orderstatus", "o_year"], "values": _measures(("count", None, "n", None)), "filter": _leaf("o_year", "in", [1996, 1997])}, "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{v}' AND o_year = {y}) AS n_{2 * i + j}" for i, v in enumerate("FOP") for j, y in enumerate((1996, 1997))) + ", (1 - grouping(o_orderpriority))::INTEGER AS __level FROM s WHERE o_year IN (1996, 1997) GROUP BY GROUPING SETS ((o_orderpriority), ())")
_CELLS = "WITH c AS (SELECT event_type, " + ", ".join(f"count(*) FILTER (flag IS NOT DISTINCT FROM {v}) AS n{i}" for i, v in enumerate(("FALSE", "TRUE", "NULL"))) + ", (1 - grouping(event_type))::INTEGER AS __level FROM s GROUP BY GROUPING SETS ((event_type), ()))"


def _calc(name: str, cell: str) -> None:
    p = {"source": "events", "rows": ["event_type"], "columns": ["flag"], "values": _measures(("count", None, "n", name))}
    QUERIES[f"pvt_{name}"] = lambda spark, sf_dir: engine(spark, sf_dir, "events").pivot(p).df
    sql = f"SELECT event_type, {', '.join(cell.format(i=i) + f' AS n_{i}' for i in range(3))}, __level FROM c"
    ORACLES[f"pvt_{name}"] = f"WITH s AS ({_SQL['events']}), {_CELLS.removeprefix('WITH ')} {sql}"


_calc("share_of_row", "n{i}::DOUBLE / (n0 + n1 + n2)")
_calc("share_of_column", "n{i}::DOUBLE / (SELECT n{i} FROM c WHERE __level = 0)")
_calc("share_of_total", "n{i}::DOUBLE / (SELECT n0 + n1 + n2 FROM c WHERE __level = 0)")
_calc("running_total", "(n0 + CASE WHEN {i} > 0 THEN n1 ELSE 0 END + CASE WHEN {i} > 1 THEN n2 ELSE 0 END)::BIGINT")


def _pivot_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of a pivot's rows by a measure, as positions."""
    p = {"source": "lineitem", "rows": _rows2, "columns": ["l_year"], "values": _measures(("sum", "l_extendedprice", "revenue", None)), "sort": [{"field": "l_returnflag", "by": "revenue", "direction": "desc"}, {"field": "l_linestatus", "by": "revenue"}]}
    r = engine(spark, sf_dir, "lineitem").pivot(p)
    return with_rank(r.all_rows, *r.order, name="position").select(*_rows2, F.col("__level").alias("level"), "position")


QUERIES["pvt_order"] = _pivot_order
ORACLES["pvt_order"] = _with(
    "lineitem",
    """, g AS (SELECT l_returnflag, l_linestatus, (2 - grouping(l_returnflag) - grouping(l_linestatus))::INTEGER AS level, sum(l_extendedprice) AS v FROM s GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ()))
    SELECT g.l_returnflag, g.l_linestatus, g.level, row_number() OVER (ORDER BY g.level = 0, p.v DESC, g.l_returnflag, g.level = 1, g.v, g.l_linestatus) - 1 AS position
    FROM g LEFT JOIN g p ON p.level = 1 AND p.l_returnflag = g.l_returnflag""",
)


# Trees.
_TREE = {"key": "id", "parent": "parent"}


def _whole_tree(spark: SparkSession, sf_dir: str, q: dict) -> TreeResult:
    """The tree's answer without the limit that a request without one is given: all its rows."""
    e = engine(spark, sf_dir, "nodes")
    s = e.sources["nodes"]
    return run_tree(s.df, validate(Query.from_json({"source": "nodes"} | q), s.schema, e.limits), s.schema)


def _tree(name: str, q: dict, sql: str, aggregates: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = _whole_tree(spark, sf_dir, q)
        return r.aggregates if aggregates else r.df

    QUERIES[name] = run
    ORACLES[name] = f"WITH RECURSIVE s AS ({_SQL['nodes']}) {sql}"


_VISIBLE = """, up(id, parent, match) AS (SELECT id, parent, TRUE FROM s WHERE segment = 'BUILDING'
    UNION SELECT s.id, s.parent, FALSE FROM up JOIN s ON s.id = up.parent), v AS (SELECT id, parent, bool_or(match) AS match FROM up GROUP BY id, parent)"""
_building = _leaf("segment", "eq", "BUILDING")
_sorted = [{"field": "name"}]
_tree("tree_roots", {"select": ["id", "name"], "sort": _sorted, "tree": _TREE}, "SELECT id, name, (SELECT count(*) FROM s c WHERE c.parent = s.id) AS __children, TRUE AS __matched FROM s WHERE parent IS NULL")
_tree("tree_level", {"select": ["id", "name"], "sort": _sorted, "tree": _TREE | {"under": "r1"}}, "SELECT id, name, (SELECT count(*) FROM s c WHERE c.parent = s.id) AS __children, TRUE AS __matched FROM s WHERE parent = 'r1'")
_tree("tree_context", {"select": ["id", "name"], "filter": _building, "sort": _sorted, "tree": _TREE | {"under": "r2"}}, _VISIBLE + " SELECT s.id, s.name, (SELECT count(*) FROM v c WHERE c.parent = s.id) AS __children, v.match AS __matched FROM s JOIN v USING (id) WHERE s.parent = 'r2'")
_tree("tree_scope", {"select": ["id"], "sort": [{"field": "id"}], "tree": _TREE | {"scope": {"not": _leaf("id", "in", ["r0", "n7"])}}}, "SELECT id, (SELECT count(*) FROM s c WHERE c.parent = s.id AND c.id NOT IN ('r0', 'n7')) AS __children, TRUE AS __matched FROM s WHERE id NOT IN ('r0', 'n7') AND (parent IS NULL OR parent IN ('r0', 'n7'))")
_tree("tree_subtree_aggregates", {"select": ["id"], "filter": _building, "tree": _TREE | {"aggregate": [{"fn": "count", "as": "n"}, {"fn": "sum", "field": "amount", "as": "total"}]}}, _VISIBLE + ", b(top, id) AS (SELECT id, id FROM s WHERE parent IS NULL UNION ALL SELECT b.top, s.id FROM b JOIN s ON s.parent = b.id) SELECT top AS id, count(*) FILTER (s.segment = 'BUILDING') AS n, (sum(s.amount) FILTER (s.segment = 'BUILDING'))::DECIMAL(38,2) AS total FROM b JOIN s ON s.id = b.id WHERE top IN (SELECT id FROM v) GROUP BY top", True)
# tree_flat is a page, as its SQL says: the limit is what is tested. tree_flat_whole has all nodes.
_tree("tree_flat", {"select": ["id", "name"], "sort": _sorted, "limit": 10_000, "tree": _TREE | {"flat": True}}, ", f(id, name, place, path, level) AS (SELECT id, name, [name || chr(1) || id], [id], 0::BIGINT FROM s WHERE parent IS NULL UNION ALL SELECT s.id, s.name, list_append(f.place, s.name || chr(1) || s.id), list_append(f.path, s.id), f.level + 1 FROM f JOIN s ON s.parent = f.id) SELECT id, name, level, path FROM f ORDER BY place LIMIT 10000")
_tree("tree_flat_whole", {"select": ["id", "name"], "sort": _sorted, "tree": _TREE | {"flat": True}}, ", f(id, name, place, path, level) AS (SELECT id, name, [name || chr(1) || id], [id], 0::BIGINT FROM s WHERE parent IS NULL UNION ALL SELECT s.id, s.name, list_append(f.place, s.name || chr(1) || s.id), list_append(f.path, s.id), f.level + 1 FROM f JOIN s ON s.parent = f.id) SELECT id, name, level, path FROM f ORDER BY place")
_tree("tree_flat_filtered", {"select": ["id", "name"], "filter": _building, "sort": _sorted, "tree": _TREE | {"flat": True}}, _VISIBLE + ", f(id, path, level, match) AS (SELECT id, [id], 0::BIGINT, match FROM v WHERE parent IS NULL UNION ALL SELECT v.id, list_append(f.path, v.id), f.level + 1, v.match FROM f JOIN v ON v.parent = f.id) SELECT id, s.name, level, path, match FROM f JOIN s USING (id)")

# What a grid asks.
_query("uiq_free_text", {"source": "events", "select": ["event_id"], "filter": builders.free_text(_EVENTS, "PURCH")}, "SELECT event_id FROM s WHERE contains(lower(event_type), 'purch') OR contains(lower(note), 'purch')")
_query("uiq_facet_filter", {"source": "events", "select": ["event_id"], "filter": builders.facet_filter("note", ["Click", "", None])}, "SELECT event_id FROM s WHERE note IN ('Click', '') OR note IS NULL")
_query("uiq_facet_counts", builders.facet_counts("events", "note", {"note": builders.facet_filter("note", ["Click"]), "score": builders.facet_filter("score", low=50, high=300)}), "SELECT note, count(*) AS og_rows FROM s WHERE score BETWEEN 50 AND 300 GROUP BY note")
_query("uiq_group_level", builders.group_level("events", _EVENTS, ["event_type", "note"], ["click"], [{"fn": "sum", "field": "score", "as": "total"}]), "SELECT note, count(*) AS og_rows, sum(score)::BIGINT AS total FROM s WHERE event_type = 'click' GROUP BY note")
_query("uiq_group_children", {"source": "events", "select": ["event_id"], "filter": builders.group_children([("event_type", "view"), ("note", None)])}, "SELECT event_id FROM s WHERE event_type = 'view' AND note IS NULL")
_query("uiq_totals", builders.totals("orders", [{"fn": "sum", "field": "o_totalprice", "as": "total"}, {"fn": "count", "as": "n"}], _leaf("o_orderstatus", "eq", "F")), "SELECT sum(o_totalprice)::DECIMAL(38,2) AS total, count(*) AS n FROM s WHERE o_orderstatus = 'F'")
_query("uiq_window", builders.window("orders", ["o_orderkey", "o_totalprice"], [{"field": "o_totalprice"}, {"field": "o_orderkey"}], 100, 40), "SELECT o_orderkey, o_totalprice FROM s ORDER BY o_totalprice, o_orderkey LIMIT 40 OFFSET 100")
_query("uiq_whole_view", builders.whole_view("orders", ["o_orderkey", "o_orderstatus"], ["o_orderstatus"], [{"field": "o_orderkey"}]), "SELECT o_orderkey, o_orderstatus FROM s")

_query("uiq_filter_row", {"source": "events", "select": ["event_id"], "filter": builders.filter_row(_EVENTS, [("score", "gte", " 50 "), ("event_type", "icontains", "CLI"), ("note", "is_not_null", ""), ("flag", "eq", " "), ("gone", "eq", "1")])[0]}, "SELECT event_id FROM s WHERE score >= 50 AND contains(lower(event_type), 'cli') AND note IS NOT NULL")
_query("uiq_filter_tree", {"source": "events", "select": ["event_id"], "filter": builders.group("or", [builders.condition(_EVENTS, "score", "lt", "20"), builders.group("and", [builders.condition(_EVENTS, "event_type", "eq", "view"), builders.condition(_EVENTS, "note", "is_null")])])}, "SELECT event_id FROM s WHERE score < 20 OR event_type = 'view' AND note IS NULL")
_query("uiq_facet_period", {"source": "orders", "select": ["o_orderkey"], "filter": builders.facet_period(_ORDERS, "o_orderdate", "1996-01-01T00:00:00Z", "1996-06-30T23:59:59Z")}, "SELECT o_orderkey FROM s WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-06-30 23:59:59'")

# Security.
_policy = Policy(fields=("o_orderkey", "o_orderstatus", "o_totalprice"), row_filter=_leaf("o_custkey", "lt", {"context": "below"}), context={"below": 50})
QUERIES["sec_row_filter"] = lambda spark, sf_dir: _whole(spark, sf_dir, {"source": "orders", "select": ["o_orderkey", "o_orderstatus"]}, orders=_policy)
ORACLES["sec_row_filter"] = _with("orders", "SELECT o_orderkey, o_orderstatus FROM s WHERE o_custkey < 50")
QUERIES["sec_pivot"] = lambda spark, sf_dir: engine(spark, sf_dir, "orders", orders=_policy).pivot({"source": "orders", "rows": ["o_orderstatus"], "values": _measures(("sum", "o_totalprice", "total", None))}).df
ORACLES["sec_pivot"] = _with("orders", "SELECT o_orderstatus, sum(o_totalprice)::DECIMAL(38,2) AS total_0, (1 - grouping(o_orderstatus))::INTEGER AS __level FROM s WHERE o_custkey < 50 GROUP BY GROUPING SETS ((o_orderstatus), ())")

# Exports.
QUERIES["exp_csv"] = lambda spark, sf_dir: export.csv_lines(_whole(spark, sf_dir, {"source": "events", "select": ["event_id", "event_type", "note", "score", "flag"]}))
ORACLES["exp_csv"] = _with("events", "SELECT concat_ws(',', event_id, event_type, CASE WHEN note = '' THEN '\"\"' ELSE coalesce(note, '') END, coalesce(score::VARCHAR, ''), coalesce(flag::VARCHAR, '')) AS line FROM s")
QUERIES["exp_json"] = lambda spark, sf_dir: export.json_rows(_whole(spark, sf_dir, {"source": "orders", "select": ["o_orderkey", "o_totalprice", "o_orderdate"]}))
ORACLES["exp_json"] = _with("orders", "SELECT '{\"o_orderkey\":' || o_orderkey || ',\"o_totalprice\":\"' || o_totalprice || '\",\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '\"}' AS line FROM s")
QUERIES["exp_flat_tree"] = lambda spark, sf_dir: export.flat_columns(_whole_tree(spark, sf_dir, {"select": ["id", "name"], "tree": _TREE | {"flat": True}}).df)
ORACLES["exp_flat_tree"] = f"WITH RECURSIVE s AS ({_SQL['nodes']}), f(id, name, path, level) AS (SELECT id, name, id, 0::BIGINT FROM s WHERE parent IS NULL UNION ALL SELECT s.id, s.name, f.path || ' / ' || s.id, f.level + 1 FROM f JOIN s ON s.parent = f.id) SELECT id, name, level, path FROM f"
_by_status = {"source": "orders", "rows": ["o_orderpriority", "o_year"], "columns": ["o_orderstatus"], "values": _measures(("count", None, "n", None))}
QUERIES["exp_pivot_csv"] = lambda spark, sf_dir: export.pivot_lines(engine(spark, sf_dir, "orders").pivot(_by_status))
ORACLES["exp_pivot_csv"] = _with(
    "orders",
    """, g AS (SELECT o_orderpriority AS a, o_year AS y, 2 - grouping(o_orderpriority) - grouping(o_year) AS level,
        concat_ws(',', count(*) FILTER (o_orderstatus = 'F'), count(*) FILTER (o_orderstatus = 'O'), count(*) FILTER (o_orderstatus = 'P')) AS cells
        FROM s GROUP BY GROUPING SETS ((o_orderpriority, o_year), (o_orderpriority), ()))
    SELECT CASE level WHEN 0 THEN 'Total,' WHEN 1 THEN 'Total ' || a || ',' ELSE a || ',' || y END || ',' || cells AS line,
        row_number() OVER (ORDER BY level = 0, a, level = 1, y) - 1 AS position FROM g""",
)
