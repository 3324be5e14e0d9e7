"""Every registered query of the engine has a stable name and, where SQL has one, an oracle of the same columns."""

import duckdb
import pytest

from lattice import registry

SF = "/root/testdata/sf0.001"
NAMES = ["flagship_pivot", "agg_group", "flt_has_all", "srt_multi_key", "tree_flat", "exp_csv", "sec_pivot", "exp_flat_tree", "exp_pivot_csv", "uiq_filter_row", "uiq_filter_tree", "uiq_facet_period"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    got = con.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, got.fetchall()))


def test_names():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 60


TREES = ["tree_level", "tree_scope", "tree_context", "tree_flat_filtered", "tree_flat_whole", "tree_flat"]


@pytest.mark.parametrize("name", TREES)
def test_trees_of_more_than_ten_thousand_nodes_are_whole(spark, name, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE region AS SELECT i AS r_regionkey, 'R' || i AS r_name FROM range(3) t(i)")
    con.execute("CREATE TABLE nation AS SELECT i AS n_nationkey, CASE WHEN i < 3 THEN i ELSE 1 + i % 2 END AS n_regionkey, 'N' || i AS n_name FROM range(33000) t(i)")
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, CASE WHEN i < 10500 THEN 7 ELSE i END AS c_nationkey, 'C' || i AS c_name, 'BUILDING' AS c_mktsegment, i / 2.0 AS c_acctbal FROM range(33000) t(i)")
    for t in ("region", "nation", "customer"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    df, got = registry.QUERIES[name](spark, str(tmp_path)), con.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    expected = sorted(map(str, got.fetchall()))
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == expected
    assert len(expected) == 10_000 if name == "tree_flat" else len(expected) > 10_000


def test_pivot_positions_are_made_by_spark(spark):
    df = registry.QUERIES["pvt_order"](spark, SF)
    assert df.inputFiles()  # rows that the driver made come from no file
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    got = con.execute(registry.ORACLES["pvt_order"])
    names = [d[0] for d in got.description]
    assert sorted(map(str, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(str, got.fetchall()))
