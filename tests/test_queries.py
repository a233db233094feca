"""Every query that has SQL gives DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from typeloom import queries as own_queries
from typeloom.queries import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: ("nan" if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    sql = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(map(tuple, df.collect()), df.columns) == rows(sql.fetchall(), sql.columns)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["slot", "constraint", "n_invalid"] and df.count() == 10


def test_queries_and_sql_share_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plan(query, spark):
    return own_queries.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_names_of_kinds_are_made_of_counts_not_of_triples(spark):
    _, below = _plan("inline_triples", spark).rsplit("Aggregate [p#", 1)
    assert "regexp_extract" not in below.split("\n", 1)[1]


def test_only_blank_nodes_are_joined_to_their_names(spark):
    plan = _plan("inline_triples_each", spark)
    assert plan.count("Join LeftOuter") > 1
    for side in plan.split("Join LeftOuter")[1:]:
        assert "_kind" in side.split("Filter", 1)[1].splitlines()[0]


def test_triples_of_lines_are_neither_sent_nor_written(spark, monkeypatch):
    written, staged = [], own_queries.staged
    monkeypatch.setattr(own_queries, "staged", lambda df, label: written.append(df.columns) or staged(df, label))
    found = own_queries.QUERIES["inline_triples_each"](spark, SF)
    assert written == [["ckey", "orders"]]
    plan = found._jdf.queryExecution().executedPlan().toString()
    below = [x.split("FileScan", 1)[0] for x in plan.split("Exchange")[1:]]
    assert below and "SortMergeJoin" not in plan and not any("Generate" in x for x in below)


def test_blank_nodes_of_a_large_customer_and_of_one_without_a_key(spark, tmp_path):
    con = duckdb.connect()
    con.sql(f"COPY (SELECT i AS o_orderkey, CASE WHEN i < 90 THEN 7 WHEN i < 95 THEN i END AS o_custkey FROM range(100) r(i)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"COPY (SELECT i // 5 AS l_orderkey, (i % 5 + 1)::INTEGER AS l_linenumber, i AS l_partkey, (i % 50)::DOUBLE AS l_quantity, ['R', 'A', 'N'][i % 3 + 1] AS l_returnflag FROM range(480) r(i)) TO '{tmp_path}/lineitem.parquet'")
    for name in ("orders", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    df = own_queries.QUERIES["inline_triples_each"](spark, str(tmp_path))
    sql = con.sql(ORACLES["inline_triples_each"])
    assert rows(map(tuple, df.collect()), df.columns) == rows(sql.fetchall(), sql.columns)
