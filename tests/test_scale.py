"""Steps that must not grow faster than their tables, and answers that only larger tables tell apart."""

import random

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from typeloom.operators import relational
from typeloom.queries import ORACLES


def test_typed_reach_of_slots_without_a_range(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("part", "region", "nation"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    want = con.sql(ORACLES["typed_derived_reach"]).fetchall()
    assert sorted(map(tuple, entry.queries()["typed_derived_reach"](spark, sf).collect())) == sorted(want)


@pytest.fixture
def no_pairs(monkeypatch):
    """Pairs of starts and nodes may not be made."""

    def closure(*args, **kwargs):
        raise AssertionError("pairs are made")

    monkeypatch.setattr(relational, "closure", closure)


def test_reachable_makes_no_pairs(spark, no_pairs):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "e"), ("b", None)], "src string, dst string")
    seeds = spark.createDataFrame([("d",), ("z",), ("b",), ("d",)], "s string")
    assert sorted(r["node"] or "" for r in relational.reachable(edges, seeds).collect()) == ["", "a", "b", "c", "d", "z"]
    assert relational.reachable(edges.filter("false"), seeds).count() == 3 and relational.reachable(edges, seeds.filter("false")).isEmpty()


def class_graph(spark, *more):
    rng, rows = random.Random(5), list(more)
    for i in range(1, 30):
        for j, p in enumerate(rng.sample(range(i), min(i, rng.randint(0, 3)))):
            rows.append((f'C"{i}é', f'C"{p}é', "mixin" if j else "is_a", j))
    return spark.createDataFrame(rows, "cls string, parent string, kind string, ord int")


@pytest.mark.parametrize("held", [0, 20])
def test_large_class_graphs_make_no_pairs(spark, no_pairs, held):
    parents = class_graph(spark)
    rows = lambda n: sorted(map(tuple, relational.ancestors(parents, held_edges=n).collect()))
    assert rows(held) == rows(1000)


def test_cycles_in_large_class_graphs(spark):
    parents = class_graph(spark, ('C"3é', 'C"28é', "mixin", 9), ("x", "x", "is_a", 0), ("y", "x", "is_a", 0))
    rows = lambda n: sorted(map(tuple, relational.ancestors(parents, held_edges=n).collect()))
    assert rows(0) == rows(1000)


def test_common_ancestors_start_from_the_groups(spark, monkeypatch):
    asked, closure = [], relational.closure
    monkeypatch.setattr(relational, "closure", lambda *args, seeds=None, **kw: asked.append(seeds is not None) or closure(*args, seeds=seeds, **kw))
    parents = spark.createDataFrame([("c", "b"), ("d", "b"), ("b", "a"), ("d", "a"), ("e", "e"), ("f", "e")], "cls string, parent string")
    groups = spark.createDataFrame([("1", "c"), ("1", "d"), ("2", "b"), ("2", "c"), ("3", "c"), ("3", "f"), ("4", "f"), ("5", "q")], "grp string, cls string")
    found = {tuple(r) for r in relational.lowest_common_ancestors(parents, groups).collect()}
    assert found == {("1", "b"), ("2", "b"), ("4", "f"), ("5", "q")} and asked == [True]


def test_import_orders_are_found_a_batch_at_a_time():
    batch = pa.RecordBatch.from_pydict({"root": ["a", "z"], "names": [["a", "a", "b", "c"], []], "to": [["c", "b", "a", "b"], []]})
    (found,) = relational._import_orders([batch])
    assert found.to_pydict() == {"root": ["a", "a", "a", "z"], "schema": ["a", "c", "b", "z"], "ord": [0, 1, 2, 0]}


@pytest.mark.parametrize("name", ["corpus_lint", "corpus_attributes"])
def test_texts_are_made_on_all_cores(spark, name):
    found = entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
