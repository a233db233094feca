import pytest
from pyspark.sql import functions as F

from typeloom import api
from typeloom.operators import rdf, relational, validate
from typeloom.streaming import validate as streaming

HEAD = "id: https://e.org/s\nname: s\nimports: [linkml:types]\ndefault_range: string\n"
MODEL = HEAD + """
enums: {E: {permissible_values: {a: {}, b: {}}}}
classes:
  Any: {class_uri: linkml:Any}
  Inner: {attributes: {x: {range: integer, required: true, maximum_value: 5}}}
  Keyed: {attributes: {k: {identifier: true}, v: {range: integer, minimum_value: 0}}}
  Row:
    attributes:
      id: {identifier: true, range: integer}
      s: {pattern: '^[a-z]*$'}
      n: {range: integer, minimum_value: 1, maximum_value: 3}
      e: {range: E, multivalued: true}
      o: {range: Inner}
      os: {range: Inner, multivalued: true}
      d: {range: Keyed, multivalued: true, inlined: true}
      any: {range: Any, required: true}
      when: {range: date}
      u: {any_of: [{range: E}, {range: integer}]}
"""
DDL = "id long, s string, n long, e array<string>, o struct<x:int>, os array<struct<x:int>>, d map<string,long>, any string, when string, u string"


@pytest.fixture(scope="module")
def schema():
    return api.load_string(MODEL)


def row(**changes):
    good = {"id": 1, "s": "ab", "n": 2, "e": ["a"], "o": (1,), "os": [(1,)], "d": {"q": 1}, "any": "x", "when": "2020-02-29", "u": "a"}
    return tuple({**good, **changes}.values())


@pytest.mark.parametrize("changes, broken", [
    ({}, set()),
    ({"s": "A"}, {("s", "pattern")}),
    ({"n": 0}, {("n", "minimum")}),
    ({"n": 4}, {("n", "maximum")}),
    ({"e": ["a", "z"]}, {("e", "enum")}),
    ({"e": []}, set()),
    ({"o": (None,)}, {("o.x", "required")}),
    ({"o": (9,)}, {("o.x", "maximum")}),
    ({"os": [(1,), (7,)]}, {("os.x", "maximum")}),
    ({"os": [None]}, {("os", "null_item")}),
    ({"d": {"q": -1}}, {("d.v", "minimum")}),
    ({"any": None}, {("any", "required")}),
    ({"when": "2020-02-30"}, {("when", "type")}),
    ({"when": "2020-1-31"}, {("when", "type")}),
    ({"u": "7"}, set()),
    ({"u": "q"}, {("u", "any_of")}),
    ({"s": None, "n": None, "e": None, "o": None, "os": None, "d": None, "when": None, "u": None}, set()),
])
def test_each_constraint(spark, schema, changes, broken):
    df = spark.createDataFrame([row(**changes)], DDL)
    found = schema.validate(df, "Row", ["id"])
    assert {(r["slot"], r["constraint"]) for r in found.collect()} == broken
    assert schema.valid_rows(df, "Row").count() == (not broken)
    counts = {(r["slot"], r["constraint"]): r["n_invalid"] for r in schema.validation_report(df, "Row").collect()}
    assert {k for k, n in counts.items() if n} == broken


NESTED = HEAD + """
classes:
  Leaf: {attributes: {x: {range: integer, required: true, maximum_value: 5}, t: {pattern: '^[a-z]+$'}}}
  Item: {attributes: {leaf: {range: Leaf}, leaves: {range: Leaf, multivalued: true}}}
  Entry: {attributes: {k: {identifier: true, pattern: '^[a-z]+$'}, leaf: {range: Leaf, required: true}, w: {}}}
  Pair: {attributes: {k: {key: true}, v: {range: integer}}}
  C5: {attributes: {leaf: {range: Leaf}}}
  C4: {attributes: {c: {range: C5}}}
  C3: {attributes: {c: {range: C4}}}
  C2: {attributes: {c: {range: C3}}}
  C1: {attributes: {c: {range: C2}}}
  Top: {attributes: {id: {identifier: true, range: integer}, os: {range: Item, multivalued: true}, d: {range: Entry, multivalued: true, inlined: true}, p: {range: Pair, multivalued: true, inlined: true}, c: {range: C1}}}
  Loop: {attributes: {again: {range: Loop}}}
"""
LEAF = "struct<x:int,t:string>"


@pytest.mark.parametrize("os, d, c, broken", [
    ([((1, "a"), [(2, "b")])], {"q": ((1, "a"), "w")}, ((((((1, "a"),),),),),), set()),
    ([((1, "a"), None), ((None, "a"), None)], None, None, {("os.leaf.x", "required")}),
    ([((9, "A"), None)], None, None, {("os.leaf.x", "maximum"), ("os.leaf.t", "pattern")}),
    ([(None, [(1, "a"), (9, None)])], None, None, {("os.leaves.x", "maximum")}),
    ([(None, [None])], None, None, {("os.leaves", "null_item")}),
    (None, {"q": ((1, "a"), "w"), "r": ((9, "a"), "w")}, None, {("d.leaf.x", "maximum")}),
    (None, {"q": ((None, "a"), "w")}, None, {("d.leaf.x", "required")}),
    (None, {"q": (None, "w")}, None, {("d.leaf", "required")}),
    (None, {"q": None}, None, {("d.leaf", "required")}),
    (None, None, ((((((7, "a"),),),),),), {("c.c.c.c.c.leaf.x", "maximum")}),
])
def test_nested_constraints_at_any_depth(spark, os, d, c, broken):
    schema = api.load_string(NESTED)
    deep = f"struct<c:struct<c:struct<c:struct<c:struct<leaf:{LEAF}>>>>>"
    df = spark.createDataFrame([(1, os, d, c)], f"id long, os array<struct<leaf:{LEAF},leaves:array<{LEAF}>>>, d map<string,struct<leaf:{LEAF},w:string>>, c {deep}")
    assert {(r["slot"], r["constraint"]) for r in schema.validate(df, "Top", ["id"]).collect()} == broken
    assert schema.valid_rows(df, "Top").count() == (not broken)
    assert {(r["slot"], r["constraint"]) for r in schema.validation_report(df, "Top").collect() if r["n_invalid"]} == broken


@pytest.mark.parametrize("members, valid", [
    ('"os": [{"leaf": {"x": 1}, "leaves": [{"x": 2}]}], "d": {"q": {"leaf": {"x": 1}, "w": "a"}}, "p": {"a": 1}', True), ('"os": [{"leaf": {"x": 9}}]', False), ('"os": [{"leaf": {"x": 1, "more": 1}}]', False),
    ('"os": [{"leaves": [{"x": 1}, {}]}]', False), ('"os": [{"more": 1}]', False), ('"d": {"q": {"leaf": {"x": "1"}}}', False), ('"d": {"q": {"leaf": {"x": 1}, "more": 1}}', False), ('"d": {"q": {}}', False),
    ('"d": {"q": null}', False), ('"d": {"q": {"k": "q", "leaf": {"x": 1}}}', True), ('"d": {"Q": {"leaf": {"x": 1}}}', False), ('"p": {"a": {"v": 1}}', True), ('"p": {"a": {"v": "x"}}', False), ('"p": {"a": {"more": 1}}', False), ('"p": {"a": "x"}', False),
    ('"c": {"c": {"c": {"c": {"c": {"leaf": {"x": 1}}}}}}', True), ('"c": {"c": {"c": {"c": {"c": {"leaf": {"x": 9}}}}}}', False), ('"c": {"c": {"c": {"c": {"c": {"leaf": {"x": 1}, "more": 1}}}}}', False),
])
def test_nested_json_at_any_depth(spark, members, valid):
    catalog = api.load_string(NESTED).catalog
    df = spark.createDataFrame([('{"id": 1, ' + members + "}",)], "j string")
    assert df.select(validate.json_valid(F.col("j"), catalog, "Top").alias("v")).first()["v"] is valid
    with pytest.raises(ValueError, match="contains itself"):
        validate.json_valid(F.col("j"), catalog, "Loop")


def test_missing_column_and_empty_table(spark, schema):
    df = spark.createDataFrame([(1,)], "id long")
    assert ("any", "required") in {(r["slot"], r["constraint"]) for r in schema.validate(df, "Row", ["id"]).collect()}
    empty = spark.createDataFrame([], DDL)
    assert schema.validate(empty, "Row", ["id"]).count() == 0 and {r["n_invalid"] for r in schema.validation_report(empty, "Row").collect()} == {0}


def test_report_is_one_scan_without_python(spark, schema, small):
    df = spark.read.parquet(f"{small}/lineitem.parquet")
    from typeloom.tables import tables_catalog

    plan = validate.report(df, tables_catalog(), "LineItem")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1 and "Python" not in plan and "l_extendedprice" not in plan


@pytest.mark.parametrize("json, valid", [
    ('{"id": 1, "any": {"z": 1}}', True), ('{"id": 1}', False), ('{"id": "1", "any": 1}', False), ('{"id": 1.0, "any": 1}', True), ('{"id": 1.5, "any": 1}', False),
    ('{"id": 1, "any": 1, "s": false}', False), ('{"id": 1, "any": 1, "s": "x", "n": 3}', True), ('{"id": 1, "any": 1, "n": 9}', False), ('{"id": 1, "any": 1, "more": 2}', False),
    ('{"id": 1, "any": 1, "e": ["a"]}', True), ('{"id": 1, "any": 1, "e": "a"}', False), ('{"id": 1, "any": 1, "e": ["q"]}', False), ('{"id": 1, "any": 1, "o": {"x": 2}}', True),
    ('{"id": 1, "any": 1, "o": {"x": "2"}}', False), ('{"id": 1, "any": 1, "o": {}}', False), ('{"id": 1, "any": 1, "os": [{"x": 1}]}', True), ('{"id": 1, "any": 1, "os": [{"x": 8}]}', False),
    ('{"id": 1, "any": 1, "os": [null]}', False), ('{"id": 1, "any": 1, "d": {"k": 3}}', True), ('{"id": 1, "any": 1, "d": {"k": "3"}}', False), ('{"id": 1, "any": 1, "d": [1]}', False),
    ('{"id": 1, "any": 1, "when": "2020-01-01"}', True), ('{"id": 1, "any": 1, "when": "soon"}', False), ('{"id": 1, "any": 1, "u": 3}', True), ('{"id": 1, "any": 1, "u": true}', False),
    ("[1]", False), ("not json", False), ('{"id": 1, "any": 1, "s": null}', True),
])
def test_json_instances(spark, schema, json, valid):
    df = spark.createDataFrame([(json,)], "j string")
    assert df.select(validate.json_valid(F.col("j"), schema.catalog, "Row").alias("v")).first()["v"] is valid


def test_keys_and_references(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, 9), (None, 5)], "k int, r int")
    assert [tuple(r) for r in validate.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]
    parents = spark.createDataFrame([(5,), (5,)], "p int")
    assert [r["r"] for r in validate.orphans(df, "r", parents, "p").collect()] == [9]


def test_forms_round_trip(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 2), ("h", "a", 3)], "g string, k string, v int")
    dicts = validate.to_dict(df, ["g"], "k", ["v"], "d", simple=True)
    assert sorted(map(tuple, validate.from_dict(dicts, "d", "k", "v").collect())) == sorted(map(tuple, df.collect()))


def test_triples_of_instances(spark):
    schema = api.load_string(HEAD + "prefixes: {ex: https://e.org/}\nenums: {E: {permissible_values: {a: {meaning: ex:A}}}}\nclasses:\n  P: {attributes: {id: {identifier: true}}}\n  R: {attributes: {id: {identifier: true}, e: {range: E}, p: {range: P, multivalued: true}, q: {implicit_prefix: ex}, t: {}}}\n")
    df = spark.createDataFrame([("1", "a", ["x", "y"], "z", 'say "hi"\n')], "id string, e string, p array<string>, q string, t string")
    lines = {r["value"] for r in rdf.ntriples_lines(schema.triples(df, "R")).collect()}
    assert '<https://e.org/s/r/1> <https://e.org/s/t> "say \\"hi\\"\\n" .' in lines and "<https://e.org/s/r/1> <https://e.org/s/e> <https://e.org/A> ." in lines
    assert "<https://e.org/s/r/1> <https://e.org/s/q> <https://e.org/z> ." in lines and len(lines) == 6


def test_relational_equals_driver(spark):
    schema = api.load_string(HEAD + """
classes:
  A: {attributes: {id: {identifier: true}, l: {pattern: a}}}
  M: {mixin: true, attributes: {t: {multivalued: true}}}
  B: {is_a: A, slot_usage: {l: {pattern: b, required: true}}}
  C: {is_a: B, mixins: [M], slot_usage: {t: {range: integer}}}
""")
    c = schema.catalog
    tables = relational.catalog_tables(spark, c)
    got = {(r["cls"], r["slot"]): (r["range"] or "string", r["required"], r["multivalued"], r["pattern"]) for r in relational.derive_slots(tables["class_parents"], tables["class_slots"]).collect()}
    want = {(k.name, n): (c.range_of(s), bool(s.get("required")), bool(s.get("multivalued")), s.meta.get("pattern")) for k in c.classes.values() for n, s in c.derived_slots(k).items()}
    assert got == want
    up = {(r["cls"], r["ancestor"]) for r in relational.ancestors(tables["class_parents"]).collect()}
    assert up == {(k.name, a.name) for k in c.classes.values() for a in c.ancestors(k)}


def test_corpus(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(HEAD + "classes: {C: {attributes: {x: {range: integer}}}}\n")
    (tmp_path / "b.yaml").write_text("id: [")
    rows = relational.corpus_tables(spark, str(tmp_path)).collect()
    assert sorted((r["cls"], r["slot"], r["range"], r["problem"] is None) for r in rows if r["cls"]) == [("C", "x", "integer", True)]
    assert sum(r["problem"] is not None for r in rows) == 1


def test_stream(spark, schema, tmp_path):
    spark.createDataFrame([row(), row(id=2, n=9)], DDL).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
    found = streaming.violations(stream, schema.catalog, "Row", ["id"])
    run = found.writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    assert [tuple(r) for r in spark.sql("SELECT * FROM found").collect()] == [(2, "n", "maximum")]
