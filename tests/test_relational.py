"""The schema algebra over DataFrames against the driver's catalog, and its two ways of walking a graph."""

import json
import random

import pytest
from pyspark.sql import functions as F

from typeloom import session
from typeloom.functions import names
from typeloom.operators import lint, rdf, relational, validate


def random_schema(seed):
    """Classes with mixins and diamonds, attributes and usages that clash."""
    rng, classes = random.Random(seed), {}
    for i in range(14):
        above = [f"C{j}" for j in range(i)]
        body = {"attributes": {}, "slot_usage": {}}
        if above and rng.random() < 0.8:
            body["is_a"] = rng.choice(above)
        if above and rng.random() < 0.6:
            body["mixins"] = rng.sample(above, min(len(above), rng.randint(1, 3)))
        for where in ("attributes", "slot_usage"):
            for s in rng.sample("abcde", rng.randint(0, 2)):
                meta = {"range": rng.choice(["integer", "double", "date"]), "pattern": f"^{i}{where[0]}", "required": True, "multivalued": True}
                body[where][s] = {k: v for k, v in meta.items() if rng.random() < 0.5}
        if rng.random() < 0.4:
            body["slots"] = ["top"]
        classes[f"C{i}"] = body
    text = {"id": "https://e.org/r", "name": "r", "imports": ["linkml:types"], "default_range": "string", "classes": classes, "slots": {"top": {"pattern": "^top", "is_a": "far"}, "far": {"range": "date", "required": True}}}
    return lint.loaded(text=json.dumps(text))


def slot_table(spark, catalog):
    rows = []
    for top in catalog.slots.values():
        for i, s in enumerate(catalog.ancestors(top)):
            rows.append((top.name, i, s.meta.get("range"), s.meta.get("required"), s.meta.get("multivalued"), s.meta.get("identifier"), s.meta.get("pattern")))
    return spark.createDataFrame(rows, "slot string, ord int, range string, required boolean, multivalued boolean, identifier boolean, pattern string")


@pytest.mark.parametrize("seed", range(2))
def test_relational_derivation_equals_the_catalog(spark, seed):
    c = random_schema(seed)
    tables = relational.catalog_tables(spark, c)
    want = {(cls.name, n): (s.meta.get("range"), bool(s.get("required")), bool(s.get("multivalued")), s.meta.get("pattern")) for cls in c.classes.values() for n, s in c.derived_slots(cls).items()}
    rows = relational.derive_slots(tables["class_parents"], tables["class_slots"], slot_table(spark, c)).collect()
    assert {(r["cls"], r["slot"]): (r["range"], r["required"], r["multivalued"], r["pattern"]) for r in rows} == want
    for held in (0, 1000):
        got = {}
        for r in relational.ancestors(tables["class_parents"], held_edges=held).collect():
            got.setdefault(r["cls"], {})[r["ord"]] = r["ancestor"]
        assert all([got[n][i] for i in range(len(got[n]))] == [a.name for a in c.ancestors(c.classes[n])] for n in got)


def test_precedence_goes_through_a_mixin_in_full_depth(spark):
    text = {"id": "https://e.org/d", "name": "d", "imports": ["linkml:types"], "default_range": "string", "classes": {"A": {"attributes": {"label": {"pattern": "^A"}}}, "B": {"is_a": "A", "slot_usage": {"label": {"pattern": "^B"}}}, "M1": {"is_a": "A"}, "D": {"is_a": "B", "mixins": ["M1"]}}}
    c = lint.loaded(text=json.dumps(text))
    tables = relational.catalog_tables(spark, c)
    found = {r["cls"]: r["pattern"] for r in relational.derive_slots(tables["class_parents"], tables["class_slots"]).collect()}
    assert found == {"A": "^A", "B": "^B", "M1": "^A", "D": "^A"} and c.derived_slots(c.classes["D"])["label"].get("pattern") == "^A"


@pytest.mark.parametrize("held", [0, 1000])
def test_closure_both_ways(spark, held):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("d", "a"), ("e", "e")], "src string, dst string")
    got = {(r["start"], r["node"]): r["depth"] for r in relational.closure(edges, held_edges=held).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 1, ("b", "b"): 0, ("b", "c"): 1, ("b", "a"): 2, ("c", "c"): 0, ("c", "a"): 1, ("c", "b"): 2, ("d", "d"): 0, ("d", "a"): 1, ("d", "b"): 2, ("d", "c"): 2, ("e", "e"): 0}
    seeds = spark.createDataFrame([("d",), ("z",)], "s string")
    assert {r["node"] for r in relational.closure(edges, seeds=seeds, reflexive=False, held_edges=held).collect()} == {"a", "b", "c"}


def test_merged_maps(spark):
    df = spark.createDataFrame([("x", 0, {"a": "1", "b": "1"}), ("x", 2, {"a": "3"}), ("x", 1, {"a": "2", "c": "2"}), ("y", 0, None), ("y", 1, {})], "k string, p int, v map<string,string>")
    assert {r["k"]: r["v"] for r in relational.merged_maps(df, ["k"], "v").collect()} == {"x": {"a": "3", "b": "1", "c": "2"}, "y": {}}


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Cluster:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())
    Cluster.conf.get = staticmethod(lambda key, default=None: "hdfs://x/y")
    assert session.shared_dir(Cluster()) == "hdfs://x/y"


RAW = ["HTTPHandler", "XML", "aField", "order line", "NET-VALUE", "x", "", "AField", "ABc", "aaa_B", "éa b", "w" * 3000 + " v"]
ODD = ["plain", 'q"\\\n\r\t', "é ü \U0001f600 \x01 \x7f", "a b<>{}|^`\\", "", "日本"]


def test_names_as_columns_follow_the_driver(spark):
    df = spark.createDataFrame([(r,) for r in RAW], "n string")
    for r in df.select("n", names.pascal_case_col(F.col("n")).alias("p"), names.camel_case_col(F.col("n")).alias("c")).collect():
        assert (r["p"], r["c"]) == (names.pascal_case(r["n"]), names.camel_case(r["n"]))
    df = spark.createDataFrame([(r,) for r in ODD], "n string")
    for r in df.select("n", names.ntriples_string(F.col("n")).alias("s"), names.ntriples_iri(F.col("n")).alias("i")).collect():
        assert (r["s"], r["i"]) == (names.ntriples_escape(r["n"]), names.ntriples_escape(r["n"], True))


def test_inline_objects_as_triples(spark):
    text = """{"id": "https://e.org/t", "name": "t", "imports": ["linkml:types"], "default_range": "string", "prefixes": {"ex": "https://e.org/x/"},
     "classes": {"Any": {"class_uri": "linkml:Any"},
      "Pt": {"attributes": {"x": {"range": "integer"}, "see": {"range": "curie"}}},
      "Tag": {"attributes": {"name": {"identifier": true}, "note": {}, "more": {}}},
      "T": {"attributes": {"id": {"identifier": true}, "pt": {"range": "Pt"}, "pts": {"range": "Pt", "multivalued": true}, "tags": {"range": "Tag", "multivalued": true, "inlined": true}, "any": {"range": "Any"}}}}}"""
    c = lint.loaded(text=text)
    df = spark.sql("SELECT 'i1' AS id, named_struct('x', 1, 'see', 'ex:a') AS pt, array(named_struct('x', 2, 'see', CAST(NULL AS STRING)), NULL) AS pts, map('k', named_struct('note', 'n', 'more', CAST(NULL AS STRING))) AS tags, named_struct('z', 9) AS any")
    rows = [r.asDict() for r in rdf.instances(df, c, "T").collect()]
    of = lambda p: [r for r in rows if r["p"].endswith(p)]
    (pt,), (tag,) = of("/pt"), of("/tags")
    assert pt["o_kind"] == "blank" and {(r["o"], r["s_kind"]) for r in of("/see")} == {("https://e.org/x/a", "blank")}
    assert {(r["s"], r["o"]) for r in of("/x")} == {(pt["o"], "1"), (of("/pts")[0]["o"], "2")} and len(of("/pts")) == 1
    assert tag["o"] == "https://e.org/t/tag/k" and [(r["s"], r["o"]) for r in of("/note")] == [(tag["o"], "n")]
    assert [r["o"] for r in of("/any")] == ['{"z":9}'] and len(of("#type")) == 4
    assert all("null" not in r["value"] for r in rdf.ntriples_lines(rdf.instances(df, c, "T")).collect())


def test_bounds_are_exact(spark):
    text = '{"id": "https://e.org/b", "name": "b", "imports": ["linkml:types"], "classes": {"B": {"attributes": {"n": {"range": "integer", "maximum_value": 9007199254740992}, "d": {"range": "decimal", "minimum_value": 0.1}, "s": {"range": "integer", "maximum_value": 9007199254740992}, "f": {"range": "double", "maximum_value": 0.5}}}}}'
    c = lint.loaded(text=text)
    df = spark.sql("SELECT CAST(v AS BIGINT) AS n, CAST(w AS DECIMAL(30,20)) AS d, CAST(v AS STRING) AS s, x AS f FROM VALUES (9007199254740993, '0.09999999999999999999', 0.6D), (9007199254740992, '0.1', 0.5D) t(v, w, x)")
    assert {r["slot"]: r["n_invalid"] for r in validate.report(df, c, "B").collect() if r["constraint"] in ("minimum", "maximum")} == {"n": 1, "d": 1, "s": 1, "f": 1}
    assert validate.valid_rows(df, c, "B").count() == 1


def test_cardinality_and_lint_of_texts(spark):
    df = spark.range(10).selectExpr("id % 3 AS g")
    assert {tuple(r) for r in validate.cardinality(df, ["g"], most=3).collect()} == {(0, 4)}
    assert validate.cardinality(df, ["g"], least=4).count() == 2
    texts = spark.createDataFrame([(1, "id: ["), (2, None), (3, "id: https://e.org/x\nname: x\nimports: [linkml:types]\ndefault_range: string\nclasses: {A: {tree_root: true}}\n")], "k int, body string")
    assert {(r["k"], r["issue"], r["severity"]) for r in relational.lint_texts(texts, "k", "body").collect()} == {(1, "SchemaParseError", "fatal"), (2, "SchemaParseError", "fatal")}
