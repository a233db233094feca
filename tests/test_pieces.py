"""Built-in schemas, regions of faults, well-known prefixes, document forms, codecs and readers."""

import json

import pytest
from pyspark.sql import functions as F

from typeloom import api
from typeloom.operators import lint, render, validate
from typeloom.sources import instances
from typeloom.sources.documents import LoadIssue, MapImporter, decode, encode, load_schemas, region_of

HEAD = "id: https://e.org/s\nname: s\nimports: [linkml:types]\ndefault_range: string\n"


@pytest.mark.parametrize("name, kind, element", [("mappings", "slots", "exact mappings"), ("units", "classes", "UnitOfMeasure"), ("extensions", "classes", "extension"), ("annotations", "classes", "annotation")])
def test_built_in_schemas_load_and_lint(name, kind, element):
    for written in (f"linkml:{name}", f"https://w3id.org/linkml/{name}"):
        c = lint.loaded(text=HEAD.replace("linkml:types", f"linkml:types, '{written}'") + "classes: {R: {tree_root: true}}\n")
        assert element in {"slots": c.slots, "classes": c.classes}[kind] and c.types["string"]
        assert [i.kind for i in lint.issues(c)] == []
    with pytest.raises(LoadIssue, match="no built-in schema nothing"):
        load_schemas(None, HEAD.replace("types", "nothing"))


def test_annotations_inherit_the_key_of_extensions():
    c = lint.loaded(text=HEAD.replace("types]", "types, linkml:annotations]") + "classes: {R: {tree_root: true, attributes: {annotations: {range: annotation, multivalued: true, inlined: true}}}}\n")
    assert c.attributes(c.classes["R"])["annotations"].form == c.collection_form(c.classes["annotation"]) and c.key_slot(c.classes["annotation"]).name == "extension_tag"


@pytest.mark.parametrize("text, line, column", [
    ("classes:\n  C:\n    description: x\n    abstract: maybe\n", 8, 5), ("slots:\n  s: {rank: 99999999999}\n", 6, 7), ("classes:\n  C: 5\n", 6, 3), ("classes:\n  C:\n    attributes:\n      a: {required: 3}\n", 8, 11),
])
def test_decode_errors_have_a_place(text, line, column):
    _, found = lint.load(text=HEAD + text)
    assert found[0].kind == "SchemaParseError" and (found[0].values["region"].line, found[0].values["region"].column) == (line, column)


def test_region_of_a_missing_member_is_that_of_its_parent():
    assert (region_of("a:\n  b: 1\n", "/a/zz").line, region_of("a:\n  b: 1\n", "/a/b").line) == (1, 2)


def test_well_known_prefixes_are_asked_for():
    asked = lint.loaded(text=HEAD + "default_curi_maps: [semweb_context]\nprefixes: {dcat: 'https://own/'}\nclasses: {A: {class_uri: 'prov:Entity'}, B: {class_uri: 'dcat:X'}}\n")
    assert asked.uri(asked.classes["A"]) == "http://www.w3.org/ns/prov#Entity" and asked.uri(asked.classes["B"]) == "https://own/X"
    assert "prov" not in lint.loaded(text=HEAD).prefixes(lint.loaded(text=HEAD).root)


def test_lists_of_allowed_texts_join_slot_and_type():
    c = lint.loaded(text=HEAD + "types: {t: {typeof: string, base: str, equals_string_in: [b, c]}}\nclasses: {A: {attributes: {x: {range: t, equals_string_in: [a]}, y: {range: t}}}}\n")
    of = c.attributes(c.classes["A"])
    assert (of["x"].merged("equals_string_in"), of["y"].merged("equals_string_in")) == (["a", "b", "c"], ["b", "c"])


def test_encoding_strips_defaults_at_every_depth():
    raw = {"id": "x", "name": "y", "classes": {"C": {"abstract": False, "attributes": {"a": {"required": False, "range": "string"}, "b": None}}}, "enums": {"E": {"permissible_values": {"v": {"description": None}}}}}
    assert encode(decode(raw)) == {"id": "x", "name": "y", "classes": {"C": {"attributes": {"a": {"range": "string"}, "b": {}}}}, "enums": {"E": {"permissible_values": {"v": {}}}}}


def test_merged_schema_as_yaml_and_json_loads_again():
    schema = api.load_string(HEAD + "classes: {R: {tree_root: true, attributes: {é: {required: true}}}}\n")
    for form in ("yaml", "json"):
        again = api.load_string(schema.merged_text(form=form))
        assert list(again.catalog.attributes(again.catalog.classes["R"])) == ["é"]


def test_numbers_that_json_cannot_hold_are_texts():
    assert json.loads(render.to_json({"a": [float("inf"), 1.5], "b": float("nan")})) == {"a": ["inf", 1.5], "b": "nan"}


def test_names_of_definitions_and_properties_can_be_given():
    schema = api.load_string(HEAD + "classes: {R: {tree_root: true, attributes: {a: {range: I, multivalued: true, inlined: true}}}, I: {attributes: {id: {identifier: true}, v: {}, w: {}}}}\n")
    found = render.json_schema(schema.catalog, class_name=lambda c: f"X{c.name}", slot_name=lambda a: a.name.upper())
    assert found["$ref"] == "#/$defs/XR" and list(found["$defs"]["XR"]["properties"]) == ["A"] and "ID" not in found["$defs"]["XI__identifier_optional"].get("required", [])


def test_terminal_report_and_raised_problems():
    issues = {"f": [lint.Issue("NoTreeRootClass"), lint.Issue("SchemaIdClash")]}
    shown = lint.rendered(issues, "terminal").split("\n")
    assert "\033[1;31m[fatal]" in shown[1] and "\033[33m[warning]" in shown[2] and "\033" not in lint.rendered(issues, "plain")
    assert issues["f"][0].level == "Warning"
    lint.raise_on_failure([lint.Issue("NoTreeRootClass")])
    with pytest.raises(lint.SchemaProblems) as raised:
        lint.raise_on_failure([lint.Issue("NoTreeRootClass")], strict=True)
    assert [i.kind for i in raised.value.issues] == ["NoTreeRootClass"]


def test_templates_keep_the_indent():
    assert render.indented("a {\n  {body}\n}", body="x\ny") == "a {\n  x\n  y\n}"


def test_codecs_decode_and_check(spark):
    c = lint.loaded(text=HEAD + "types: {hex: {typeof: integer, base: int}}\nclasses: {A: {attributes: {x: {range: hex}}}}\n")
    df = spark.createDataFrame([("ff",), ("zz",), (None,)], "x string")
    validate.register_codec("hex", lambda t: F.when(t.rlike("^[0-9a-f]+$"), F.conv(t, 16, 10).cast("long")))
    try:
        assert [r["n_invalid"] for r in validate.report(df, c, "A").collect()] == [1]
        assert [r["x"] for r in instances.typed(df, c, "A").collect()] == [255, None, None]
    finally:
        validate.register_codec("hex", None)
    assert [r["n_invalid"] for r in validate.report(df, c, "A").filter("constraint = 'type'").collect()] == [2]


def test_triples_are_read_and_any_values_decoded(spark, tmp_path):
    path = tmp_path / "t.nt"
    path.write_text('<http://s/1> <http://p> "a \\"b\\"" .\n_:x <http://p> <http://o> .\n<http://s/1> <http://p> "1"^^<http://int> .\n# no triple\n')
    rows = sorted(map(tuple, instances.read_ntriples(spark, str(path)).collect()), key=str)
    assert rows == sorted([("http://s/1", "iri", "http://p", 'a "b"', "literal", None), ("x", "blank", "http://p", "http://o", "iri", None), ("http://s/1", "iri", "http://p", "1", "literal", "http://int")], key=str)
    df = spark.createDataFrame([('{"a": 1}',), ("[1]",), (None,)], "v string")
    assert [r["d"] for r in df.select(instances.decode_any(F.col("v"), "map<string,int>").alias("d")).collect()] == [{"a": 1}, None, None]


def test_importers_still_serve_what_is_not_built_in():
    texts = {"a.yaml": HEAD.replace("linkml:types", "linkml:units, b"), "b.yaml": "id: https://e.org/b\nname: b\nimports: [linkml:mappings]\n"}
    assert [s.name for s in load_schemas("a", importer=MapImporter(texts))] == ["s", "units", "types", "mappings", "b"]
