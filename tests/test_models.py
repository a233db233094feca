"""A catalogue of small models with instances that are valid and instances that are not, judged in one job."""

import pytest
from pyspark.sql import functions as F

from typeloom.operators import lint, render, validate
from typeloom.plans.catalog import Form

HEAD = '{"id": "https://e.org/m", "name": "m", "imports": ["linkml:types"], "default_range": "string", "prefixes": {"ex": "https://e.org/"}, '
KEYED = '"Other": {"attributes": {"id": {"identifier": true}}}'
LIMITS = '"minimum_value": -1, "maximum_value": 1'

#: name: (body, root class, valid instances, invalid instances)
MODELS = {
    "required and scalar": ('"classes": {"C": {"attributes": {"text": {}, "number": {"range": "integer", "required": true}}}}', "C", ['{"text": "a", "number": 1}', '{"number": 2}'], ['{}', '{"number": "one"}', '{"text": 5, "number": 1}', '{"number": null}', "[]", "7", "no json"]),
    "cardinalities": ('"classes": {"C": {"attributes": {"one": {"required": true}, "most": {}, "least": {"required": true, "multivalued": true}, "any": {"multivalued": true}}}}', "C", ['{"one": "a", "least": ["b"]}', '{"one": "a", "most": "m", "least": ["b", "c"], "any": []}'], ['{"one": ["a", "b"], "least": ["c"]}', '{"one": "a"}', '{"one": "a", "least": "b"}', '{"one": "a", "most": ["x"], "least": ["b"]}']),
    "limits on slots": (f'"classes": {{"C": {{"attributes": {{"i": {{"range": "integer", {LIMITS}}}, "f": {{"range": "float", "minimum_value": -2.0, "maximum_value": 2.0}}, "s": {{"pattern": "^[a-c]+$"}}}}}}}}', "C", ['{"i": -1, "f": 2.0, "s": "abc"}', '{"i": 1}', '{"f": -2}'], ['{"i": 2}', '{"f": 2.5}', '{"s": "abd"}']),
    "limits on types": (f'"types": {{"small": {{"typeof": "integer", "base": "int", {LIMITS}}}, "low": {{"typeof": "float", "base": "float", "maximum_value": 2.0}}, "abc": {{"typeof": "string", "base": "str", "pattern": "^[a-c]+$"}}}}, "classes": {{"C": {{"attributes": {{"i": {{"range": "small"}}, "f": {{"range": "low"}}, "s": {{"range": "abc"}}}}}}}}', "C", ['{"i": 0, "f": 1.5, "s": "ca"}', '{}'], ['{"i": -2}', '{"f": 2.01}', '{"s": ""}']),
    "every scalar type": ('"types": {"own": {"typeof": "string", "base": "str"}}, "classes": {"C": {"attributes": {"s": {}, "b": {"range": "boolean"}, "i": {"range": "integer"}, "d": {"range": "decimal"}, "day": {"range": "date"}, "own": {"range": "own"}}}}', "C", ['{"s": "x", "b": true, "i": 3, "d": 1.25, "day": "2024-02-29", "own": "y"}', '{"i": 3.0}'], ['{"b": "true"}', '{"i": 3.5}', '{"d": "x"}', '{"day": "2024-2-1"}', '{"own": 1}']),
    "enumeration": ('"enums": {"E": {"permissible_values": {"A": {"meaning": "ex:a"}, "B": {}, "C D": {}}}}, "classes": {"C": {"attributes": {"e": {"range": "E"}}}}', "C", ['{"e": "A"}', '{"e": "C D"}'], ['{"e": "a"}', '{"e": "ex:a"}', '{"e": 1}']),
    "aliases": ('"classes": {"C": {"alias": "K", "attributes": {"long name": {"required": true}, "b": {"alias": "short"}}}}', "C", ['{"long_name": "x", "short": "y"}'], ['{"long name": "x"}', '{"long_name": "x", "b": "y"}']),
    "anything": ('"classes": {"Any": {"class_uri": "linkml:Any"}, "C": {"attributes": {"x": {"range": "Any", "required": true}}}}', "C", ['{"x": 1}', '{"x": {"y": [1, "z"]}}', '{"x": [true]}'], ['{}', '{"x": null}']),
    "reference": (f'"classes": {{{KEYED}, "C": {{"attributes": {{"x": {{"range": "Other"}}}}}}}}', "C", ['{"x": "key"}', '{}'], ['{"x": {"id": "key"}}', '{"x": ["key"]}']),
    "reference by number": ('"classes": {"N": {"attributes": {"id": {"identifier": true, "range": "integer"}}}, "C": {"attributes": {"x": {"range": "N", "required": true}}}}', "C", ['{"x": 7}'], ['{"x": "7"}', "{}"]),
    "many references": (f'"classes": {{{KEYED}, "C": {{"attributes": {{"x": {{"range": "Other", "multivalued": true}}}}}}}}', "C", ['{"x": ["a", "b"]}', '{"x": []}', "{}"], ['{"x": "a"}', '{"x": [{"id": "a"}]}']),
    "URIs": ('"classes": {"U": {"attributes": {"id": {"identifier": true, "range": "uri"}}}, "C": {"attributes": {"x": {"range": "uri"}, "r": {"range": "U"}}}}', "C", ['{"x": "https://e.org/a?b#c", "r": "urn:a:b"}', '{"x": "mailto:a@b"}'], ['{"x": "no uri"}', '{"r": "<a>"}']),
    "CURIEs": ('"classes": {"C": {"attributes": {"x": {"range": "curie"}, "y": {"range": "uriorcurie"}}}}', "C", ['{"x": "ex:a", "y": "ex:b"}', '{"y": "https://e.org/b"}'], ['{"x": "a b"}', '{"y": "a b"}']),
    "union of types": ('"classes": {"C": {"attributes": {"x": {"required": true, "any_of": [{"range": "integer"}, {"range": "string"}]}}}}', "C", ['{"x": 1}', '{"x": "one"}'], ['{"x": 1.5}', '{"x": true}', "{}"]),
    "union of references": ('"classes": {"A": {"attributes": {"id": {"identifier": true}}}, "B": {"attributes": {"id": {"identifier": true}}}, "C": {"attributes": {"x": {"required": true, "any_of": [{"range": "A"}, {"range": "B"}]}}}}', "C", ['{"x": "a"}'], ['{"x": 3}']),
    "one inline object": ('"classes": {"I": {"attributes": {"id": {"identifier": true}, "v": {"range": "integer"}}}, "C": {"attributes": {"x": {"range": "I", "inlined": true}}}}', "C", ['{"x": {"id": "a", "v": 1}}', '{"x": {"id": "a"}}'], ['{"x": "a"}', '{"x": {"v": 1}}', '{"x": {"id": "a", "v": "1"}}', '{"x": {"id": "a", "w": 1}}']),
    "inline list": ('"classes": {"I": {"attributes": {"v": {"range": "integer", "required": true}}}, "C": {"attributes": {"x": {"range": "I", "multivalued": true}}}}', "C", ['{"x": [{"v": 1}, {"v": 2}]}', '{"x": []}'], ['{"x": {"v": 1}}', '{"x": [{"v": 1}, {}]}', '{"x": [null]}']),
    "inline by key": (f'"classes": {{{KEYED}, "C": {{"attributes": {{"x": {{"range": "Other", "multivalued": true, "inlined": true}}}}}}}}', "C", ['{"x": {"a": {}, "b": {}}}', '{"x": {}}', '{"x": {"a": null}}'], ['{"x": ["a"]}', '{"x": {"a": {"w": 1}}}']),
    "inline key to value": ('"classes": {"I": {"attributes": {"id": {"identifier": true}, "v": {"range": "integer"}}}, "C": {"attributes": {"x": {"range": "I", "multivalued": true, "inlined": true}}}}', "C", ['{"x": {"a": 1, "b": 2}}', '{"x": {"a": {"v": 1}}}'], ['{"x": {"a": "one"}}', '{"x": [1]}']),
    "inline objects three levels down": ('"classes": {"L": {"attributes": {"n": {"range": "integer", "maximum_value": 5}}}, "M": {"attributes": {"ls": {"range": "L", "multivalued": true}}}, "C": {"attributes": {"m": {"range": "M"}, "ms": {"range": "M", "multivalued": true}}}}', "C", ['{"m": {"ls": [{"n": 5}]}, "ms": [{"ls": []}, {"ls": [{"n": 1}]}]}'], ['{"m": {"ls": [{"n": 6}]}}', '{"ms": [{"ls": [{"n": 1}, {"n": 9}]}]}', '{"ms": [{"ls": [{"o": 1}]}]}']),
    "is_a": ('"classes": {"P": {"attributes": {"text": {}}}, "C": {"is_a": "P", "attributes": {"number": {"range": "integer", "required": true}}}}', "C", ['{"text": "a", "number": 1}'], ['{"text": "a"}', '{"number": "1"}']),
    "mixin": ('"classes": {"M": {"mixin": true, "attributes": {"text": {}}}, "C": {"mixins": ["M"], "attributes": {"number": {"range": "integer", "required": true}}}}', "C", ['{"text": "a", "number": 1}'], ['{"text": "a"}', '{"number": "1"}']),
    "no slots": ('"classes": {"C": {}}', "C", ["{}"], ['{"a": 1}', "[]"]),
}


def model(name):
    return lint.loaded(text=HEAD + MODELS[name][0] + "}")


def test_instances(spark):
    rows = [(name, text, good) for name, (_, _, valid, invalid) in MODELS.items() for good, texts in ((True, valid), (False, invalid)) for text in texts]
    verdict = F.lit(None).cast("boolean")
    for name, (_, root, _, _) in MODELS.items():
        verdict = F.when(F.col("model") == name, validate.json_valid(F.col("json"), model(name), root)).otherwise(verdict)
    found = spark.createDataFrame(rows, "model string, json string, good boolean").withColumn("verdict", verdict).collect()
    assert [(r["model"], r["json"]) for r in found if r["verdict"] != r["good"]] == []


@pytest.mark.parametrize("name", MODELS)
def test_documents_of_each_model(name):
    catalog, root = model(name), MODELS[name][1]
    schema = render.json_schema(catalog, tree_root=root)
    assert set(schema["$defs"][catalog.alias(catalog.classes[root])]["properties"]) == {a.name for a in catalog.attributes(catalog.classes[root]).values()}
    assert set(render.struct_type(catalog, root).names) == {a.name for a in catalog.attributes(catalog.classes[root]).values()}
    assert catalog.alias(catalog.classes[root]) in render.graphql(catalog) and catalog.alias(catalog.classes[root]) in render.er_diagram(catalog)


def test_inheritance_and_mixins_derive_the_same():
    derived = [{a.name: (a.range.name, a.slot.get("required")) for a in model(n).attributes(model(n).classes["C"]).values()} for n in ("required and scalar", "is_a", "mixin")]
    assert derived[0] == derived[1] == derived[2]


@pytest.mark.parametrize("slots, form", [
    ("{}", Form("list")), ('{"id": {"identifier": true}}', Form("compact_dict", "id")), ('{"id": {"identifier": true}, "v": {}}', Form("simple_dict", "id", "v")),
    ('{"id": {"identifier": true}, "v": {}, "w": {}}', Form("compact_dict", "id")), ('{"id": {"identifier": true}, "v": {"required": true}, "w": {}}', Form("simple_dict", "id", "v")),
    ('{"id": {"identifier": true}, "v": {"required": true}, "w": {"required": true}}', Form("compact_dict", "id")),
])
def test_forms_of_a_class(slots, form):
    c = lint.loaded(text=HEAD + f'"classes": {{"C": {{"attributes": {slots}}}}}}}')
    assert c.collection_form(c.classes["C"]) == form


def test_uris_of_odd_names():
    c = lint.loaded(text=HEAD + '"classes": {"Zażółć gęś": {"attributes": {"a (b)/c": {}}}}, "enums": {"e!": {"permissible_values": {"x y": {}, "é": {}}}}}')
    space = c.default_namespace(c.root)
    assert c.uri(c.classes["Zażółć gęś"]) == space + "Za%C5%BC%C3%B3%C5%82%C4%87G%C4%99%C5%9B"
    assert c.meanings(c.enums["e!"]) == {"x y": space + "x_y", "é": space + "%C3%A9"}
