import json

import pytest

from typeloom import api
from typeloom.operators import rdf, render

HEAD = "id: https://e.org/s\nname: s\nimports: [linkml:types]\ndefault_range: string\nprefixes: {ex: https://e.org/}\n"
MODEL = HEAD + """
enums: {Colour: {permissible_values: {red: {meaning: ex:red}, dark blue: {}}}}
types: {small: {typeof: integer, base: int, minimum_value: 0, maximum_value: 9}}
classes:
  Named: {abstract: true, attributes: {name: {description: its name}}}
  Item: {is_a: Named, attributes: {id: {identifier: true}, colour: {range: Colour}, level: {range: small, rank: 1}}}
  Pair: {attributes: {key: {key: true}, value: {range: integer}}}
  Box:
    tree_root: true
    title: A box
    attributes:
      id: {identifier: true, range: integer}
      items: {range: Item, multivalued: true, inlined: true}
      pairs: {range: Pair, multivalued: true, inlined: true, required: true}
      list: {range: Item, multivalued: true, inlined_as_list: true}
      best: {range: Item}
      tags: {multivalued: true, pattern: '^[a-z]+$'}
  Lost: {attributes: {x: {}}}
"""


@pytest.fixture(scope="module")
def schema():
    return api.load_string(MODEL)


def test_json_schema(schema):
    doc = json.loads(schema.json_schema())
    defs = doc["$defs"]
    assert doc["$ref"] == "#/$defs/Box" and "Lost" not in defs and doc["$id"] == "https://e.org/s"
    box = defs["Box"]["properties"]
    assert box["items"] == {"type": "object", "additionalProperties": {"$ref": "#/$defs/Item__identifier_optional"}}
    assert box["pairs"]["additionalProperties"] == {"$ref": "#/$defs/Pair__simple_dict_value"} and defs["Pair__simple_dict_value"] == {"type": "integer"}
    assert box["list"] == {"type": "array", "items": {"$ref": "#/$defs/Item"}} and box["best"]["type"] == "string"
    assert box["tags"] == {"type": "array", "items": {"type": "string", "pattern": "^[a-z]+$"}}
    assert defs["Box"]["required"] == ["id", "pairs"] and defs["Box"]["additionalProperties"] is False
    assert "id" not in defs["Item__identifier_optional"].get("required", []) and "id" in defs["Item"]["required"]
    assert defs["Item"]["properties"]["level"] == {"type": "integer", "minimum": 0, "maximum": 9}
    assert defs["Colour"] == {"type": "string", "enum": ["red", "dark blue"]}
    assert json.loads(schema.json_schema(open=True))["$defs"]["Box"]["additionalProperties"] is True


def test_table_schema(schema):
    doc = json.loads(schema.table_schema("Item"))
    assert [f["name"] for f in doc["fields"]] == ["colour", "id", "name", "level"] and doc["primaryKey"] == "id"
    assert doc["fields"][0]["constraints"] == {"required": False, "enum": ["red", "dark blue"]}
    assert doc["fields"][3]["constraints"] == {"required": False, "minimum": "0", "maximum": "9"}
    kinds = {f["name"]: f["type"] for f in json.loads(schema.table_schema())["fields"]}
    assert kinds == {"best": "string", "id": "integer", "items": "object", "list": "array", "pairs": "object", "tags": "array"}


def test_graphql(schema):
    text = schema.graphql()
    assert "interface Named {" in text and "type Item implements Named {" in text and "  items: [Item]!\n" in text
    assert "enum Colour {\n  red\n  dark_blue\n}" in text and "  level: Int\n" in text


def test_er_diagram(schema):
    text = schema.er_diagram()
    assert '  Box ||..o| Item : "best"' in text and '  Box ||--|{ Pair : "pairs"' in text and "    integer id PK" in text and "    string key UK" in text
    assert "string[]? tags" in text and "?" not in schema.er_diagram(optional_marker=False)


def test_merged(schema):
    derived = schema.merged()
    assert set(derived["classes"]) == {"Item", "Pair", "Box"} and "slots" not in derived
    assert list(derived["classes"]["Item"]["attributes"]) == ["id", "colour", "level", "name"]
    whole = schema.merged("skip", derive=False)
    assert "Lost" in whole["classes"] and whole["classes"]["Item"]["is_a"] == "Named"


def test_shacl_and_rdfs(schema):
    triples = list(rdf.shacl(schema.catalog))
    assert len(set(triples)) == len(triples)
    closed = {t.s: t.o for t in triples if t.p == rdf.SH + "closed"}
    assert closed["https://e.org/s/Named"] == "false" and closed["https://e.org/s/Box"] == "true"
    assert not any("pattern" in t.p or "minInclusive" in t.p for t in triples)
    lines = schema.rdfs().splitlines()
    assert len(set(lines)) == len(lines) and all(line.endswith(" .") for line in lines)
    assert f"<https://e.org/s/Item> <{rdf.RDFS}subClassOf> <https://e.org/s/Named> ." in lines
    assert "@prefix ex: <https://e.org/> ." in schema.shacl(form="turtle")


def test_any_of_becomes_or():
    schema = api.load_string(HEAD + "classes:\n  U: {attributes: {v: {any_of: [{range: integer}, {range: string}]}}}\n")
    triples = list(rdf.shacl(schema.catalog))
    assert sum(t.p == rdf.SH + "or" for t in triples) == 1 and sum(t.p == rdf.SH + "datatype" for t in triples) == 2


def test_struct_type(schema):
    kind = schema.struct_type("Box")
    assert kind["items"].dataType.simpleString() == "map<string,struct<colour:string,level:bigint,name:string>>"
    assert kind["pairs"].dataType.simpleString() == "map<string,bigint>" and kind["best"].dataType.simpleString() == "string"
    assert not kind["id"].nullable and kind["best"].nullable and kind["id"].metadata["identifier"]
    assert "id BIGINT NOT NULL" in schema.ddl("Box")


def test_recursive_class_is_cut():
    schema = api.load_string(HEAD + "classes:\n  N: {attributes: {kids: {range: N, multivalued: true, inlined_as_list: true}}}\n")
    assert schema.struct_type("N")["kids"].dataType.simpleString() == "array<variant>"
    assert render.json_schema(schema.catalog)["$defs"]["N"]
