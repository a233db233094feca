import pytest

from typeloom.operators import lint
from typeloom.plans.catalog import Form, closure
from typeloom.plans.model import combine
from typeloom.sources.documents import LoadIssue, MapImporter, decode, encode, load_schemas, parse_text

HEAD = "id: https://e.org/s\nname: s\nimports: [linkml:types]\ndefault_range: string\nprefixes: {ex: https://e.org/}\n"


def catalog(text, head=HEAD):
    return lint.loaded(text=head + text)


def test_ancestor_order():
    c = catalog("classes:\n  R: {}\n  P: {is_a: R}\n  M: {mixin: true, is_a: N}\n  N: {mixin: true}\n  C: {is_a: P, mixins: [M]}\n")
    assert [a.name for a in c.ancestors(c.classes["C"])] == ["C", "M", "P", "R", "N"]


def test_closure_is_safe_in_cycles():
    assert closure([1], lambda x: [x % 3 + 1]) == [1, 2, 3]
    assert closure([1], lambda x: [x % 3 + 1], reflexive=False) == [2, 3, 1]


def test_lowest_common_ancestors():
    c = catalog("classes:\n  A: {}\n  M: {mixin: true}\n  B: {is_a: A, mixins: [M]}\n  C: {is_a: A, mixins: [M]}\n  D: {is_a: B}\n  X: {}\n")
    names = lambda *n: sorted(e.name for e in c.lowest_common_ancestors(c.classes[x] for x in n))
    assert names("B", "C") == ["A", "M"] and names("B", "D") == ["B"] and names("D", "X") == [] and names("D") == ["D"]


@pytest.mark.parametrize("metaslot, near, far, merged", [
    ("range", "a", "b", "a"), ("range", None, "b", "b"), ("required", False, True, True), ("required", True, False, True),
    ("aliases", ["a"], ["b"], ["a", "b"]), ("aliases", ["a"], ["a"], ["a"]), ("aliases", ["a"], [], ["a"]),
    ("annotations", {"k": 1}, {"k": 2}, {"k": 2}), ("minimum_value", "1", "5", "1"),
])
def test_combine(metaslot, near, far, merged):
    layers = [{k: v for k, v in ((metaslot, x),) if v is not None} for x in (near, far)]
    assert combine(*layers)[metaslot] == merged


def test_derivation_precedence():
    c = catalog("""
slots:
  size: {range: integer, required: true, pattern: top}
  base_size: {minimum_value: 1, description: not inherited}
classes:
  Base: {slots: [size], slot_usage: {size: {pattern: base, maximum_value: 9}}}
  Mix: {mixin: true, slot_usage: {size: {pattern: mixed}}}
  Leaf: {is_a: Base, mixins: [Mix], slot_usage: {size: {maximum_value: 5}}}
""")
    slot = c.derived_slots(c.classes["Leaf"])["size"]
    assert (slot.get("pattern"), slot.get("maximum_value"), slot.get("range"), slot.get("required")) == ("mixed", "5", "integer", True)


def test_slot_inheritance_takes_some_metaslots_only():
    c = catalog("slots:\n  a: {is_a: b}\n  b: {range: integer, description: far, required: true}\nclasses:\n  C: {slots: [a]}\n")
    slot = c.derived_slots(c.classes["C"])["a"]
    assert slot.get("range") == "integer" and slot.get("required") and slot.meta.get("description") is None


def test_attribute_hides_top_level_slot():
    c = catalog("slots:\n  a: {range: integer}\nclasses:\n  P: {attributes: {a: {}}}\n  C: {is_a: P, slots: [a]}\n")
    assert c.range_of(c.derived_slots(c.classes["C"])["a"]) == "string"


@pytest.mark.parametrize("body, form", [
    ("attributes: {x: {}}", Form("list")),
    ("attributes: {id: {identifier: true}}", Form("compact_dict", "id")),
    ("attributes: {id: {identifier: true}, v: {}}", Form("simple_dict", "id", "v")),
    ("attributes: {id: {identifier: true}, v: {required: true}, w: {}}", Form("simple_dict", "id", "v")),
    ("attributes: {id: {key: true}, v: {}, w: {}}", Form("compact_dict", "id")),
])
def test_collection_forms(body, form):
    c = catalog(f"classes:\n  T: {{{body}}}\n  H: {{attributes: {{ts: {{range: T, multivalued: true, inlined: true}}}}}}\n")
    assert c.collection_form(c.classes["T"]) == form
    assert c.attributes(c.classes["H"])["ts"].form == form


def test_attribute_kinds():
    c = catalog("""
enums: {E: {permissible_values: {a: {meaning: ex:a}, b c: {}}}}
classes:
  Any: {class_uri: linkml:Any}
  Ided: {attributes: {id: {identifier: true, range: integer}}}
  Plain: {attributes: {x: {}}}
  H: {attributes: {t: {range: integer}, e: {range: E}, r: {range: Ided}, i: {range: Ided, inlined: true}, p: {range: Plain}, a: {range: Any}}}
""")
    assert {n: a.kind for n, a in c.attributes(c.classes["H"]).items()} == {"t": "type", "e": "enum", "r": "reference", "i": "inline", "p": "inline", "a": "any"}
    assert c.meanings(c.enums["E"]) == {"a": "https://e.org/a", "b c": "https://e.org/s/b_c"}
    assert c.by_meaning(c.enums["E"])["https://e.org/a"] == "a"


def test_reachability_and_pruning():
    c = catalog("""
types: {t2: {typeof: string}}
classes:
  Root: {tree_root: true, attributes: {a: {range: A}}}
  A: {attributes: {b: {any_of: [{range: B}]}, t: {range: t2}}}
  B: {is_a: Base}
  Base: {abstract: true}
  Lost: {}
""")
    kept = {n for k, n in c.reachable([c.classes["Root"]]) if k == "class"}
    assert kept == {"Root", "A", "B", "Base"}
    keep = c.pruning("tree_root", ancestors=False)
    assert [x.name for x in c.classes.values() if keep(x)] == ["Root", "A", "B"]
    assert all(map(c.pruning("skip"), c.classes.values()))


def test_imports_are_loaded_once_and_cycles_end():
    texts = {"a.yaml": "id: https://e.org/a\nname: a\nimports: [b, sub/c]\n", "b.yaml": "id: https://e.org/b\nname: b\nimports: [a, linkml:types]\n", "sub/c.yaml": "id: https://e.org/c\nname: c\nimports: [../b]\n"}
    assert [s.name for s in load_schemas("a", importer=MapImporter(texts))] == ["a", "b", "types", "c"]


def test_load_problems():
    with pytest.raises(LoadIssue) as missing:
        load_schemas("x", importer=MapImporter({}))
    assert missing.value.kind == "SchemaImportError"
    with pytest.raises(LoadIssue) as broken:
        parse_text("a: [", "f.yaml")
    assert broken.value.kind == "SchemaParseError" and broken.value.region.line >= 1
    for raw in ({"id": "x"}, {"id": "x", "name": "y", "classes": {"C": {"abstract": "yes"}}}, {"id": "x", "name": "y", "slots": {"s": {"rank": 1 << 40}}}):
        with pytest.raises(LoadIssue):
            decode(raw)


def test_encode_is_the_inverse():
    raw = {"id": "x", "name": "y", "classes": {"C": {"is_a": "B", "attributes": {"a": {"range": "string"}}}, "B": {"abstract": True}}, "prefixes": {"p": "https://p/"}}
    assert encode(decode(encode(decode(raw)))) == encode(decode(raw)) == raw


def test_root_forms():
    c = catalog("classes:\n  T: {tree_root: true, attributes: {id: {identifier: true}, v: {}}}\n")
    t = c.tree_root()
    assert c.root_form(t) == Form("plain") and c.root_form(t, "compact_dict") == Form("compact_dict", "id") and c.root_form(t, "simple_dict").value == "v"
    with pytest.raises(KeyError):
        c.tree_root("Nope")
