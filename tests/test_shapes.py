"""Shapes over triples against a small evaluator that reads the shapes as they are written."""

import random
import re
from collections import defaultdict

import pytest

from typeloom.operators import rdf, shapes
from typeloom.operators.lint import loaded
from typeloom.operators.rdf import RDF, SH, XSD
from typeloom.operators.validate import LEXICAL

MODEL = """{"id": "https://e.org/s", "name": "s", "imports": ["linkml:types"], "default_range": "string", "default_prefix": "e", "prefixes": {"e": "https://e.org/"},
 "enums": {"Color": {"permissible_values": {"red": {"meaning": "e:Red"}, "blue": {}}}},
 "classes": {
  "Any": {"class_uri": "linkml:Any"},
  "Thing": {"abstract": true, "attributes": {"id": {"identifier": true}, "name": {"required": true}}},
  "Person": {"is_a": "Thing", "attributes": {"age": {"range": "integer"}, "knows": {"range": "Person", "multivalued": true}, "likes": {"range": "Color", "multivalued": true}, "home": {"range": "uri"}, "what": {"range": "Any"},
    "either": {"any_of": [{"range": "integer"}, {"range": "Color"}, {"range": "Place"}]}}},
  "Boss": {"is_a": "Person", "attributes": {"rank": {"range": "integer", "required": true}}},
  "Place": {"attributes": {"at": {"range": "float"}}}}}"""
E = "https://e.org/"
FORMS = {XSD + "integer": LEXICAL["integer"], XSD + "float": LEXICAL["float"]}


def evaluate(shape_triples, triples, below):
    """(focus, shape, path, constraint, value) of a set of triples by a list of shapes' triples."""
    of = defaultdict(list)
    for t in shape_triples:
        of[t.s, t.p].append((t.o, t.o_kind))
    one = lambda s, p: of[s, p][0][0] if of[s, p] else None
    types = defaultdict(set)
    for s, p, o, kind, _ in triples:
        if p == RDF + "type" and kind == "iri":
            types[s].add(o)

    def listed(head):
        while head != RDF + "nil":
            yield one(head, RDF + "first")
            head = one(head, RDF + "rest")

    def broken(node, o, kind, datatype):
        wanted = one(node, SH + "nodeKind")
        if wanted is not None and kind not in {SH + "IRI": ["iri"], SH + "Literal": ["literal"], SH + "BlankNodeOrIRI": ["iri", "blank"]}[wanted]:
            yield "nodeKind"
        wanted = one(node, SH + "datatype")
        if wanted is not None and not (kind == "literal" and (datatype or XSD + "string") == wanted and re.search(FORMS.get(wanted, ""), o)):
            yield "datatype"
        wanted = one(node, SH + "class")
        if wanted is not None and (kind == "literal" or not types[o] & below[wanted]):
            yield "class"
        if of[node, SH + "in"] and not (kind == "iri" and o in listed(one(node, SH + "in"))):
            yield "in"
        if of[node, SH + "or"] and all(list(broken(b, o, kind, datatype)) for b in listed(one(node, SH + "or"))):
            yield "or"

    out = set()
    for shape in [t.s for t in shape_triples if t.o == SH + "NodeShape"]:
        for focus in [s for s, own in types.items() if own & below[shape]]:
            own = [t for t in triples if t[0] == focus]
            paths = set()
            for node, _ in of[shape, SH + "property"]:
                path = one(node, SH + "path")
                paths.add(path)
                values = [t[2:] for t in own if t[1] == path]
                if of[node, SH + "minCount"] and not values:
                    out.add((focus, shape, path, "minCount", None))
                if of[node, SH + "maxCount"] and len(values) > 1:
                    out.add((focus, shape, path, "maxCount", None))
                out |= {(focus, shape, path, k, v[0]) for v in values for k in broken(node, *v)}
            if one(shape, SH + "closed") == "true":
                paths |= set(listed(one(shape, SH + "ignoredProperties")))
                out |= {(focus, shape, t[1], "closed", t[2]) for t in own if t[1] not in paths}
    return out


def made(seed):
    rng = random.Random(seed)
    nodes = [(f"{E}n{i}", "iri") for i in range(12)] + [(f"b{i}", "blank") for i in range(4)]
    integer = lambda: (rng.choice(["1", "-2", "x"]), "literal", rng.choice([XSD + "integer"] * 4 + [XSD + "string", None]))
    text = lambda: (rng.choice(["a", "b"]), "literal", rng.choice([None, XSD + "string", XSD + "integer"]))
    node = lambda: (*rng.choice(nodes), None)
    color = lambda: (rng.choice([E + "Red", E + "blue", E + "Green"]), rng.choice(["iri", "iri", "literal"]), None)
    value = {"name": text, "age": integer, "knows": node, "likes": color, "home": lambda: rng.choice([node(), text()]), "what": lambda: rng.choice([node(), text()]), "either": lambda: rng.choice([integer(), color(), node()]), "rank": integer, "at": integer, "odd": text, "id": text}
    out = []
    for s, _ in nodes:
        out += [(s, RDF + "type", E + c, "iri", None) for c in rng.sample(["Person", "Boss", "Place", "Elsewhere"], rng.choice([0, 1, 1, 1, 2]))]
        out += [(s, E + p, *value[p]()) for p in rng.choices(list(value), k=rng.randint(0, 9))]
    return out + out[:5]  # some repeat


@pytest.mark.parametrize("seed,open_,hierarchy", [(0, False, True), (1, False, True), (2, True, True), (3, False, False)])
def test_violations_of_made_up_triples(spark, seed, open_, hierarchy):
    catalog = loaded(text=MODEL)
    below = {catalog.uri(c): {catalog.uri(d) for d in catalog.classes.values() if c is d or (hierarchy and c in catalog.ancestors(d))} for c in catalog.classes.values()}
    whole = {catalog.uri(c): {catalog.uri(d) for d in catalog.classes.values() if c in catalog.ancestors(d)} for c in catalog.classes.values()}
    triples = made(seed)
    want = evaluate(list(rdf.shacl(catalog, open_)), sorted(set(triples), key=repr), below)
    if not hierarchy:  # values are of a class through its children all the same
        wider = evaluate(list(rdf.shacl(catalog, open_)), sorted(set(triples), key=repr), whole)
        want = {w for w in want if w[3] not in ("class", "or") or w in wider}
    df = spark.createDataFrame([*triples, (None, E + "name", "x", "literal", None), (E + "n0", E + "name", None, "literal", None)], "s string, p string, o string, o_kind string, o_datatype string").repartition(3)
    found = [tuple(r) for r in shapes.shape_violations(df, catalog, open_, hierarchy).select("s", "shape", "path", "constraint", "value").collect()]
    assert len(found) >= len(set(found)) and set(found) == want
    assert {w[3] for w in want} >= {"minCount", "maxCount", "datatype", "or"} | ({"class", "in"} if seed == 0 else set()) and ("closed" in {w[3] for w in want}) != open_
    assert shapes.shape_violations(df.limit(0), catalog).count() == 0


@pytest.mark.parametrize("mark", [None, 0])
def test_only_nodes_are_kept_and_repeats_are_no_second_value(spark, monkeypatch, mark):
    kept, before = [], shapes.staged

    def staged(df, label):
        kept.append(before(df, label)[0])
        return kept[-1], None

    monkeypatch.setattr(shapes, "staged", staged)
    if mark is not None:  # all values have one mark
        monkeypatch.setattr(shapes, "_mark", lambda: shapes.F.lit(mark).cast("long"))
    rows = [(f"{E}n{i}", RDF + "type", E + "Person", "iri", None) for i in range(3)] + [(f"{E}n{i}", E + "name", f"x{i}", "literal", None) for i in range(3)]
    rows += [(E + "n0", E + "age", "1", "literal", XSD + "integer")] * 40
    rows += [(E + "n1", E + "age", "1", "literal", XSD + "integer"), (E + "n1", E + "age", "1", "literal", None), (E + "n1", E + "age", "1", None, XSD + "integer")]
    rows += [(E + "n2", E + "knows", f"{E}n{i}", "iri", None) for i in range(40)]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string").repartition(3)
    found = sorted(tuple(r) for r in shapes.shape_violations(df, loaded(text=MODEL)).select("s", "constraint").collect() if r)
    assert found.count((E + "n0", "maxCount")) == 0 and found.count((E + "n1", "maxCount")) == 1 and found.count((E + "n2", "class")) == 37
    # what is written on the way has a row a node, and one a property of several values
    assert sum(df.count() for df in kept) == 3 + 2


def test_values_of_no_known_kind_are_judged_by_their_classes(spark):
    rows = [(E + n, RDF + "type", E + "Person", "iri", None) for n in "ab"] + [(E + n, E + "name", "x", "literal", None) for n in "ab"]
    rows += [(E + "a", E + "knows", E + o, None, None) for o in "bc"]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_datatype string")
    found = shapes.shape_violations(df, loaded(text=MODEL)).filter("constraint = 'class'").select("s", "value").collect()
    assert [tuple(r) for r in found] == [(E + "a", E + "c")]
