"""JSON of classes that contain themselves against a walk of the parsed document."""

import json
import random
import re

import pytest

from typeloom.operators import recursive, validate
from typeloom.operators.lint import loaded

MODEL = """{"id": "https://e.org/t", "name": "t", "imports": ["linkml:types"], "default_range": "string",
 "enums": {"K": {"permissible_values": {"a": {}, "b": {}}}},
 "classes": {
  "Leaf": {"attributes": {"w": {"range": "integer", "required": true}}},
  "Pair": {"attributes": {"key": {"identifier": true}, "val": {"range": "integer", "required": true}, "more": {"range": "Pair", "multivalued": true, "inlined": true}}},
  "Named": {"attributes": {"id": {"identifier": true, "pattern": "^n"}, "x": {"range": "integer"}, "y": {}, "sub": {"range": "Named", "multivalued": true, "inlined": true}}},
  "Node": {"attributes": {"id": {"required": true}, "qty": {"range": "integer", "minimum_value": 0}, "kind": {"range": "K"}, "parts": {"range": "Node", "multivalued": true, "inlined_as_list": true},
   "tags": {"multivalued": true, "pattern": "^t"}, "either": {"any_of": [{"range": "Node"}, {"range": "Leaf"}, {"range": "integer"}]}, "by": {"range": "Named", "multivalued": true, "inlined": true}, "pairs": {"range": "Pair", "multivalued": true, "inlined": true}}}}}"""


def whole(x):
    return isinstance(x, int) and not isinstance(x, bool)


def text(x, pattern=""):
    return [] if isinstance(x, str) and re.search(pattern, x) else ["type"] if not isinstance(x, str) else ["pattern"]


def node(o, at):
    known = ("id", "qty", "kind", "parts", "tags", "either", "by", "pairs")
    yield from members(o, at, known, ("id",))
    for name, x in o.items():
        here = f"{at}/{name}"
        if x is None or name not in known:
            continue
        if name == "id":
            yield from ((here, k) for k in text(x))
        elif name == "qty":
            yield from [(here, "type")] if not whole(x) else [(here, "minimum")] if x < 0 else []
        elif name == "kind":
            yield from [] if x in ("a", "b") else [(here, "enum")]
        elif name in ("parts", "tags"):
            yield from [] if isinstance(x, list) else [(here, "form")]
            for i, y in enumerate(x if isinstance(x, list) else []):
                if y is None:
                    yield f"{here}/{i}", "null_item"
                elif name == "tags":
                    yield from ((f"{here}/{i}", k) for k in text(y, "^t"))
                else:
                    yield from node(y, f"{here}/{i}") if isinstance(y, dict) else [(f"{here}/{i}", "type")]
        elif name == "either":
            fits = whole(x) or isinstance(x, dict) and (not list(node(x, "")) or not list(leaf(x)))
            yield from [] if fits else [(here, "any_of")]
        else:
            yield from dictionary(x, here, named if name == "by" else pair)


def members(o, at, known, required):
    yield from ((f"{at}/{k}", "required") for k in required if o.get(k) is None)
    yield from ((f"{at}/" + k.replace("~", "~0").replace("/", "~1"), "extra") for k in o if k not in known)


def leaf(o):
    yield from members(o, "", ("w",), ("w",))
    if o.get("w") is not None and not whole(o["w"]):
        yield "/w", "type"


def dictionary(x, here, entry):
    if not isinstance(x, dict):
        yield here, "form"
    else:
        for k, y in x.items():
            yield from entry(k, y, f"{here}/" + k.replace("~", "~0").replace("/", "~1"))


def named(k, y, at):
    if not k.startswith("n"):
        yield at, "key_pattern"
    if y is not None and not isinstance(y, dict):
        yield at, "type"
    elif y is not None:
        yield from members(y, at, ("id", "x", "y", "sub"), ())
        yield from ((f"{at}/id", kind) for kind in (text(y["id"], "^n") if y.get("id") is not None else ()))
        yield from [(f"{at}/x", "type")] if y.get("x") is not None and not whole(y["x"]) else []
        yield from [(f"{at}/y", "type")] if y.get("y") is not None and not isinstance(y["y"], str) else []
        yield from dictionary(y["sub"], f"{at}/sub", named) if y.get("sub") is not None else ()


def pair(k, y, at):
    """Two required slots, so the value may stand for the object."""
    if not isinstance(y, dict):
        yield from [] if whole(y) else [(at, "type")]
    else:
        yield from members(y, at, ("key", "val", "more"), ("val",))
        yield from [(f"{at}/key", "type")] if y.get("key") is not None and not isinstance(y["key"], str) else []
        yield from [(f"{at}/val", "type")] if y.get("val") is not None and not whole(y["val"]) else []
        yield from dictionary(y["more"], f"{at}/more", pair) if y.get("more") is not None else ()


def made(rng, depth):
    """A node with some faults, several levels deep."""
    pick = lambda *xs: rng.choice(xs)
    out = {}
    if rng.random() < 0.9:
        out["id"] = pick("x", "y", 5, None) if rng.random() < 0.2 else "x"
    if rng.random() < 0.4:
        out["qty"] = pick(1, 0, -1, "1", 2, True)
    if rng.random() < 0.3:
        out["kind"] = pick("a", "b", "c", 1)
    if rng.random() < 0.3:
        out["tags"] = pick(["t"], ["t", "u", None, 3], "t", [])
    if rng.random() < 0.1:
        out[pick("odd", "a/b~c")] = pick(None, {}, 1)
    inner = lambda: made(rng, depth - 1)
    if depth and rng.random() < 0.7:
        out["parts"] = pick({}, "x") if rng.random() < 0.1 else [pick(None, 3) if rng.random() < 0.1 else inner() for _ in range(rng.randint(0, 2))]
    if depth and rng.random() < 0.5:
        out["either"] = pick(inner(), {"w": pick(1, "1")}, pick(4, "s"), {"id": "x", "either": inner()})
    named_ = lambda d: pick(None, 4, {"x": pick(1, "1")}, {"y": pick("q", 1), "id": pick("n", "m"), "sub": {pick("n1", "z/"): named_(d - 1)} if d else {}})
    if rng.random() < 0.4:
        out["by"] = [] if rng.random() < 0.1 else {pick("n1", "n2", "m~"): named_(2)}
    pair_ = lambda d: pick(1, "1", None, {"val": pick(1, "x"), "more": {"k": pair_(d - 1)} if d else {}}, {"key": pick("k", 1)})
    if rng.random() < 0.4:
        out["pairs"] = {"p": pair_(2)}
    return out


@pytest.fixture(scope="module")
def catalog():
    return loaded(text=MODEL)


def test_faults_of_made_up_trees(spark, catalog):
    rng = random.Random(4)
    docs = [made(rng, 4) for _ in range(400)]
    rows = [(i, json.dumps(d)) for i, d in enumerate(docs)] + [(1000, None), (1001, "{"), (1002, "[1]"), (1003, ""), (1004, "null")]
    found = recursive.json_faults(spark.createDataFrame(rows, "k int, json string").repartition(3), catalog, "Node", ["k"])
    want = [(i, *f) for i, d in enumerate(docs) for f in node(d, "")] + [(i, "", "json") for i in range(1000, 1005)]
    assert len({w[0] for w in want}) < 390 and {w[2] for w in want} >= {"any_of", "key_pattern", "extra", "null_item", "form", "enum", "minimum"}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert recursive.json_faults(spark.createDataFrame([], "k int, json string"), catalog, "Node", ["k"]).count() == 0


def test_depth_of_twenty_and_open_records(spark, catalog):
    doc = {"id": "x", "qty": -1, "odd": 1}
    for _ in range(20):
        doc = {"id": "x", "parts": [doc]}
    df = spark.createDataFrame([("a", json.dumps(doc))], "k string, json string")
    assert [tuple(r) for r in recursive.json_faults(df, catalog, "Node", ["k"], closed=False).collect()] == [("a", "/parts/0" * 20 + "/qty", "minimum")]


def test_a_step_looks_at_its_own_level_only(spark, catalog):
    """What a value is, is not told by the schema of all that is below it, anew at each level."""
    from pyspark.sql import functions as F

    v, path, trail = (F.lit(None).cast(t) for t in ("variant", "string", recursive._TRAIL))
    step, node = recursive._Step(catalog, True), catalog.classes["Node"]
    parts = next(a for a in catalog.attributes(node).values() if a.name == "parts")
    for made in (step.child(node, v, path, trail), step.slot(parts, v, path, trail)):
        assert "to_json" in str(made) and "schema_of_variant" not in str(made)


def test_agrees_with_the_column_form(spark):
    """A class that does not contain itself has both forms."""
    flat = loaded(text=MODEL.replace('"range": "Node", "multivalued"', '"range": "Leaf", "multivalued"').replace('{"range": "Node"}, ', "").replace('"sub": {"range": "Named"', '"sub": {"range": "Leaf"').replace('"more": {"range": "Pair"', '"more": {"range": "Leaf"'))
    rng = random.Random(5)
    df = spark.createDataFrame([(i, json.dumps(made(rng, 2))) for i in range(300)], "k int, json string")
    bad = {r["k"] for r in recursive.json_faults(df, flat, "Node", ["k"]).collect()}
    valid = {r["k"] for r in df.filter(validate.json_valid(df["json"], flat, "Node")).collect()}
    assert valid and bad and valid == set(range(300)) - bad


def test_column_form_names_the_other(catalog, spark):
    with pytest.raises(ValueError, match="recursive.json_faults"):
        validate.json_valid(spark.range(1)["id"].cast("string"), catalog, "Node")
