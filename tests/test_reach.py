"""Reachability over tables with nodes of a kind and a name, against the driver's catalog."""

import json
import random

import pytest

from typeloom.operators import lint, reach


def random_catalog(seed):
    """Classes, slots, types and enumerations whose names clash, that say all there is to say."""
    rng = random.Random(seed)
    names = {"classes": [f"N{i}" for i in range(12)], "types": [f"N{i}" for i in range(8, 16)], "enums": [f"N{i}" for i in range(13, 20)], "slots": [f"N{i}" for i in range(0, 20, 3)]}
    every = sorted({n for kind in ("classes", "types", "enums") for n in names[kind]} | {"string"})

    def body():
        out = {}
        if rng.random() < 0.5:
            out["range"] = rng.choice(every)
        if rng.random() < 0.2:
            out["any_of"] = [{"range": n} for n in rng.sample(every, 2)]
        if rng.random() < 0.2:
            out["domain"] = rng.choice(names["classes"])
        if rng.random() < 0.3:
            out["inlined"] = True
        return out

    def parents(above):
        out = {}
        if above and rng.random() < 0.4:
            out["is_a"] = rng.choice(above)
        if above and rng.random() < 0.3:
            out["mixins"] = rng.sample(above, 1)
        return out

    classes, slots = {}, {}
    for i, n in enumerate(names["slots"]):
        slots[n] = body() | parents(names["slots"][:i])
    for i, n in enumerate(names["classes"]):
        classes[n] = parents(names["classes"][:i]) | {"attributes": {f"a{j}": body() for j in range(rng.randint(0, 2))}}
        if rng.random() < 0.3:
            classes[n]["attributes"]["id"] = {"identifier": True}
        if rng.random() < 0.5:
            classes[n]["slots"] = rng.sample(names["slots"], 2)
            classes[n]["slot_usage"] = {classes[n]["slots"][0]: body()}
    types = {n: ({"typeof": rng.choice(names["types"][:i])} if i and rng.random() < 0.6 else {"typeof": "string"}) | ({"union_of": rng.sample(names["types"], 2)} if rng.random() < 0.4 else {}) for i, n in enumerate(names["types"])}
    enums = {n: {"permissible_values": {"x": {}}} | ({"inherits": rng.sample(names["enums"], 2)} if rng.random() < 0.6 else {}) for n in names["enums"]}
    text = {"id": "https://e.org/r", "name": "r", "imports": ["linkml:types"], "default_range": "string", "classes": classes, "slots": slots, "types": types, "enums": enums}
    return lint.loaded(text=json.dumps(text))


@pytest.mark.parametrize("seed", range(2))
def test_equals_the_catalog(spark, seed):
    c = random_catalog(seed)
    t = reach.catalog_uses(spark, c)
    # one answer of many seeds would hide faults: one seed at a time
    seeds = [c.classes["N11"], c.types["N14"], c.enums["N17"], c.slots["N18"]]
    derived = reach.derived_uses(t["derived"], t["class_parents"], t["types"], t["enums"])
    alone = reach.derived_uses(t["derived"], None, t["types"], t["enums"])
    written = reach.written_uses(t["class_slots"], t["class_parents"], t["slots"], t["slot_parents"], t["types"], t["enums"])
    ways = [(derived, {}, False), (alone, {"ancestors": False, "inlined_only": True}, True), (written, {"derived": False}, False)]
    for uses, how, only in ways:
        edges = reach.typed_edges(uses, t["elements"], only)
        for e in seeds[::2] if uses is derived else seeds[:1] if uses is alone else seeds[::3]:
            got = {(r["kind"], r["name"]) for r in reach.reached(edges, spark.createDataFrame([(e.kind, e.name)], "kind string, name string")).collect()}
            assert got == c.reachable([e], **how), (e.kind, e.name, how)


def test_a_class_and_an_enumeration_of_one_name_are_two(spark):
    elements = spark.createDataFrame([("class", "A"), ("class", "X"), ("enum", "X"), ("enum", "Y"), ("enum", "Z")], "kind string, name string")
    derived = spark.createDataFrame([("A", "X", ["Y", None])], "cls string, range string, any_of array<string>")
    enums = spark.createDataFrame([("X", ["Z"]), (None, ["Z"])], "enum string, inherits array<string>")
    edges = reach.typed_edges(reach.derived_uses(derived, enums=enums), elements)
    seeds = spark.createDataFrame([("class", "A"), (None, "A")], "kind string, name string")
    assert {tuple(r) for r in reach.reached(edges, seeds).collect()} == {("class", "A", 0), ("class", "X", 1), ("enum", "Y", 1)}
    assert reach.kept(elements, edges, seeds).count() == 3
    assert reach.reached(edges, seeds.filter("false")).isEmpty() and reach.reached(edges.filter("false"), seeds).count() == 1
    assert {tuple(r) for r in reach.reached(reach.typed_edges(reach.derived_uses(derived), elements, inlined_only=True), seeds).select("kind", "name").collect()} == {("class", "A"), ("enum", "Y")}
