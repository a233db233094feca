"""Triples back to objects, and RDF lists against a walk along their cells."""

import random

import pytest
from pyspark.sql import functions as F

from typeloom.operators import frames, rdf
from typeloom.operators.lint import loaded

FIRST, REST, NIL = rdf.RDF + "first", rdf.RDF + "rest", rdf.RDF + "nil"
TRIPLES = "s string, s_kind string, p string, o string, o_kind string"
MODEL = """{"id": "https://e.org/f", "name": "f", "imports": ["linkml:types"], "default_range": "string", "default_prefix": "f", "prefixes": {"f": "https://e.org/f/", "q": "https://q.org/"},
 "types": {"code": {"typeof": "string", "base": "str", "implicit_prefix": "q"}}, "enums": {"E": {"permissible_values": {"a": {"meaning": "q:A"}, "b": {}}}},
 "classes": {
  "Tag": {"attributes": {"word": {}, "n": {"range": "integer"}}},
  "Item": {"attributes": {"id": {"range": "integer", "identifier": true}, "kind": {"range": "E"}, "on": {"range": "date"}, "codes": {"range": "code", "multivalued": true}, "tags": {"range": "Tag", "multivalued": true, "inlined_as_list": true}, "main": {"range": "Tag"}, "of": {"range": "Box"}}},
  "Box": {"attributes": {"id": {"identifier": true}, "items": {"range": "Item", "multivalued": true, "inlined": true, "inlined_as_list": true}, "best": {"range": "Item"}}},
  "Self": {"attributes": {"inner": {"range": "Self"}}}}}"""
ROWS = "id string, items array<struct<id: bigint, kind: string, on: date, codes: array<string>, tags: array<struct<word: string, n: bigint>>, main: struct<word: string, n: bigint>, of: string>>, best bigint"


def test_rows_come_back(spark):
    import datetime

    rng = random.Random(2)
    tag = lambda: (rng.choice(["x", "y", None]), rng.choice([1, 2, None]))
    day = datetime.date(2024, 5, 17)
    rows, i = [], 0
    for b in range(25):
        items = []
        for _ in range(rng.randint(0, 3)):
            i += 1
            tags = sorted((tag() for _ in range(rng.randint(0, 3))), key=lambda t: tuple((x is not None, x) for x in t))
            items.append((i, rng.choice(["a", "b", "odd", None]), rng.choice([day, None]), sorted(rng.sample(["k", "l", "m"], rng.randint(0, 3))), tags, rng.choice([None, tag()]), rng.choice(["box1", None])))
        rows.append((f"box {b}", items, rng.choice([None, 3])))
    df = spark.createDataFrame(rows, ROWS).repartition(3)
    catalog = loaded(text=MODEL)
    triples = rdf.instances(df, catalog, "Box")
    found = frames.frame(triples.union(triples.limit(9)), catalog, "Box")
    names = [c.split(":")[0].split()[0] for c in ("id", "items", "best")]
    assert found.columns == ["node", *names] and found.schema["items"].dataType.simpleString() == df.schema["items"].dataType.simpleString()
    assert sorted(found.select(*names).collect(), key=repr) == sorted(df.collect(), key=repr)
    assert frames.frame(triples.limit(0), catalog, "Box").count() == 0
    with pytest.raises(ValueError, match="contains itself"):
        frames.frame(triples, catalog, "Self")


def test_order_of_a_list_is_kept(spark):
    f = "https://e.org/f/"
    triples = [(f + "item/7", "iri", rdf.RDF + "type", f + "Item", "iri"), (f + "item/7", "iri", f + "codes", "c1", "blank")]
    for cell, value, rest in (("c1", "z", "c2"), ("c2", "a", "c3"), ("c3", "m", None)):
        triples += [(cell, "blank", FIRST, "https://q.org/" + value, "iri"), (cell, "blank", REST, rest or NIL, "blank" if rest else "iri")]
    (row,) = frames.frame(spark.createDataFrame(triples, TRIPLES), loaded(text=MODEL), "Item").collect()
    assert (row["id"], row["codes"], row["tags"], row["kind"]) == (7, ["z", "a", "m"], [], None)


def test_triples_are_read_once_and_objects_keep_the_order_of_a_list(spark):
    f, seen = "https://e.org/f/", spark.sparkContext.accumulator(0)
    triples = [("b", "blank", rdf.RDF + "type", f + "Box", "iri"), ("b", "blank", f + "items", "c1", "blank"), ("b", "blank", f + "items", f + "item/5", "iri")]
    triples += [(f + f"item/{i}", "iri", rdf.RDF + "type", f + "Item", "iri") for i in (9, 2, 5)]
    triples += [("c1", "blank", FIRST, f + "item/9", "iri"), ("c1", "blank", REST, "c2", "blank"), ("c2", "blank", FIRST, f + "item/2", "iri"), ("c2", "blank", REST, NIL, "iri")]

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    (row,) = frames.frame(spark.createDataFrame(triples, TRIPLES).mapInPandas(counted, TRIPLES), loaded(text=MODEL), "Box").collect()
    assert (row["node"], [x["id"] for x in row["items"]], row["best"]) == ("_:b", [5, 9, 2], None)
    assert seen.value == len(triples)


def ranked(triples):
    """Members of the lists that are whole, by walking from each head."""
    firsts, rests, before = {}, {}, {}
    for s, _, p, o, _ in set(triples):
        (firsts if p == FIRST else rests).setdefault(s, []).append(o)
        if p == REST and o != NIL:
            before.setdefault(o, []).append(s)
    out = {}
    for head in set(firsts) | set(rests):
        cell, items, seen = head, [], set()
        if before.get(head):
            continue
        while cell != NIL and cell not in seen and len(firsts.get(cell, [])) == 1 and len(rests.get(cell, [])) == 1 and len(before.get(cell, [])) < 2:
            seen.add(cell)
            items.append(firsts[cell][0])
            cell = rests[cell][0]
        if cell == NIL:
            out["_:" + head] = items
    return out


def test_lists_of_any_length_and_broken_ones(spark):
    rng, triples, n = random.Random(1), [], 0
    for length in (1, 2, 3, 5, 8, 13, 70, 300):
        cells = [f"c{n + i}" for i in range(length)]
        n += length
        for i, cell in enumerate(cells):
            rest = cells[i + 1] if i + 1 < length else NIL
            triples += [(cell, "blank", FIRST, str(rng.randint(0, 9)), "literal"), (cell, "blank", REST, rest, "iri" if rest == NIL else "blank")]
    cell = lambda c, first=1, rest=NIL: [(c, "blank", FIRST, str(i), "literal") for i in range(first)] + [(c, "blank", REST, rest, "iri" if rest == NIL else "blank")] * (rest is not None)
    triples += cell("x1", 1, "x2") + cell("x2", 2) + cell("y1", 1, "y2") + cell("y2", 0) + cell("z1", 1, None) + cell("l1", 1, "l2") + cell("l2", 1, "l1")
    triples += cell("m1", 1, "m3") + cell("m2", 1, "m3") + cell("m3") + cell("o1", 1, "gone") + cell("r1", 1, "r2") + cell("r1", 0, "r3") + cell("r2") + cell("r3")
    df = spark.createDataFrame(triples + triples[:4], TRIPLES).repartition(3)
    found: dict = {}
    for r in frames.rdf_lists(df).orderBy("head", "pos").collect():
        found.setdefault(r["head"], []).append(r["o"])
        assert r["pos"] == len(found[r["head"]]) - 1
    assert found == ranked(triples) and max(map(len, found.values())) == 300
    faults = {tuple(r) for r in frames.list_faults(df).collect()}
    assert {("_:x2", "many_first"), ("_:y2", "no_first"), ("_:z1", "no_rest"), ("_:l1", "no_end"), ("_:m3", "many_before"), ("_:o1", "no_end"), ("_:r1", "many_rest")} <= faults
    assert frames.rdf_lists(df.limit(0)).count() == 0 and frames.rdf_lists(df.filter(F.col("p") == FIRST)).count() == 0


def test_lists_that_go_round_end_with_the_longest(spark, monkeypatch):
    rows, rounds = [], []
    for length in range(1, 8):
        rows += [(f"r{length}_{i}", f"r{length}_{(i + 1) % length}") for i in range(length)]
    rows += [("r6_0", "t0"), ("t0", "t1"), ("t1", "t2")]  # a way out of a round
    rows += [(f"w{i}", f"w{i}b") for i in range(300)] + [(f"w{i}b", None) for i in range(300)]
    triples = [(s, "blank", FIRST, "x", "literal") for s in dict.fromkeys(s for s, _ in rows)] + [(s, "blank", REST, o or NIL, "blank" if o else "iri") for s, o in rows]
    staged = frames.staged
    monkeypatch.setattr(frames, "staged", lambda df, label: rounds.append(label) or staged(df, label))
    members, faults = frames._ranked(frames._cells(spark.createDataFrame(triples, TRIPLES)))
    assert members.count() == 600 and rounds.count("ranks") <= 5
    assert {tuple(r) for r in faults.collect()} == {("_:" + s, "many_rest" if s == "r6_0" else "no_end") for s, _ in rows if s[0] in "rt"}
