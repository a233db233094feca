"""Documents as rows: nodes against a walk, rules against the catalog's lint, digests against parsed documents."""

import json
import random

from typeloom.operators import paths, relational

COVERED = ("SchemaParseError", "MultipleTreeRoots", "NoTreeRootClass", "UndefinedDefaultRange", "InvalidDefaultRange", "InvalidUriOrCurie")


def walk(x, at=()):
    shape = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}[type(x)]
    yield at, shape, x if isinstance(x, str) else json.dumps(x) if shape in ("number", "boolean") else None
    for k, y in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        if isinstance(x, list) and (len(at) == 1 and at[0] in ("classes", "slots", "enums", "types", "prefixes") or len(at) == 3 and at[2] in paths._NESTED):
            k, y = (y["name"], y) if isinstance(y, dict) else (y, None)
        yield from walk(y, (*at, str(k)))


def made(rng):
    pick = lambda *xs: rng.choice(xs)
    uri = lambda: pick("p:ok", "zz:C", "http://e.org/a b", "plain", "schema:T", "urn:x:y", "a b:c", "https://e.org/x", "foaf:P", 5)
    slot = lambda: {k: v for k, v in {"range": pick("C1", None), "required": pick(True, None, None), "slot_uri": uri() if rng.random() < 0.3 else None, "rank": pick(None, 3, None)}.items() if v is not None}
    cls = lambda: {k: v for k, v in {"tree_root": pick(True, False, None), "class_uri": uri() if rng.random() < 0.3 else None, "attributes": pick(None, {"a": slot(), "b": pick(None, slot())}, [{"name": "c", **slot()}, "d"])}.items() if v is not None}
    doc = {"id": "https://e.org/d", "name": "d", "classes": pick({"C1": cls(), "C2": pick(cls(), None)}, [{"name": "C1", **cls()}, "C2"])}
    if rng.random() < 0.6:
        doc |= pick({"imports": ["linkml:types"]}, {"imports": "linkml:types"}, {"default_range": "C1"}, {"types": {"string": {"base": "str"}}})
    if rng.random() < 0.6:
        doc["prefixes"] = pick({"p": "https://p.org/"}, {"p": {"prefix_reference": "https://p.org/"}}, None)
    if rng.random() < 0.3:
        doc["default_curi_maps"] = ["semweb_context"]
    if rng.random() < 0.5:
        doc["slots"] = {"s": pick(slot(), None)}
    if rng.random() < 0.4:
        doc["enums"] = {"E": {"permissible_values": pick({"v": {"meaning": uri()}, "w": None, "x": "told"}, ["v", {"text": "y", "name": "y", "meaning": uri()}])}}
    if rng.random() < 0.3:
        spoil = pick("id", "name", "classes", "rank", "bool", "top", "cls")
        if spoil in ("id", "name"):
            doc.pop(spoil)
        elif spoil == "classes":
            doc["classes"] = pick(5, "x")
        elif spoil == "rank":
            doc["slots"] = {"s": {"range": "C1", "rank": pick("1", 1.5, 1 << 40, True)}}
        elif spoil == "bool":
            doc["slots"] = {"s": {"range": "C1", "required": pick("yes", 1, "true")}}
        elif spoil == "cls":
            doc["slots"] = {"s": pick(4, ["x"])}
        else:
            return pick([1], "text", 7, None)
    return doc


def test_nodes_and_rules_of_made_up_documents(spark):
    rng = random.Random(6)
    docs = [made(rng) for _ in range(400)]
    texts = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame([*texts, (900, None), (901, "{"), (902, "")], "k int, text string").repartition(3)
    nodes = paths.path_table(df, "k", "text")
    want = [(i, *n) for i, d in enumerate(docs) for n in walk(d)] + [(i, (), "invalid", None) for i in (900, 901, 902)]
    assert sorted(((r["k"], tuple(r["path"]), r["shape"], r["value"]) for r in nodes.collect()), key=repr) == sorted(want, key=repr)

    found = {(r["k"], r["issue"]): r["n"] for r in paths.document_issues(nodes, "k").groupBy("k", "issue").count().withColumnRenamed("count", "n").collect()}
    lint = {(r["k"], r["issue"]): r["n"] for r in relational.lint_texts(spark.createDataFrame(texts, "k int, text string"), "k", "text").collect()}
    # one parse error ends the catalog's load, and it tells of no more
    told = {k: 1 if k[1] == "SchemaParseError" else n for k, n in found.items() if k[0] < 900}
    assert told == {k: n for k, n in lint.items() if k[1] in COVERED}
    assert {k[1] for k in told} == set(COVERED)
    assert paths.document_issues(paths.path_table(df.limit(0), "k", "text"), "k").count() == 0


def test_digests_ignore_order_and_space(spark):
    rng = random.Random(7)
    docs = [made(rng) for _ in range(60)]

    def shuffled(x):
        if isinstance(x, dict):
            return {k: shuffled(x[k]) for k in rng.sample(list(x), len(x))}
        return [shuffled(y) for y in x] if isinstance(x, list) else x

    rows = [(f"{i}-{form}", json.dumps(shuffled(d), indent=form)) for i, d in enumerate(docs) for form in (None, 1, 2)]
    found = {r["k"]: r["digest"] for r in paths.digests(paths.path_table(spark.createDataFrame(rows, "k string, text string"), "k", "text"), "k").collect()}
    assert all(len({found[f"{i}-{form}"] for form in (None, 1, 2)}) == 1 for i in range(60))
    assert all((docs[i] == docs[j]) == (found[f"{i}-None"] == found[f"{j}-None"]) for i in range(60) for j in range(60) if not (docs[i] == docs[j] and json.dumps(docs[i], sort_keys=True) != json.dumps(docs[j], sort_keys=True)))
