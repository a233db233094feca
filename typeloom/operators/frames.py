"""Triples back to objects: instances framed bottom-up along the class graph, and RDF lists ranked.

What ``rdf.instances`` takes apart is put together again by one join a class and inline slot: the objects of the
innermost classes first, then those that hold them. No node's graph is walked.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.names import namespace
from typeloom.operators.rdf import BLANK, IRI, RDF, instance_space
from typeloom.plans.catalog import Attribute, Catalog
from typeloom.session import drop_scratch, staged

_SIMPLE = {"integer": "bigint", "boolean": "boolean", "float": "double", "double": "double", "decimal": "decimal(38,18)", "date": "date", "datetime": "timestamp"}


def _node(name: str, kind: str) -> Column:
    """A node's key: blank nodes and IRIs of one text are two nodes."""
    return F.concat(F.when(F.col(kind) == BLANK, "_:").otherwise(""), F.col(name))


def _without(text: Column, space: str) -> Column:
    return F.when(text.startswith(space), F.substring(text, len(space) + 1, 1 << 30)).otherwise(text)


def _scalar(catalog: Catalog, attribute: Attribute, o: Column, kind: Column) -> Column:
    """A value of a slot from its object: the reverse of how instances are written; null where it does not fit the type."""
    if attribute.kind == "enum":
        by_uri = {u: v for v, u in catalog.meanings(attribute.range).items()}
        if not by_uri:
            return o
        found = F.try_element_at(F.create_map(*[F.lit(x) for pair in by_uri.items() for x in pair]), o)
        return F.when(kind == IRI, F.coalesce(found, o)).otherwise(o)
    if attribute.kind not in ("type", "reference"):
        return o
    how = catalog.subject_type(attribute)
    if how.startswith("implicit:"):
        o = _without(o, namespace(catalog.prefixes(attribute.slot.schema)[how.removeprefix("implicit:")]))
    elif attribute.kind == "reference" and how == "base":
        o = _without(o, instance_space(catalog, attribute.range))
    of = attribute.identifier if attribute.kind == "reference" else attribute
    spark = _SIMPLE.get(catalog.runtime_type(of.range)) if of.kind == "type" else None
    return o.try_cast(spark) if spark else o


def frame(triples: DataFrame, catalog: Catalog, cls: str) -> DataFrame:
    """node, and a column for each slot: the instances of a class, with the objects inside them, from triples.

    An instance is a node typed with the class itself. The identifier comes from the node's IRI, enumerations from their
    meanings, references and implicit prefixes lose their namespace, literals are cast. Slots of many values are lists:
    sorted, as a graph has no order, or in the order of an RDF list where the object is the head of one. Of several
    values of a single-valued slot the smallest counts, and shapes tell of the others. Inline objects are structs
    (dictionaries come as lists), null where the node is no instance of the slot's class; a class that contains itself
    raises a ValueError. Repeated triples count once; a node without anything said of it has nulls and empty lists.

    The triples are dealt once: what is said of a node in a plain slot goes to the node, an inline slot to the node inside,
    so that each knows its holders. A class and inline slot then sends its finished structs to those that hold them.
    """
    plain, inline = _predicates(catalog, cls, ())
    codes = {p: i for i, p in enumerate(sorted(plain | {RDF + "type", RDF + "first", RDF + "rest"}))}
    links = {p: len(codes) + i for i, p in enumerate(sorted(inline))}
    kind = F.when(F.col("o_kind") == IRI, 1).when(F.col("o_kind") == BLANK, 2).otherwise(0).cast("byte").alias("kind")
    code = lambda found: F.coalesce(*[F.when(F.col("p") == p, i) for p, i in found.items()]).cast("short").alias("code")
    told = F.when(F.col("p").isin(*codes), F.struct(_node("s", "s_kind").alias("node"), code(codes), F.col("o").alias("v"), kind))
    held = F.when(F.col("p").isin(*links), F.struct(_node("o", "o_kind").alias("node"), code(links), _node("s", "s_kind").alias("v"), kind)) if links else None
    rows = triples.filter("s IS NOT NULL AND o IS NOT NULL").filter(F.col("p").isin(*codes, *links)).filter((F.col("p") == RDF + "rest") | (F.col("o") != RDF + "nil") | ~F.col("o_kind").eqNullSafe(IRI))
    one = F.coalesce(*[x for x in (held, told) if x is not None])
    rows = rows.select(F.explode(F.array_compact(F.array(told, held))).alias("x") if plain & inline else one.alias("x")).select("x.*")
    nodes, path = staged(rows.repartition("node").groupBy("node").agg(F.collect_set(F.struct("code", "v", "kind")).alias("said")), "nodes")
    listed = not nodes.filter(F.exists("said", lambda x: x["code"] == codes[RDF + "first"])).isEmpty()
    if listed:
        nodes, gone = _listed(nodes, codes, len(codes)), path
        drop_scratch(gone)
    return _framed(nodes, catalog, cls, codes, links, listed).drop("_said")


def _predicates(catalog: Catalog, cls: str, above: tuple[str, ...]) -> tuple[set[str], set[str]]:
    """The predicates of the plain and of the inline slots of a class and of all classes inside it."""
    if cls in above:
        raise ValueError(f"class {cls} contains itself ({' > '.join((*above, cls))})")
    plain, inline = set(), set()
    for a in catalog.attributes(catalog.classes[cls]).values():
        if a.slot.get("identifier"):
            continue
        (inline if a.kind == "inline" else plain).add(catalog.uri(a.slot))
        if a.kind == "inline":
            more = _predicates(catalog, a.range.name, (*above, cls))
            plain, inline = plain | more[0], inline | more[1]
    return plain, inline


def _listed(nodes: DataFrame, codes: dict[str, int], n_codes: int) -> DataFrame:
    """The nodes with the members of each list in place of its head, and their places."""
    flat = nodes.select("node", F.explode("said").alias("x")).select("node", "x.*")
    key = F.concat(F.when(F.col("kind") == 2, "_:").otherwise(""), F.col("v"))
    cells = flat.filter(F.col("code").isin(codes[RDF + "first"], codes[RDF + "rest"]))
    kind = F.when(F.col("kind") == 2, BLANK).when(F.col("kind") == 1, IRI).otherwise("literal")
    about = cells.select(F.col("node").alias("cell"), F.when(F.col("code") == codes[RDF + "first"], RDF + "first").otherwise(RDF + "rest").alias("p"), key.alias("node"), F.col("v").alias("o"), kind.alias("o_kind"))
    member = F.when(F.col("o_kind") == BLANK, 2).when(F.col("o_kind") == IRI, 1).otherwise(0).cast("byte")
    found, _ = staged(_ranked(about)[0].select("head", "pos", F.col("node").alias("_item"), F.col("o").alias("_o"), member.alias("_kind")), "lists")
    heads = found.select("head").distinct()
    parts = []
    # what is said of a node has the head for its value, an inline slot goes to the head
    for rows, node, value in ((flat.filter(F.col("code") < n_codes).withColumn("head", key), F.col("node"), F.col("_o")), (flat.filter(F.col("code") >= n_codes).withColumn("head", F.col("node")), F.col("_item"), F.col("v"))):
        parts.append(rows.join(heads, "head", "left_anti").select("node", "code", "v", "kind", F.lit(None).cast("long").alias("pos")))
        parts.append(rows.join(found, "head").select(node.alias("node"), "code", value.alias("v"), F.col("_kind").alias("kind"), "pos"))
    rows = reduce(DataFrame.unionByName, parts)
    return staged(rows.repartition("node").groupBy("node").agg(F.collect_list(F.struct("code", "v", "kind", "pos")).alias("said")), "nodes")[0]


def _about(said: str, code: int) -> Column:
    return F.filter(said, lambda x: x["code"] == code)


def _plain(catalog: Catalog, attribute: Attribute, said: Column, place: Callable[[Column], Column]) -> Column:
    """The value, or the list of values, of a plain slot from what is said in it."""

    def value(x: Column) -> Column:
        return _scalar(catalog, attribute, x["v"], F.when(x["kind"] == 1, F.lit(IRI)))

    if not attribute.slot.get("multivalued"):
        return F.array_min(F.transform(said, value))
    placed = F.filter(F.transform(said, lambda x: F.struct(place(x).alias("p"), value(x).alias("v"))), lambda x: x["v"].isNotNull())
    return F.transform(F.array_sort(placed), lambda x: x["v"])


def _framed(nodes: DataFrame, catalog: Catalog, cls: str, codes: dict[str, int], links: dict[str, int], listed: bool) -> DataFrame:
    element = catalog.classes[cls]
    place = (lambda x: x["pos"]) if listed else (lambda x: F.lit(None).cast("long"))
    of_class = lambda x: (x["code"] == codes[RDF + "type"]) & (x["v"] == catalog.uri(element)) & (x["kind"] == 1)
    own = nodes.filter(F.exists("said", of_class))
    attributes = list(catalog.attributes(element).values())
    inner = {i: a for i, a in enumerate(attributes) if a.kind == "inline" and not a.slot.get("identifier")}
    if inner:
        parts = [own]
        for i, a in inner.items():
            inside = _framed(nodes, catalog, a.range.name, codes, links, listed)
            struct = F.struct(*[F.col(f"`{c}`") for c in inside.columns if c not in ("node", "_said")])
            code = links[catalog.uri(a.slot)]
            holders = inside.select(F.explode(_about("_said", code)).alias("x"), struct.alias("v"))
            parts.append(holders.select(F.col("x.v").alias("node"), F.struct(place(F.col("x")).alias("p"), "v").alias(f"_inline{i}")))
        rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
        # a null struct stands for other parts' rows; the one row with what is said is the node's own
        gathered = [(F.array_sort(F.collect_list(f"_inline{i}")) if a.slot.get("multivalued") else F.min(F.col(f"_inline{i}")["v"])).alias(f"_inline{i}") for i, a in inner.items()]
        own = rows.repartition("node").groupBy("node").agg(F.first("said", ignorenulls=True).alias("said"), *gathered).filter("said IS NOT NULL")
    names = [F.col("node")]
    for i, a in enumerate(attributes):
        if a.slot.get("identifier"):
            if a is not next(k for k in reversed(attributes) if k.slot.get("identifier")):
                continue
            spark = _SIMPLE.get(catalog.runtime_type(a.range)) if a.kind == "type" else None
            text = F.when(~F.col("node").startswith("_:"), _without(F.col("node"), instance_space(catalog, element)))
            names.append((text.try_cast(spark) if spark else text).alias(a.name))
        elif i in inner:
            names.append((F.transform(f"_inline{i}", lambda x: x["v"]) if a.slot.get("multivalued") else F.col(f"_inline{i}")).alias(a.name))
        else:
            names.append(_plain(catalog, a, _about("said", codes[catalog.uri(a.slot)]), place).alias(a.name))
    return own.select(*names, F.col("said").alias("_said"))


def rdf_lists(triples: DataFrame) -> DataFrame:
    """head, pos, node, o, o_kind: the members of each RDF list, in order from 0.

    Each cell points to the one before it; pointers are doubled, so a list of n cells takes log2(n) joins, and so does one
    that goes round. Cells with several rests, firsts or cells before them, lists that do not end, and what follows a
    fault are left out whole: see ``list_faults``.
    """
    return _ranked(_cells(triples))[0]


def list_faults(triples: DataFrame) -> DataFrame:
    """node, fault of the cells that make up no list: many_first, many_rest, many_before, no_first, no_rest, no_end."""
    return _ranked(_cells(triples))[1]


def _cells(triples: DataFrame) -> DataFrame:
    return triples.filter(F.col("p").isin(RDF + "first", RDF + "rest")).select(_node("s", "s_kind").alias("cell"), "p", _node("o", "o_kind").alias("node"), "o", "o_kind")


def _ranked(about: DataFrame) -> tuple[DataFrame, DataFrame]:
    # a cell meets what is said of it and the cells before it in one shuffle; what is said twice the same is one
    first, rest = F.col("p") == RDF + "first", (F.col("p") == RDF + "rest") & (F.col("o") != RDF + "nil")
    said = F.struct("cell", F.when(first, 0).otherwise(1).alias("t"), F.struct("node", "o", "o_kind").alias("v"))
    led = F.when(rest, F.struct(F.col("node").alias("cell"), F.lit(2).alias("t"), F.struct(F.col("cell").alias("node"), F.lit(None).cast("string").alias("o"), "o_kind").alias("v")))
    told = about.filter("cell IS NOT NULL").select(F.explode(F.array_compact(F.array(said, led))).alias("x")).select("x.*").filter("cell IS NOT NULL")
    of = {n: F.when(F.col("t") == i, F.col("v")) for i, n in enumerate(("f", "r", "b"))}
    met = told.repartition("cell").groupBy("cell").agg(*[g(c).alias(f"_{n}{k}") for n, c in of.items() for g, k in ((F.min, "0"), (F.max, "1"))]).filter("_f0 IS NOT NULL OR _r0 IS NOT NULL")
    bad = F.when(F.col("_f0") != F.col("_f1"), "many_first").when(F.col("_r0") != F.col("_r1"), "many_rest").when(F.col("_b0") != F.col("_b1"), "many_before").when(F.col("_f0").isNull(), "no_first").when(F.col("_r0").isNull(), "no_rest")
    linked, _ = staged(met.select("cell", F.col("_f0").alias("_first"), F.col("_b0.node").alias("_before"), bad.alias("_bad"), F.coalesce(F.col("_r0.node") == RDF + "nil", F.lit(False)).alias("_last")), "cells")
    # ptr: a cell d steps before, low: the least of those d cells; done where ptr is the head, loop where there is none
    head = F.col("_before").isNull()
    level = linked.select("cell", F.coalesce("_before", "cell").alias("ptr"), F.when(head, 0).otherwise(1).cast("long").alias("d"), F.col("_before").alias("low"), head.alias("done"), F.lit(False).alias("loop"), F.col("_bad").isNotNull().alias("bad"), F.col("_last").alias("last"))
    parts = []
    while True:
        parts.append(level.filter("done").withColumn("low", F.lit(None).cast("string")))
        open_ = level.filter("NOT done")
        if open_.isEmpty():
            break
        # heads point to themselves at no distance; what is done is neither joined nor written again
        far = reduce(DataFrame.unionByName, [*parts, open_]).select(F.col("cell").alias("ptr"), F.col("ptr").alias("_p"), F.col("d").alias("_d"), F.col("low").alias("_low"), F.col("done").alias("_done"), F.col("loop").alias("_loop"))
        # the cells before a cell and those before them are others, unless they go round
        round_ = ~F.col("_done") & (F.col("low") == F.col("_low"))
        step = open_.join(far, "ptr").select("cell", F.col("_p").alias("ptr"), (F.col("d") + F.col("_d")).alias("d"), F.least("low", "_low").alias("low"), (F.col("_done") | round_).alias("done"), (F.col("_loop") | round_).alias("loop"), "bad", "last")
        level, _ = staged(step, "ranks")
    ranked = reduce(DataFrame.unionByName, parts).select("cell", F.col("ptr").alias("head"), "d", "loop", "bad", "last")
    listed = ranked.filter("NOT loop")
    lost = listed.filter("bad").select("head").distinct()
    # a list whose last cell leads to no cell has no end
    ends = listed.filter("last").select("head").distinct()
    whole = listed.select("cell", "head", "d", "bad").join(lost, "head", "left_anti")
    members = whole.join(ends, "head", "left_semi").join(linked.select("cell", "_first"), "cell").select("head", F.col("d").alias("pos"), F.col("_first.node").alias("node"), F.col("_first.o").alias("o"), F.col("_first.o_kind").alias("o_kind"))
    no_end = ranked.filter("loop AND NOT bad").select("cell").unionByName(whole.filter("NOT bad").join(ends, "head", "left_anti").select("cell"))
    faults = linked.filter("_bad IS NOT NULL").select(F.col("cell").alias("node"), F.col("_bad").alias("fault")).unionByName(no_end.select(F.col("cell").alias("node"), F.lit("no_end").alias("fault")))
    return members, faults
