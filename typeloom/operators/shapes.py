"""Shapes of a catalog's classes over a table of triples: which nodes break which constraint, as SHACL has it.

The shapes are those that ``rdf.shacl`` writes. They become a small table of rules, a row a class and property;
the triples are joined once with the shapes that hold for their subjects, and what breaks a rule alone goes on. Counts
are made by node and path, before any shape is looked at. No graph is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.operators.rdf import BLANK, IRI, LITERAL, RDF, XSD
from typeloom.operators.validate import LEXICAL
from typeloom.plans.catalog import Attribute, Catalog
from typeloom.plans.model import Element
from typeloom.session import staged

TYPE = RDF + "type"
_BRANCH = "struct<kind:string,datatype:string,lexical:string,classes:array<string>,values:array<string>>"
_RULES = f"shape string, p string, most_one boolean, choice boolean, branches array<{_BRANCH}>"


def _branch(catalog: Catalog, attribute: Attribute, written: dict, below: dict[str, list[str]]) -> tuple:
    """What a value must be: kind of node, datatype and its form, classes (one of them), values (one of them)."""
    target = attribute.range
    if attribute.kind == "any":
        return None, None, None, None, None
    if target.kind == "class":
        return "BlankNodeOrIRI", None, None, below[target.name], None
    if target.kind == "enum":
        return None, None, None, None, list(catalog.meanings(target).values())
    if catalog.is_iri(target) or written.get("implicit_prefix"):
        return "IRI", None, None, None, None
    return "Literal", catalog.uri(target), LEXICAL.get(catalog.runtime_type(target)), None, None


def rules(catalog: Catalog, open_: bool = False) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """The rules (shape, p, most_one, choice, branches), the shapes (shape, closed, ignored, required) and the
    classes (type, shape): those whose shapes hold for a node of a type, its own and its ancestors'."""
    below: dict[str, list[str]] = {name: [] for name in catalog.classes}
    classes = set()
    for cls in catalog.classes.values():
        for up in catalog.ancestors(cls):
            below[up.name].append(catalog.uri(cls))
            classes.add((catalog.uri(cls), catalog.uri(up)))
    out, shapes = {}, {}
    for cls in catalog.classes.values():
        uri, required = catalog.uri(cls), set()
        key = catalog.identifier(cls)
        for attribute in catalog.attributes(cls).values():
            slot = attribute.slot
            if slot.get("identifier"):
                continue
            p = catalog.uri(slot)
            if slot.get("required"):
                required.add(p)
            branches = [_branch(catalog, catalog.attribute(Element(slot.name, "slot", slot.schema, dict(b))), b, below) for b in slot.get("any_of")]
            out[uri, p] = (uri, p, not slot.get("multivalued"), bool(branches), branches or [_branch(catalog, attribute, slot.meta, below)])
        closed = not (open_ or cls.get("abstract") or cls.get("mixin"))
        shapes[uri] = (uri, closed, [TYPE, *([key.meta["slot_uri"]] if key else [])], sorted(required))
    return list(out.values()), list(shapes.values()), sorted(classes)


def _faults(b: Column, o: Column, kind: Column, datatype: Column, types: Column) -> list[tuple[str, Column]]:
    """Constraint and whether a value breaks it, for one branch."""
    written = F.coalesce(datatype, F.lit(XSD + "string"))
    of_kind = F.when(b["kind"] == "IRI", kind == IRI).when(b["kind"] == "Literal", kind == LITERAL).when(b["kind"] == "BlankNodeOrIRI", kind.isin(IRI, BLANK)).otherwise(F.lit(True))
    typed = b["datatype"].isNull() | ((kind == LITERAL) & (written == b["datatype"]) & F.coalesce(F.rlike(o, b["lexical"]), F.lit(True)))
    classed = b["classes"].isNull() | F.coalesce(F.arrays_overlap(types, b["classes"]), F.lit(False))
    listed = b["values"].isNull() | ((kind == IRI) & F.array_contains(b["values"], o))
    return [("nodeKind", ~of_kind), ("datatype", ~typed), ("class", ~classed), ("in", ~F.coalesce(listed, F.lit(False)))]


def _mark() -> Column:
    """A number of a triple's value; unlike ones are of unlike values."""
    return F.xxhash64("o", "o_kind", "o_datatype")


def shape_violations(triples: DataFrame, catalog: Catalog, open_: bool = False, hierarchy: bool = True) -> DataFrame:
    """s, shape, path, constraint, value: what nodes of the triples (s, p, o, o_kind, o_datatype) break.

    A node is judged by the shapes of its classes and of their ancestors; with ``hierarchy`` False of its own classes
    only. As in SHACL, a closed shape of a parent also rejects what only a child class has, so that a hierarchy to be
    used so has abstract parents. Constraints are SHACL's: minCount and maxCount (value null), nodeKind, datatype (a
    literal of another type, or of no valid form), class, in, or (no branch of a choice fits) and closed, the value
    being that which breaks it. Repeated triples count once, as in any graph; nodes without a known class are not
    judged, and triples with a null node, predicate or object are none.

    The rules are as many as the schema's class attributes; triples are shuffled by subject, and references once by object.
    Of triples only those that break a rule are told apart from their repeats.
    """
    spark = triples.sparkSession
    rule_rows, shape_rows, class_rows = rules(catalog, open_)
    ruled = spark.createDataFrame(rule_rows, _RULES)
    shapes = spark.createDataFrame(shape_rows, "shape string, closed boolean, ignored array<string>, required array<string>")
    above: dict[str, list[str]] = {}
    for type_, shape in class_rows:
        above.setdefault(type_, []).extend([shape] if hierarchy or type_ == shape else [])
    classes = spark.createDataFrame(list(above.items()), "type string, shapes array<string>")
    required = sorted({p for row in shape_rows for p in row[3]})
    single = sorted({row[1] for row in rule_rows if row[2]})
    pointing = sorted({row[1] for row in rule_rows if any(b[3] is not None for b in row[4])})
    graph = triples.select("s", "p", "o", "o_kind", "o_datatype").filter("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")

    # what is known of each node: its classes of the schema, their shapes, and which of the required properties it has
    told = graph.select("s", F.when((F.col("p") == TYPE) & (F.col("o_kind") == IRI), F.col("o")).alias("type"), F.when(F.col("p").isin(required), F.col("p")).alias("p"))
    told = told.filter("type IS NOT NULL OR p IS NOT NULL").join(F.broadcast(classes), "type", "left")
    typed = F.collect_set(F.when(F.col("shapes").isNotNull(), F.col("type")))
    nodes = told.groupBy("s").agg(typed.alias("types"), F.array_distinct(F.flatten(F.collect_set("shapes"))).alias("shapes"), F.collect_set("p").alias("had"))
    nodes, _ = staged(nodes.filter(F.size("types") > 0), "nodes")

    # a type alone breaks nothing, as every shape ignores it, unless a rule is about it
    judged = graph if any(row[1] == TYPE for row in rule_rows) else graph.filter(F.col("p") != TYPE)
    refers = F.col("p").isin(pointing) & F.coalesce(F.col("o_kind") != LITERAL, F.lit(True))
    referring = judged.filter(refers).join(nodes.select(F.col("s").alias("o"), "types"), "o", "left")
    plain = judged.filter(~refers).withColumn("types", F.lit(None).cast("array<string>"))
    each = referring.unionByName(plain).join(nodes.select("s", "shapes"), "s").withColumn("shape", F.explode("shapes"))
    each = each.join(F.broadcast(ruled), ["shape", "p"], "left").join(F.broadcast(shapes.select("shape", "closed", "ignored")), "shape")
    o, kind, datatype, types = (F.col(c) for c in ("o", "o_kind", "o_datatype", "types"))
    one = _faults(F.col("branches")[0], o, kind, datatype, types)

    def none_fits(b: Column) -> Column:
        bad = F.lit(False)
        for _, broken in _faults(b, o, kind, datatype, types):
            bad = bad | broken
        return bad

    nothing = F.array().cast("array<string>")
    named = F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in one]))
    listed = F.when(F.col("choice"), F.when(F.forall("branches", none_fits), F.array(F.lit("or"))).otherwise(nothing)).otherwise(named)
    extra = F.when(F.col("closed") & ~F.array_contains("ignored", F.col("p")), F.array(F.lit("closed"))).otherwise(nothing)
    broken = F.when(F.col("branches").isNull(), extra).otherwise(listed)
    values = each.select("s", "shape", F.col("p").alias("path"), F.explode(broken).alias("constraint"), F.col("o").alias("value"), "o_kind", "o_datatype").distinct().drop("o_kind", "o_datatype")

    no_value = F.lit(None).cast("string").alias("value")
    # values with unlike marks are two; those with one mark may be one that repeats, and are compared as they are
    valued = graph.filter(F.col("p").isin(single))
    several = valued.groupBy("s", "p").agg(F.count(F.lit(1)).alias("n"), F.min(_mark()).alias("low"), F.max(_mark()).alias("high"))
    several, _ = staged(several.filter("n > 1"), "several")
    many, alike = several.filter("low <> high").select("s", "p"), several.filter("low = high").select("s", "p")
    if not alike.isEmpty():
        many = many.unionByName(valued.join(alike, ["s", "p"], "left_semi").distinct().groupBy("s", "p").count().filter("count > 1").select("s", "p"))
    many = many.join(nodes.select("s", "shapes"), "s").select("s", "p", F.explode("shapes").alias("shape")).join(F.broadcast(ruled.filter("most_one")), ["shape", "p"])
    many = many.select("s", "shape", F.col("p").alias("path"), F.lit("maxCount").alias("constraint"), no_value)
    missing = nodes.select("s", "had", F.explode("shapes").alias("shape")).join(F.broadcast(shapes.select("shape", "required")), "shape")
    missing = missing.select("s", "shape", F.explode(F.array_except("required", "had")).alias("path"), F.lit("minCount").alias("constraint"), no_value)
    return values.unionByName(many).unionByName(missing)
