"""What elements of schemas reach, over tables: a node is a kind and a name, edges come from all that an element says.

A name in a range, a union branch, a domain, a base type, a union of types or an inherited enumeration means the class,
else the type, else the enumeration that has it; a parent is of its child's kind. Names that mean nothing lead nowhere.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.plans.catalog import Catalog
from typeloom.session import staged

#: In order: the first kind that has a name is what a range means.
RANGE_KINDS = ("class", "type", "enum")


def catalog_uses(spark: SparkSession, catalog: Catalog) -> dict[str, DataFrame]:
    """elements, class_parents, slot_parents, derived, class_slots, slots, types and enums of a catalog, for the functions below."""
    body = lambda m: (m.get("range"), [x.get("range") for x in m.get("any_of") or []], m.get("domain"))
    parents = lambda e: [m for m in [*e.get("mixins"), e.meta.get("is_a")] if m is not None]
    derived, written = [], []
    for c in catalog.classes.values():
        for name, s in catalog.derived_slots(c).items():
            derived.append((c.name, name, catalog.range_of(s), [x.get("range") for x in s.get("any_of")], s.meta.get("domain"), catalog.inlined(s)))
        written += [(c.name, name, source, *body(m)) for source, metaslot in (("attribute", "attributes"), ("slot_usage", "slot_usage")) for name, m in (c.meta.get(metaslot) or {}).items()]
        written += [(c.name, name, "slot", None, [], None) for name in c.get("slots")]
    said = "range string, any_of array<string>, domain string"
    return {
        "elements": spark.createDataFrame([(e.kind, e.name) for group in catalog.by_kind.values() for e in group.values()], "kind string, name string"),
        "class_parents": spark.createDataFrame([(c.name, p) for c in catalog.classes.values() for p in parents(c)], "cls string, parent string"),
        "slot_parents": spark.createDataFrame([(s.name, p) for s in catalog.slots.values() for p in parents(s)], "slot string, parent string"),
        "derived": spark.createDataFrame(derived, f"cls string, slot string, {said}, inlined boolean"),
        "class_slots": spark.createDataFrame(written, f"cls string, slot string, source string, {said}"),
        "slots": spark.createDataFrame([(s.name, *body(s.meta)) for s in catalog.slots.values()], f"slot string, {said}"),
        "types": spark.createDataFrame([(t.name, t.meta.get("typeof"), list(t.get("union_of"))) for t in catalog.types.values()], "type string, typeof string, union_of array<string>"),
        "enums": spark.createDataFrame([(e.name, list(e.get("inherits"))) for e in catalog.enums.values()], "enum string, inherits array<string>"),
    }


def _uses(table: DataFrame, kind: str, key: str, columns: dict[str, str], inlined: Column | None = None) -> DataFrame:
    """src_kind, src, how, name, inlined: a row for each name in the given columns (column -> how), lists or not; one pass."""

    def use(how: str) -> Callable[[Column], Column]:
        inline = F.coalesce(inlined, F.lit(False)) if inlined is not None and how == "range" else F.lit(True)
        return lambda x: F.struct(F.lit(how).alias("how"), x.cast("string").alias("name"), inline.alias("inlined"))

    named = []
    for column, how in columns.items():
        c = F.col(f"`{column}`")
        many = isinstance(table.schema[column].dataType, T.ArrayType)
        named.append(F.transform(F.coalesce(c, F.array().cast("array<string>")), use(how)) if many else F.array(use(how)(c)))
    return table.select(F.lit(kind).alias("src_kind"), F.col(f"`{key}`").alias("src"), F.explode(F.concat(*named)).alias("_u")).select("src_kind", "src", "_u.*").filter("src IS NOT NULL AND name IS NOT NULL")


def _of_slots(table: DataFrame) -> dict[str, str]:
    return {c: c for c in ("range", "any_of", "domain") if c in table.columns}


def _of_types(types: DataFrame | None, enums: DataFrame | None) -> list[DataFrame]:
    return ([_uses(types, "type", "type", {"typeof": "typeof", "union_of": "union_of"})] if types is not None else []) + ([_uses(enums, "enum", "enum", {"inherits": "inherits"})] if enums is not None else [])


def derived_uses(derived: DataFrame, class_parents: DataFrame | None = None, types: DataFrame | None = None, enums: DataFrame | None = None) -> DataFrame:
    """What classes say by their derived slots (cls, range, and any_of, domain, inlined where there are such columns) and
    by their parents, if given, and what types and enumerations say. Where ``inlined`` is missing or null a range is by reference."""
    inlined = F.col("inlined") if "inlined" in derived.columns else None
    parts = [_uses(derived, "class", "cls", _of_slots(derived), inlined if inlined is not None else F.lit(False)), *_of_types(types, enums)]
    if class_parents is not None:
        parts.append(_uses(class_parents, "class", "cls", {"parent": "parent"}))
    return reduce(DataFrame.unionByName, parts)


def written_uses(class_slots: DataFrame, class_parents: DataFrame, slots: DataFrame | None = None, slot_parents: DataFrame | None = None, types: DataFrame | None = None, enums: DataFrame | None = None) -> DataFrame:
    """What elements say as written: classes by attributes, usages, the slots they name and their parents, slots by themselves and theirs."""
    own = class_slots.filter("source <> 'slot'")
    parts = [_uses(own, "class", "cls", _of_slots(own)), _uses(class_slots.filter("source = 'slot'"), "class", "cls", {"slot": "slot"}), _uses(class_parents, "class", "cls", {"parent": "parent"}), *_of_types(types, enums)]
    if slots is not None:
        parts.append(_uses(slots, "slot", "slot", _of_slots(slots)))
    if slot_parents is not None:
        parts.append(_uses(slot_parents, "slot", "slot", {"parent": "parent"}))
    return reduce(DataFrame.unionByName, parts)


def typed_edges(uses: DataFrame, elements: DataFrame, inlined_only: bool = False) -> DataFrame:
    """src_kind, src, dst_kind, dst: uses whose names mean an element (kind, name). With ``inlined_only`` the range of a
    slot counts only where it is no class or is inlined."""
    rank = F.create_map(*[F.lit(x) for pair in {k: i for i, k in enumerate(RANGE_KINDS)}.items() for x in pair])
    # a row for each name and way to mean it: as a range, and as each kind
    means = elements.filter(F.col("kind").isin(*RANGE_KINDS)).groupBy("name").agg(F.min_by("kind", F.try_element_at(rank, F.col("kind"))).alias("dst_kind")).select("name", F.lit("range").alias("_way"), "dst_kind")
    means = means.unionByName(elements.filter("kind IS NOT NULL AND name IS NOT NULL").select("name", F.col("kind").alias("_way"), F.col("kind").alias("dst_kind")).distinct())
    way = F.when(F.col("how") == "parent", F.col("src_kind")).when(F.col("how") == "slot", "slot").otherwise("range")
    found = uses.withColumn("_way", way).join(means, ["name", "_way"])
    if inlined_only:
        found = found.filter("how <> 'range' OR dst_kind <> 'class' OR inlined")
    return found.select("src_kind", "src", "dst_kind", F.col("name").alias("dst")).distinct()


def reached(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """kind, name, depth: what any of the seeds (kind, name) reaches, itself included, at the fewest steps.

    All seeds go one step at a time, so a node is met once however many seeds reach it. Each step's new nodes are written
    to the shared folder; the work is one join of them with the edges a step.
    """
    e, _ = staged(edges.select("src_kind", "src", "dst_kind", "dst").distinct(), "typed-edges")
    depth = 0
    seen, _ = staged(seeds.select("kind", "name").filter("kind IS NOT NULL AND name IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "reached")
    frontier = seen
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(e, (F.col("kind") == F.col("src_kind")) & (F.col("name") == F.col("src"))).select(F.col("dst_kind").alias("kind"), F.col("dst").alias("name")).distinct()
        frontier, _ = staged(step.join(seen, ["kind", "name"], "left_anti").withColumn("depth", F.lit(depth)), "reached")
        seen = seen.unionByName(frontier)
    return seen


def kept(elements: DataFrame, edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows of elements (kind, name) that a generator keeps: those that the seeds reach."""
    return elements.join(reached(edges, seeds).select("kind", "name"), ["kind", "name"], "left_semi")
