"""JSON instances of classes that contain themselves, to any depth: a worklist of objects, level by level.

A frontier holds the objects that are still to be checked, each with its row, its place (a JSON pointer) and
its class. One step checks the members of them all by class, puts the objects inside them into the next
frontier, and writes both; it ends with a frontier that is empty, after as many steps as documents are deep.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.operators.validate import json_branches, json_checks
from typeloom.plans.catalog import Attribute, Catalog
from typeloom.plans.model import Element
from typeloom.session import staged

_TRAIL = "array<struct<path:string,branch:int,n:int>>"
_ITEM = f"struct<path:string,constraint:string,trail:{_TRAIL},cls:string,skip:string,body:string>"


def _none() -> Column:
    return F.array().cast(f"array<{_ITEM}>")


def _members(v: Column) -> Column:
    """The members of an object, null for what is none; nothing below them is looked at."""
    return F.try_variant_get(v, "$", "map<string,variant>")


class _Step:
    """What one object holds, as an array of items: broken constraints, and objects for the next step.

    ``path`` and ``trail`` are Columns: the place of a value, and the choices (any_of) around it, each with the
    branch taken and their number.
    """

    def __init__(self, catalog: Catalog, closed: bool):
        self.catalog, self.closed = catalog, closed

    def fault(self, bad: Column, path: Column, kind: str, trail: Column) -> Column:
        item = F.struct(path.alias("path"), F.lit(kind).alias("constraint"), trail.alias("trail"), *[F.lit(None).cast("string").alias(c) for c in ("cls", "skip", "body")])
        return F.when(F.coalesce(bad, F.lit(True)), F.array(item).cast(f"array<{_ITEM}>")).otherwise(_none())

    def child(self, cls: Element, v: Column, path: Column, trail: Column, skip: str | None = None) -> Column:
        """An object for the next step; what is no object breaks its type."""
        item = F.struct(path.alias("path"), F.lit(None).cast("string").alias("constraint"), trail.alias("trail"), F.lit(cls.name).alias("cls"), F.lit(skip).cast("string").alias("skip"), F.to_json(v).alias("body"))
        return F.when(_members(v).isNotNull(), F.array(item).cast(f"array<{_ITEM}>")).otherwise(self.fault(F.lit(True), path, "type", trail))

    def value(self, attribute: Attribute, v: Column, path: Column, trail: Column) -> Column:
        if attribute.kind == "any":
            return _none()
        if attribute.kind == "inline":
            return self.child(attribute.range, v, path, trail)
        found = [self.fault(F.coalesce(wrong, F.lit(False)), path, kind, trail) for kind, wrong in json_checks(self.catalog, attribute, v)]
        return F.concat(*found) if found else _none()

    def choice(self, items: Sequence[Column], at: Column, trail: Column) -> Column:
        """Items of several branches, of which one must hold none: each is marked with its branch, after the choices around it."""

        def marked(found: Column, branch: int) -> Column:
            taken = F.array(F.struct(at.alias("path"), F.lit(branch).alias("branch"), F.lit(len(items)).alias("n"))).cast(_TRAIL)
            inner = lambda x: F.slice(x["trail"], F.size(trail) + 1, F.size(x["trail"]) - F.size(trail))
            return F.transform(found, lambda x: x.withField("trail", F.concat(trail, taken, inner(x))))

        return F.concat(*[marked(found, i) for i, found in enumerate(items)])

    def one(self, attribute: Attribute, v: Column, path: Column, trail: Column) -> Column:
        branches = json_branches(self.catalog, attribute)
        if not branches:
            return self.value(attribute, v, path, trail)
        return self.choice([self.value(b, v, path, trail) for b in branches], path, trail)

    def slot(self, attribute: Attribute, v: Column, path: Column, trail: Column) -> Column:
        """The items of a slot's value, which is not null."""
        if not attribute.slot.get("multivalued"):
            return self.one(attribute, v, path, trail)
        form = attribute.form
        if form is not None and form.key is not None:
            entries = F.map_entries(_members(v))
            held = F.flatten(F.transform(entries, lambda e: self.entry(attribute, e["key"], e["value"], F.concat(path, F.lit("/"), pointer(e["key"])), trail)))
            return F.when(entries.isNotNull(), held).otherwise(self.fault(F.lit(True), path, "form", trail))
        items = F.try_variant_get(v, "$", "array<variant>")

        def item(x: Column, i: Column) -> Column:
            at = F.concat(path, F.lit("/"), i.cast("string"))
            return F.when(x.isNull() | F.is_variant_null(x), self.fault(F.lit(True), at, "null_item", trail)).otherwise(self.one(attribute, x, at, trail))

        return F.when(items.isNotNull(), F.flatten(F.transform(items, item))).otherwise(self.fault(F.lit(True), path, "form", trail))

    def entry(self, attribute: Attribute, k: Column, v: Column, path: Column, trail: Column) -> Column:
        """An entry of a dictionary: its key has the key slot's checks, its value is an object without the key."""
        cls, form = attribute.range, attribute.form
        inner = self.catalog.attributes(cls)
        keys = [self.fault(F.coalesce(wrong, F.lit(False)), path, f"key_{kind}", trail) for kind, wrong in json_checks(self.catalog, inner[form.key], None, k)]
        whole = self.child(cls, v, path, trail, form.key)
        is_object = _members(v).isNotNull()
        if form.name == "simple_dict":
            value = inner[form.value]
            simple = self.slot(value, v, path, trail)
            nested = value.kind == "inline" or value.slot.get("multivalued") or json_branches(self.catalog, value)
            if value.kind == "any" and not nested:
                body = _none()
            else:
                body = F.when(is_object, self.choice([whole, simple], path, trail) if nested else whole).otherwise(simple)
            body = F.when(F.is_variant_null(v), self.fault(F.lit(value.kind != "any"), path, "type", trail)).otherwise(body)
        else:
            needs = any(a.slot.get("required") for a in inner.values() if a.slot.name != form.key)
            body = F.when(F.is_variant_null(v), self.fault(F.lit(needs), path, "required", trail)).otherwise(whole)
        return F.concat(*keys, body)

    def object(self, cls: Element, v: Column, path: Column, trail: Column, skip: Column) -> Column:
        parts, attributes = [], self.catalog.attributes(cls).values()
        for attribute in attributes:
            at = F.concat(path, F.lit("/" + attribute.name.replace("~", "~0").replace("/", "~1")))
            value = F.try_variant_get(v, f"$['{attribute.name}']", "variant")
            needed = F.lit(bool(attribute.slot.get("required"))) & ~F.coalesce(skip == attribute.slot.name, F.lit(False))
            parts.append(F.when(value.isNull() | F.is_variant_null(value), self.fault(needed, at, "required", trail)).otherwise(self.slot(attribute, value, at, trail)))
        if self.closed:
            known = F.array(*[F.lit(a.name) for a in attributes]).cast("array<string>")
            extra = F.array_except(F.map_keys(_members(v)), known)
            parts.append(F.flatten(F.transform(extra, lambda k: self.fault(F.lit(True), F.concat(path, F.lit("/"), pointer(k)), "extra", trail))))
        return F.concat(*parts) if parts else _none()


def pointer(name: Column) -> Column:
    """A member's name as a step of a JSON pointer."""
    return F.replace(F.replace(name, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def _contained(catalog: Catalog, cls: str) -> list[Element]:
    """The class and all that its instances can hold inline, by ranges, branches of choices and dictionary values."""
    found, stack = {}, [catalog.classes[cls]]
    while stack:
        c = stack.pop()
        if c.name not in found:
            found[c.name] = c
            for a in catalog.attributes(c).values():
                stack += [x.range for x in (a, *json_branches(catalog, a)) if x.kind == "inline"]
    return list(found.values())


def json_faults(rows: DataFrame, catalog: Catalog, cls: str, keys: Sequence[str], json: str = "json", closed: bool = True) -> DataFrame:
    """keys, path, constraint: a row for each broken constraint of each JSON text, objects checked to any depth.

    ``path`` is a JSON pointer, '' for the whole text; a text that is null, no JSON or no object breaks ``json``.
    Constraints are those of ``validate.json_valid``, which is true where this gives no row. A value that fits no branch
    of a choice breaks ``any_of``, whatever is wrong inside each. Rows that repeat a key are told apart by their faults
    only. A step costs a job over the objects of one level; what is shuffled are the faults inside choices alone.
    """
    step, classes = _Step(catalog, closed), _contained(catalog, cls)
    empty = F.array().cast(_TRAIL)
    none = F.lit(None).cast("string")
    v = F.try_parse_json(json)
    whole = F.when(_members(v).isNotNull(), F.lit(cls))
    # rows are numbered, as choices are settled row by row
    first = rows.select(*keys, F.col(json).alias("_body"), F.monotonically_increasing_id().alias("_row"), whole.alias("_cls"))
    head = [F.lit("").alias("path"), F.when(F.col("_cls").isNull(), "json").alias("constraint"), empty.alias("trail"), F.col("_cls").alias("cls"), none.alias("skip"), F.when(F.col("_cls").isNotNull(), F.col("_body")).alias("body")]
    level, _ = staged(first.select(*keys, "_row", *head), "json-level")
    found = level.filter("constraint IS NOT NULL")
    by_class = _none()
    for c in classes:
        by_class = F.when(F.col("cls") == c.name, step.object(c, F.col("_v"), F.col("path"), F.col("trail"), F.col("skip"))).otherwise(by_class)
    while True:
        open_ = level.filter("constraint IS NULL").withColumn("_v", F.try_parse_json("body"))
        if open_.isEmpty():
            break
        items = open_.select(*keys, "_row", F.explode(by_class).alias("_i")).select(*keys, "_row", "_i.*")
        level, _ = staged(items, "json-level")
        found = found.unionByName(level.filter("constraint IS NOT NULL"))
    return _settled(found.select(*keys, "_row", "path", "constraint", "trail"), keys).select(*keys, "path", "constraint")


def _settled(faults: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Faults outside of choices; those inside count where every branch of the choice has one, innermost first."""
    depth = faults.agg(F.max(F.size("trail"))).first()[0] or 0
    settled = faults.filter(F.size("trail") == 0)
    if not depth:
        return settled
    inside, _ = staged(faults.filter(F.size("trail") > 0), "json-choices")
    for at in range(depth, 0, -1):
        last = F.element_at("trail", -1)
        outer = F.slice("trail", 1, F.size("trail") - 1)
        held = inside.filter(F.size("trail") == at).select(*keys, "_row", last["path"].alias("path"), outer.alias("trail"), last["branch"].alias("_b"), last["n"].alias("_n"))
        # one row a branch before anything is counted
        broken = held.groupBy(*keys, "_row", "path", "trail", "_n").agg(F.count_distinct("_b").alias("_k")).filter("_k = _n")
        choices, _ = staged(broken.select(*keys, "_row", "path", F.lit("any_of").alias("constraint"), "trail"), "json-choices")
        inside, settled = inside.unionByName(choices), settled.unionByName(choices.filter(F.size("trail") == 0))
    return settled
