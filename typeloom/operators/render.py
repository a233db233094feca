"""Documents from a catalog: JSON Schema, table schema, merged schema, GraphQL, ER diagram, Spark types."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation

from pyspark.sql import types as T

from typeloom.plans.catalog import Attribute, Catalog, Form
from typeloom.plans.model import BASES, Element
from typeloom.sources.documents import encode

# Each kind of value in the other type systems.
_JSON = {
    "string": {"type": "string"},
    "integer": {"type": "integer"},
    "boolean": {"type": "boolean"},
    "float": {"type": "number"},
    "double": {"type": "number"},
    "decimal": {"type": "number"},
    "date": {"type": "string", "format": "date"},
    "datetime": {"type": "string", "format": "date-time"},
    "time": {"type": "string", "format": "time"},
    "uri": {"type": "string", "format": "uri"},
    "curie": {"type": "string", "format": "curie"},
    "uriorcurie": {"anyOf": [{"type": "string", "format": "uri"}, {"type": "string", "format": "curie"}]},
    "ncname": {"type": "string", "format": "ncname"},
    "any": {},
}
_TABLE = {
    "string": ("string", None),
    "integer": ("integer", None),
    "boolean": ("boolean", None),
    "float": ("number", None),
    "double": ("number", None),
    "decimal": ("number", None),
    "date": ("date", "any"),
    "datetime": ("datetime", "any"),
    "time": ("time", "any"),
    "uri": ("string", "uri"),
    "curie": ("string", None),
    "uriorcurie": ("string", None),
    "ncname": ("string", None),
    "any": ("any", None),
}
_GRAPHQL = {"string": "String", "ncname": "String", "integer": "Int", "boolean": "Boolean", "float": "Float", "double": "Float"}


def _number(text: str | None):
    try:
        found = Decimal(str(text).strip()) if text is not None else None
    except InvalidOperation:
        return None
    if found is None:
        return None
    return int(found) if found == found.to_integral_value() else float(found)


def _described(out: dict, element: Element) -> dict:
    return out | {k: element.meta[k] for k in ("title", "description") if element.meta.get(k)}


def json_schema(catalog: Catalog, open_: bool = False, tree_root: str | None = None, root_form: str | None = None, class_name: Callable[[Element], str] | None = None, slot_name: Callable[[Attribute], str] | None = None) -> dict:
    """JSON Schema 2020-12 of what the tree root holds inline, or of all classes without a root; all enums.

    ``class_name`` and ``slot_name`` name the definitions and their properties, in place of aliases.
    """
    root = catalog.tree_root(tree_root)
    class_name = class_name or catalog.alias
    slot_name = slot_name or (lambda a: a.name)
    kept = None if root is None else catalog.reachable([root], ancestors=False, inlined_only=True)
    keyless: dict[tuple[str, str], None] = {}
    valued: dict[tuple[str, str], None] = {}

    def dict_of(cls: Element, form: Form) -> dict:
        name, slots = class_name(cls), catalog.attributes(cls)
        if form.name == "simple_dict":
            valued[name, slot_name(slots[form.value])] = None
            ref = f"#/$defs/{name}__simple_dict_value"
        else:
            keyless[name, slot_name(slots[form.key])] = None
            ref = f"#/$defs/{name}__identifier_optional"
        return {"type": "object", "additionalProperties": {"$ref": ref}}

    def scalar(attribute: Attribute) -> dict:
        out = dict(_JSON[catalog.runtime_type(attribute.range)])
        for metaslot, key in (("minimum_value", "minimum"), ("maximum_value", "maximum")):
            value = _number(attribute.merged(metaslot))
            if value is not None:
                out[key] = value
        if attribute.merged("pattern") is not None:
            out["pattern"] = attribute.merged("pattern")
        return out

    made: dict[int, dict] = {}  # classes share the attributes that they inherit

    def of(attribute: Attribute) -> dict:
        if id(attribute) not in made:
            made[id(attribute)] = fresh(attribute)
        return made[id(attribute)]

    def fresh(attribute: Attribute) -> dict:
        many = attribute.slot.get("multivalued")
        listed = lambda one: {"type": "array", "items": one} if many else one
        if attribute.kind == "any":
            out = {}
        elif attribute.kind == "inline":
            ref = {"$ref": f"#/$defs/{class_name(attribute.range)}"}
            form = attribute.form
            out = dict_of(attribute.range, form) if form.key else {"type": "array", "items": ref} if form.name == "list" else ref
        elif attribute.kind == "reference":
            out = listed(scalar(attribute.identifier) | {"$comment": f"Reference to {attribute.range.name} class"})
        elif attribute.kind == "enum":
            out = listed({"$ref": f"#/$defs/{attribute.range.name}"})
        else:
            out = listed(scalar(attribute))
        return _described(out, attribute.slot)

    defs: dict[str, dict] = {}
    for cls in catalog.classes.values():
        if kept is not None and ("class", cls.name) not in kept:
            continue
        own = {slot_name(a): a for a in catalog.attributes(cls).values()}
        body: dict = {"type": "object", "properties": {n: of(a) for n, a in own.items()}}
        required = [n for n, a in own.items() if a.slot.get("required")]
        if required:
            body["required"] = required
        defs[class_name(cls)] = _described(body | {"additionalProperties": open_}, cls)
    out: dict = {"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": catalog.root.id, "title": catalog.root.meta.get("title") or catalog.root.name}
    if catalog.root.meta.get("description"):
        out["description"] = catalog.root.meta["description"]
    if root is not None:
        form, ref = catalog.root_form(root, root_form), {"$ref": f"#/$defs/{class_name(root)}"}
        out |= {"plain": ref, "optional": {"oneOf": [ref, {"type": "null"}]}, "list": {"type": "array", "items": ref}}.get(form.name) or dict_of(root, form)
    for name, key in keyless:
        copy = dict(defs[name])
        copy["required"] = [r for r in copy.get("required", []) if r != key]
        if not copy["required"]:
            del copy["required"]
        defs[f"{name}__identifier_optional"] = copy
    for name, value in valued:
        defs[f"{name}__simple_dict_value"] = defs[name]["properties"][value]
    for enum in catalog.enums.values():
        defs[enum.name] = _described({"type": "string", "enum": list(catalog.meanings(enum))}, enum)
    return out | {"$defs": defs}


def _ranked(attributes: dict[str, Attribute]) -> list[Attribute]:
    """By rank, a missing one first, then by name."""
    return sorted(attributes.values(), key=lambda a: (a.slot.meta.get("rank") is not None, a.slot.meta.get("rank") or 0, a.slot.name))


def table_schema(catalog: Catalog, tree_root: str | None = None) -> dict:
    """A Frictionless table schema of the tree root."""
    root = catalog.tree_root(tree_root)
    if root is None:
        raise ValueError("a table schema needs a tree root")
    fields = []
    for attribute in _ranked(catalog.attributes(root)):
        slot, many = attribute.slot, attribute.slot.get("multivalued")
        out: dict = _described({"name": attribute.name}, slot)
        limits: dict = {"required": bool(slot.get("required"))}
        if attribute.kind == "any":
            out |= {"type": "any", "format": "any"}
        elif attribute.kind == "inline":
            out |= {"type": "array" if attribute.form.name == "list" else "object", "rdfType": catalog.uri(attribute.range)}
        elif many:
            out |= {"type": "array", "rdfType": catalog.uri(attribute.range)}
        elif attribute.kind == "enum":
            out |= {"type": "string", "rdfType": catalog.uri(attribute.range)}
            limits["enum"] = list(catalog.meanings(attribute.range))
        else:
            of = attribute.identifier.range if attribute.kind == "reference" else attribute.range
            kind, form = _TABLE[catalog.runtime_type(of)]
            out |= {"type": kind, "rdfType": catalog.uri(attribute.range)} | ({"format": form} if form else {})
            if attribute.kind == "type":
                limits |= {k: v for k, v in (("pattern", attribute.merged("pattern")), ("minimum", attribute.merged("minimum_value")), ("maximum", attribute.merged("maximum_value"))) if v is not None}
        fields.append(out | {"constraints": limits})
    key = catalog.identifier(root)
    return {"fields": fields} | ({"primaryKey": catalog.alias(key)} if key else {})


def merged_schema(catalog: Catalog, pruning: str = "tree_root", derive: bool = True) -> dict:
    """The schema and its imports as one; classes are derived or kept as they are, unreached elements left out."""
    kept = catalog.pruning(pruning, derived=derive, ancestors=False)
    out = {k: v for k, v in encode(catalog.root).items() if k not in ("imports", "classes", "slots", "enums", "types")}
    metaslot = {"class": "class_uri", "slot": "slot_uri", "enum": "enum_uri", "type": "uri"}

    def own(e: Element) -> dict:
        return {**e.meta, metaslot[e.kind]: e.meta.get(metaslot[e.kind]) or catalog.uri(e), "from_schema": e.schema.id}

    found = {
        "classes": {n: catalog.materialized(c).meta if derive else own(c) for n, c in catalog.classes.items() if kept(c)},
        "types": {n: own(t) for n, t in catalog.types.items() if kept(t)},
        "enums": {n: own(e) for n, e in catalog.enums.items() if kept(e)},
        "slots": {} if derive else {n: own(s) for n, s in catalog.slots.items() if kept(s)},
    }
    return out | {k: v for k, v in found.items() if v}


def graphql(catalog: Catalog, pruning: str = "skip") -> str:
    """GraphQL definitions: interfaces for abstract classes and mixins, types, enums, scalars."""
    kept = catalog.pruning(pruning, ancestors=False, inlined_only=False)
    abstract = lambda c: c.get("abstract") or c.get("mixin")
    parts: list[str] = []

    def documented(element: Element, indent: str = "") -> str:
        text = element.meta.get("description")
        return f'{indent}"""\n{indent}{text}\n{indent}"""\n' if text else ""

    def ranged(attribute: Attribute) -> str:
        if attribute.kind == "any":
            return "Any"
        if attribute.kind == "type":
            return _GRAPHQL.get(catalog.runtime_type(attribute.range)) or catalog.alias(attribute.range)
        return catalog.alias(attribute.range)

    classes = [c for c in catalog.classes.values() if kept(c)]
    for cls in classes:
        if catalog.is_any(cls):
            continue
        fields = []
        for attribute in catalog.attributes(cls).values():
            kind = ranged(attribute)
            kind = f"[{kind}]!" if attribute.slot.get("multivalued") else kind + "!" * bool(attribute.slot.get("required"))
            fields.append(f"{documented(attribute.slot, '  ')}  {attribute.name}: {kind}")
        above = [catalog.alias(p) for p in catalog.parents(cls) if abstract(p)]
        head = f"{'interface' if abstract(cls) else 'type'} {catalog.alias(cls)}" + (f" implements {' & '.join(above)}" if above else "")
        parts.append(f"{documented(cls)}{head} {{\n" + "\n".join(fields or ["  _: Boolean"]) + "\n}")
    if any(catalog.is_any(c) for c in classes):
        parts.append("scalar Any")
    for enum in catalog.enums.values():
        if kept(enum):
            values = [re.sub(r"^(?=[0-9])", "_", re.sub(r"[^A-Za-z0-9_]", "_", v)) for v in catalog.meanings(enum)]
            parts.append(f"{documented(enum)}enum {catalog.alias(enum)} {{\n" + "\n".join(f"  {v}" for v in values) + "\n}")
    for kind in catalog.types.values():
        if kept(kind) and catalog.runtime_type(kind) not in _GRAPHQL:
            parts.append(f"{documented(kind)}scalar {catalog.alias(kind)}")
    return "# GENERATED BY TYPELOOM\n\n" + "\n\n".join(parts) + "\n"


# Words that Mermaid would read as a direction or as syntax.
_MERMAID_WORDS = frozenset("tb bt rl lr td direction class classdef style title erdiagram one only zero or more many to optionally".split())


def _entity(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) and name.lower() not in _MERMAID_WORDS else '"' + name.replace('"', "'") + '"'


def _token(name: str) -> str:
    out = re.sub(r"[^A-Za-z0-9_\-]", "_", name)
    return out if re.match(r"[A-Za-z_]", out) else "_" + out


def er_diagram(catalog: Catalog, pruning: str = "skip", optional_marker: bool = True) -> str:
    """A Mermaid ER diagram: classes as entities, class-ranged slots as edges between those drawn."""
    kept = catalog.pruning(pruning, ancestors=False, inlined_only=False)
    classes = sorted((c for c in catalog.classes.values() if kept(c) and not catalog.is_any(c)), key=catalog.alias)
    drawn = {c.name for c in classes}
    lines, edges = ["%% GENERATED BY TYPELOOM", "erDiagram"], []
    for cls in classes:
        rows = []
        for attribute in _ranked(catalog.attributes(cls)):
            slot, many = attribute.slot, attribute.slot.get("multivalued")
            if attribute.kind in ("inline", "reference"):
                if attribute.range.name in drawn:
                    end = {(True, True): "|{", (False, True): "o{", (True, False): "||", (False, False): "o|"}[bool(slot.get("required")), bool(many)]
                    line = "--" if attribute.kind == "inline" else ".."
                    edges.append(f'  {_entity(catalog.alias(cls))} ||{line}{end} {_entity(catalog.alias(attribute.range))} : "{attribute.name.replace(chr(34), chr(39))}"')
                continue
            kind = "Any" if attribute.kind == "any" else catalog.alias(attribute.range)
            mark = "[]" * bool(many) + "?" * bool(optional_marker and not slot.get("required"))
            key = " PK" if slot.get("identifier") else " UK" if slot.get("key") else ""
            rows.append(f"    {_token(kind)}{mark} {_token(attribute.name)}{key}")
        name = _entity(catalog.alias(cls))
        lines += [f"  {name} {{", *rows, "  }"] if rows else [f"  {name}"]
    return "\n".join(lines + edges) + "\n"


# -- Spark types

_SPARK = {"string": T.StringType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "decimal(38,18)": T.DecimalType(38, 18), "date": T.DateType(), "timestamp": T.TimestampType()}


def _spark_scalar(catalog: Catalog, kind: Element) -> T.DataType:
    runtime = catalog.runtime_type(kind)
    if runtime == "any":
        return T.VariantType()
    return _SPARK[next(s for r, s in BASES.values() if r == runtime)]


def _spark_type(catalog: Catalog, attribute: Attribute, path: tuple[str, ...]) -> T.DataType:
    if attribute.kind == "any":
        one: T.DataType = T.VariantType()
    elif attribute.kind == "enum":
        one = T.StringType()
    elif attribute.kind == "type":
        one = _spark_scalar(catalog, attribute.range)
    elif attribute.kind == "reference":
        one = _spark_type(catalog, attribute.identifier, path)
    elif attribute.range.name in path:
        one = T.VariantType()  # a class that holds itself: its depth is not bounded
    else:
        one = struct_type(catalog, attribute.range.name, path)
    form = attribute.form
    if form is not None and form.key is not None:
        inner = catalog.attributes(attribute.range)
        key = _spark_type(catalog, inner[form.key], path)
        if form.name == "simple_dict":
            return T.MapType(key, _spark_type(catalog, inner[form.value], (*path, attribute.range.name)))
        rest = T.StructType([f for f in one.fields if f.name != inner[form.key].name]) if isinstance(one, T.StructType) else one
        return T.MapType(key, rest)
    return T.ArrayType(one) if attribute.slot.get("multivalued") else one


def struct_type(catalog: Catalog, cls: str, path: tuple[str, ...] = ()) -> T.StructType:
    """The class as a Spark schema; titles, URIs and constraints go into the fields' metadata."""
    fields = []
    for attribute in catalog.attributes(catalog.classes[cls]).values():
        meta = {k: str(v) for k in ("minimum_value", "maximum_value", "pattern") if (v := attribute.merged(k)) is not None}
        meta |= {k: attribute.slot.meta[k] for k in ("title", "description", "slot_uri") if attribute.slot.meta.get(k)}
        if attribute.slot.get("identifier"):
            meta["identifier"] = True
        fields.append(T.StructField(attribute.name, _spark_type(catalog, attribute, (*path, cls)), not attribute.slot.get("required"), meta))
    return T.StructType(fields)


def table_ddl(catalog: Catalog, cls: str) -> str:
    """CREATE TABLE of a class."""
    columns = [f"  {f.name} {f.dataType.simpleString().upper()}{'' if f.nullable else ' NOT NULL'}" for f in struct_type(catalog, cls).fields]
    return f"CREATE TABLE {catalog.local_name(catalog.classes[cls])} (\n" + ",\n".join(columns) + "\n)"


def to_json(document: dict, indent: int | None = 2) -> str:
    """A document as JSON; numbers that JSON cannot hold are written as texts."""
    try:
        return json.dumps(document, indent=indent, ensure_ascii=False, allow_nan=False)
    except ValueError:
        return json.dumps(_finite(document), indent=indent, ensure_ascii=False)


def _finite(value):
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_finite(v) for v in value]
    return str(value) if isinstance(value, float) and not math.isfinite(value) else value


def to_yaml(document: dict) -> str:
    """A document as YAML, keys in their order; JSON, which is YAML too, without a YAML library."""
    try:
        import yaml
    except ImportError:
        return to_json(document) + "\n"
    return yaml.dump(document, Dumper=getattr(yaml, "CSafeDumper", yaml.SafeDumper), sort_keys=False, allow_unicode=True)


def indented(template: str, **values: str) -> str:
    """A template with {names} filled in; the further lines of a value get the indent of the line it stands in."""
    out = []
    for line in template.split("\n"):
        margin = line[: len(line) - len(line.lstrip())]
        out.append(re.sub(r"\{(\w+)\}", lambda m: values[m[1]].replace("\n", "\n" + margin), line))  # noqa: B023
    return "\n".join(out)
