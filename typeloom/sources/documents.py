"""Sources of schemas: YAML or JSON text from a string, a file, a mapping or a directory, with imports.

Loading never raises for a bad schema: it returns a Catalog or the issues that stopped it.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from typing import Protocol

from typeloom.plans.model import BOOLEAN, KIND_OF, KINDS, SEQUENCE, TYPES_ID, Element, Schema, builtin_schema

try:
    import yaml

    _LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
except ImportError:  # JSON, which is YAML too, still loads
    yaml = None


@dataclass(frozen=True)
class Region:
    """A place in a document; lines and columns count from 1."""

    line: int
    column: int


@dataclass
class LoadIssue(Exception):
    """Why a document did not load."""

    kind: str
    detail: str
    uri: str = ""
    region: Region | None = None
    path: str = ""

    def __str__(self) -> str:
        where = f"{self.uri}:{self.region.line}:{self.region.column}: " if self.region else f"{self.uri}: " if self.uri else ""
        return f"{where}{self.detail}"


class Importer(Protocol):
    """Where schema texts come from."""

    def read(self, uri: str) -> str: ...


class FileImporter:
    def read(self, uri: str) -> str:
        with open(uri, encoding="utf-8") as file:
            return file.read()


@dataclass
class MapImporter:
    """Texts by URI; useful for tests and for corpora that Spark has read."""

    texts: dict[str, str] = field(default_factory=dict)

    def read(self, uri: str) -> str:
        try:
            return self.texts[uri]
        except KeyError:
            raise FileNotFoundError(uri) from None


def parse_text(text: str, uri: str = "") -> dict:
    """A document's content; parse errors carry their place."""
    try:
        found = json.loads(text) if yaml is None else yaml.load(text, _LOADER)
    except ValueError as error:
        raise LoadIssue("SchemaParseError", str(error), uri) from None
    except Exception as error:  # noqa: BLE001 - the YAML library's own errors
        mark = getattr(error, "problem_mark", None)
        region = Region(mark.line + 1, mark.column + 1) if mark else None
        raise LoadIssue("SchemaParseError", str(getattr(error, "problem", None) or error), uri, region) from None
    if not isinstance(found, dict):
        raise LoadIssue("SchemaParseError", "a schema is a mapping", uri)
    return found


def region_of(text: str, path: str) -> Region | None:
    """Where the member at a path (/classes/C/rank) of a document begins, or the deepest one above it that there is."""
    if yaml is None:
        return None
    node = yaml.compose(text, _LOADER)
    found = node.start_mark
    for part in path.strip("/").split("/"):
        if not isinstance(node, yaml.MappingNode):
            break
        held = next(((k, v) for k, v in node.value if k.value == part), None)
        if held is None:
            break
        found, node = held[0].start_mark, held[1]
    return Region(found.line + 1, found.column + 1)


def _text(value) -> str:
    if value is True or value is False:
        return str(value).lower()
    return str(value)


def _listed(value) -> list:
    return [] if value is None else list(value) if isinstance(value, list) else [value]


def _metaslots(raw: dict, where: str, uri: str) -> dict:
    out = {}
    for key, value in raw.items():
        key = str(key)
        if value is None and key not in SEQUENCE:
            continue
        if key in BOOLEAN:
            if not isinstance(value, bool):
                raise LoadIssue("SchemaParseError", f"{where}/{key} is not true or false", uri, None, f"{where}/{key}")
            out[key] = value
        elif key in SEQUENCE:
            out[key] = [v if isinstance(v, dict) else _text(v) for v in _listed(value)]
        elif key == "rank" or key.endswith("_cardinality"):
            if isinstance(value, bool) or not isinstance(value, int) or not -(1 << 31) <= value < 1 << 31:
                raise LoadIssue("SchemaParseError", f"{where}/{key} is not a 32-bit integer", uri, None, f"{where}/{key}")
            out[key] = value
        elif isinstance(value, (dict, list)):
            out[key] = value
        else:
            out[key] = _text(value)
    return out


def _keyed(value, where: str, simple: str | None, uri: str) -> dict[str, dict]:
    """A collection by name: a mapping of objects, of bare values (taken as ``simple``), or a list of objects."""
    if value is None:
        return {}
    if isinstance(value, list):
        value = {(v.get("name") or v.get("text")) if isinstance(v, dict) else v: v if isinstance(v, dict) else None for v in value}
    if not isinstance(value, dict):
        raise LoadIssue("SchemaParseError", f"{where} is not a mapping", uri, None, where)
    out = {}
    for name, body in value.items():
        if body is not None and not isinstance(body, dict):
            if simple is None:
                raise LoadIssue("SchemaParseError", f"{where}/{name} is not a mapping", uri, None, f"{where}/{name}")
            body = {simple: body}
        out[_text(name)] = body or {}
    return out


def decode(raw: dict, uri: str = "") -> Schema:
    """A document's content as a Schema; unknown keys are kept and ignored, id and name are required."""
    for key in ("id", "name"):
        if raw.get(key) is None:
            raise LoadIssue("SchemaParseError", f"missing required field: {key}", uri, None, "/")
    rest = {k: v for k, v in raw.items() if k not in (*KINDS, "prefixes", "imports", "id", "name")}
    schema = Schema(_text(raw["id"]), _text(raw["name"]), _metaslots(rest, "", uri))
    for prefix, body in _keyed(raw.get("prefixes"), "/prefixes", "prefix_reference", uri).items():
        schema.prefixes[prefix] = _text(body.get("prefix_reference", ""))
    schema.imports = [_text(x) for x in _listed(raw.get("imports"))]
    for kind in KINDS:
        for name, body in _keyed(raw.get(kind), f"/{kind}", None, uri).items():
            meta = _metaslots(body, f"/{kind}/{name}", uri)
            for nested in ("attributes", "slot_usage"):
                if nested in meta:
                    meta[nested] = {n: _metaslots(b, f"/{kind}/{name}/{nested}/{n}", uri) for n, b in _keyed(body[nested], f"/{kind}/{name}/{nested}", None, uri).items()}
            if "permissible_values" in meta:
                meta["permissible_values"] = {n: _metaslots(b, f"/{kind}/{name}/permissible_values/{n}", uri) for n, b in _keyed(body["permissible_values"], f"/{kind}/{name}/permissible_values", "description", uri).items()}
            schema.elements[kind][name] = Element(name, KIND_OF[kind], schema, meta)
    return schema


def _stripped(meta: dict) -> dict:
    """Metaslots without empty or default values, at every depth; elements by name stay, empty ones too."""
    out = {}
    for key, value in meta.items():
        if key in ("attributes", "slot_usage", "permissible_values") and value:
            out[key] = {n: _stripped(b) for n, b in value.items()}
        elif value not in (None, False, [], {}):
            out[key] = value
    return out


def encode(schema: Schema) -> dict:
    """The inverse of decode, without empty or default values; prefixes as one value each."""
    out: dict = {"id": schema.id, "name": schema.name, **_stripped(schema.meta)}
    if schema.prefixes:
        out["prefixes"] = dict(schema.prefixes)
    if schema.imports:
        out["imports"] = list(schema.imports)
    for kind in KINDS:
        found = {n: _stripped(e.meta) for n, e in schema.elements[kind].items()}
        if found:
            out[kind] = found
    return out


# The parts of the language's own model that schemas import, by name.
_BUILTIN = {
    "extensions": {
        "imports": ["linkml:types"],
        "classes": {
            "Any": {"class_uri": "linkml:Any"},
            "extension": {"slots": ["extension_tag", "extension_value", "extensions"]},
            "extensible": {"mixin": True, "slots": ["extensions"]},
        },
        "slots": {
            "extensions": {"range": "extension", "multivalued": True, "inlined": True},
            "extension_tag": {"range": "uriorcurie", "required": True, "key": True, "alias": "tag"},
            "extension_value": {"range": "Any", "required": True, "alias": "value"},
        },
    },
    "annotations": {
        "imports": ["linkml:types", "linkml:extensions"],
        "classes": {"annotatable": {"mixin": True, "slots": ["annotations"]}, "annotation": {"is_a": "extension", "mixins": ["annotatable"]}},
        "slots": {"annotations": {"is_a": "extensions", "range": "annotation", "multivalued": True, "inlined": True}},
    },
    "mappings": {
        "imports": ["linkml:types"],
        "slots": {
            "mappings": {"range": "uriorcurie", "multivalued": True, "slot_uri": "skos:mappingRelation"},
            "exact mappings": {"is_a": "mappings", "range": "uriorcurie", "multivalued": True, "slot_uri": "skos:exactMatch"},
            "close mappings": {"is_a": "mappings", "range": "uriorcurie", "multivalued": True, "slot_uri": "skos:closeMatch"},
            "related mappings": {"is_a": "mappings", "range": "uriorcurie", "multivalued": True, "slot_uri": "skos:relatedMatch"},
            "narrow mappings": {"is_a": "mappings", "range": "uriorcurie", "multivalued": True, "slot_uri": "skos:narrowMatch"},
            "broad mappings": {"is_a": "mappings", "range": "uriorcurie", "multivalued": True, "slot_uri": "skos:broadMatch"},
            "deprecated element has exact replacement": {"range": "uriorcurie", "slot_uri": "linkml:deprecated_element_has_exact_replacement"},
            "deprecated element has possible replacement": {"range": "uriorcurie", "slot_uri": "linkml:deprecated_element_has_possible_replacement"},
        },
    },
    "units": {
        "imports": ["linkml:types", "linkml:mappings"],
        "prefixes": {"qudt": "http://qudt.org/schema/qudt/"},
        "classes": {
            "UnitOfMeasure": {
                "class_uri": "qudt:Unit",
                "slots": ["symbol", "abbreviation", "descriptive_name", "exact mappings", "ucum_code", "derivation", "has_quantity_kind", "iec61360code"],
            }
        },
        "slots": {
            "symbol": {"slot_uri": "qudt:symbol"},
            "abbreviation": {},
            "descriptive_name": {"slot_uri": "rdfs:label"},
            "ucum_code": {"slot_uri": "qudt:ucumCode"},
            "derivation": {},
            "has_quantity_kind": {"slot_uri": "qudt:hasQuantityKind", "range": "uriorcurie"},
            "iec61360code": {"slot_uri": "qudt:iec61360Code"},
        },
    },
}
_LANGUAGE = TYPES_ID.removesuffix("types")


def _builtin(name: str) -> str | None:
    """The name of the built-in schema that an import means, or None."""
    for head in ("linkml:", _LANGUAGE):
        if name.startswith(head):
            return name.removeprefix(head).removesuffix(".yaml").removesuffix(".yml")
    return None


def builtin(name: str) -> Schema:
    """A built-in schema by name."""
    if name == "types":
        return builtin_schema()
    if name not in _BUILTIN:
        raise LoadIssue("SchemaImportError", f"no built-in schema {name}", f"linkml:{name}")
    return decode({"id": _LANGUAGE + name, "name": name, "default_prefix": "linkml", "default_range": "string", **_BUILTIN[name]}, f"linkml:{name}")


def _resolved(name: str, base: str) -> str:
    if not name.endswith((".yaml", ".yml")):
        name += ".yaml"
    return name if "://" in name or os.path.isabs(name) else os.path.normpath(os.path.join(os.path.dirname(base), name))


def load_schemas(uri: str | None, text: str | None = None, importer: Importer | None = None) -> list[Schema]:
    """The root schema and all it imports, root first, each once; raises the first LoadIssue."""
    importer = importer or FileImporter()
    seen: set[str] = set()
    out: list[Schema] = []

    def visit(name: str, own: str | None) -> None:
        if own is None:
            if name in seen:
                return
            seen.add(name)
            try:
                own = importer.read(name)
            except OSError as error:
                raise LoadIssue("SchemaImportError", str(error), name) from None
        try:
            schema = decode(parse_text(own, name), name)
        except LoadIssue as issue:
            if issue.region is None and issue.path:
                issue.region = region_of(own, issue.path)
            raise
        out.append(schema)
        for wanted in schema.imports:
            held = _builtin(wanted)
            if held is None:
                visit(_resolved(wanted, name), None)
            else:
                include(held)

    def include(name: str) -> None:
        if _LANGUAGE + name not in seen:
            seen.add(_LANGUAGE + name)
            out.append(builtin(name))
            for wanted in out[-1].imports:
                include(_builtin(wanted))

    visit(_resolved(uri, "") if uri and text is None else (uri or ""), text)
    return out
