"""The catalog: a read-only view of a schema and its imports on the driver.

It resolves names, derives the effective slots of classes, and answers reachability; Spark plans are
compiled from it.
"""

from __future__ import annotations

from collections.abc import Callable, Hashable, Iterable, Mapping
from dataclasses import dataclass
from functools import cached_property

from typeloom.functions import names
from typeloom.plans.model import ANY_URI, BASES, EMIT_PREFIXES, INHERITED, KINDS, SEMWEB_PREFIXES, SEQUENCE, TYPES_ID, Element, Schema, combine, combine_value

PLURAL = {"class": "classes", "slot": "slots", "enum": "enums", "type": "types", "subset": "subsets"}
#: Of kinds that share a name in the global index, the later one wins.
_GLOBAL_ORDER = ("subset", "slot", "enum", "type", "class")


def closure(start: Iterable, step: Callable[[object], Iterable], reflexive: bool = True, key: Callable[[object], Hashable] = lambda x: x) -> list:
    """What step reaches from start, in the order of discovery, each key once.

    Direct successors are listed together, then those of the last one first.
    """
    seen: set = set()
    out: list = []
    stack: list = []

    def add(items: list) -> None:
        fresh = []
        for item in items:
            if key(item) not in seen:
                seen.add(key(item))
                out.append(item)
                fresh.append(item)
        stack.extend(fresh)

    start = list(start)
    if reflexive:
        add(start)
    else:
        stack.extend(start)
    while stack:
        add(list(step(stack.pop())))
    return out


def _listed(value) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


@dataclass(frozen=True)
class Form:
    """How instances of a range appear: plain, optional, list, simple_dict (key, value) or compact_dict (key)."""

    name: str
    key: str | None = None
    value: str | None = None


@dataclass
class Attribute:
    """A derived slot of a class with its resolved range: any, inline, reference, type or enum."""

    slot: Element
    kind: str
    range: Element | None
    form: Form | None = None
    identifier: "Attribute | None" = None

    @property
    def name(self) -> str:
        return self.slot.get("alias") or names.de_space(self.slot.name)

    def merged(self, metaslot: str):
        """The slot's value, else its type's (for a reference, that of the identifier's); lists of both are joined."""
        found = self.slot.meta.get(metaslot)
        if self.kind == "reference":
            return self.identifier.merged(metaslot)
        if self.kind != "type":
            return found
        of_type = self.range.meta.get(metaslot)
        return combine_value(metaslot, found, of_type) if metaslot == "equals_string_in" else of_type if found is None else found


class Catalog:
    """A loaded schema; ``schemas`` has the root first. Later schemas win where names clash."""

    def __init__(self, schemas: list[Schema]):
        self.schemas = schemas
        self.root = schemas[0]
        self.by_kind: dict[str, dict[str, Element]] = {k: {} for k in PLURAL}
        for schema in schemas:
            for plural in KINDS:
                for name, element in schema.elements[plural].items():
                    self.by_kind[element.kind][name] = element
        self.classes, self.slots, self.enums, self.types = (self.by_kind[k] for k in ("class", "slot", "enum", "type"))
        self._derived: dict[str, dict[str, Element]] = {}
        self._attributes: dict[str, dict[str, Attribute]] = {}
        self._above: dict[tuple[str, str, bool], list[Element]] = {}
        self._folded: dict[str, dict[str, dict]] = {}
        self._bags: dict[str, dict[str, list[dict]]] = {}
        self._declared: dict[str, dict[str, Schema]] = {}
        self._shared: dict[tuple, Element] = {}
        self._resolved: dict[int, Attribute] = {}
        # by id, with the element, which so stays and keeps its id
        self._uris: dict[int, tuple[Element, str]] = {}
        self._meanings: dict[int, tuple[Element, dict[str, str]]] = {}
        self._spaces: dict[int, Mapping[str, str]] = {}

    # -- lookups

    @cached_property
    def elements(self) -> dict[str, Element]:
        out: dict[str, Element] = {}
        for kind in _GLOBAL_ORDER:
            out.update(self.by_kind[kind])
        return out

    def resolve(self, name: str | None, *kinds: str) -> Element | None:
        """An element by name, of the first of the kinds that has it; of any kind without kinds."""
        if not kinds:
            return self.elements.get(name)
        return next((self.by_kind[k][name] for k in kinds if name in self.by_kind[k]), None)

    def default_range(self, schema: Schema) -> str:
        return schema.default_range or "string"

    def default_namespace(self, schema: Schema) -> str:
        prefix = schema.meta.get("default_prefix")
        if prefix is None:
            return schema.id if schema.id.endswith(("#", "/")) else schema.id + "/"
        if prefix in schema.prefixes:
            return names.namespace(schema.prefixes[prefix])
        if prefix in EMIT_PREFIXES:
            return names.namespace(EMIT_PREFIXES[prefix])
        return prefix if names.is_uri(prefix) else prefix + "/"

    def prefixes(self, schema: Schema) -> Mapping[str, str]:
        """Prefixes that hold in a schema: those every schema knows, a well-known set it asks for, its own."""
        if id(schema) not in self._spaces:
            asked = _listed(schema.meta.get("default_curi_maps"))
            self._spaces[id(schema)] = {**EMIT_PREFIXES, **(SEMWEB_PREFIXES if "semweb_context" in asked else {}), **schema.prefixes}
        return self._spaces[id(schema)]

    def alias(self, element: Element) -> str:
        alias = element.meta.get("alias")
        if element.kind == "enum":
            return names.pascal_case(element.name)
        if element.kind == "class":
            return alias or names.pascal_case(element.name)
        return alias or (element.name if element.kind == "type" else names.de_space(element.name))

    def local_name(self, element: Element) -> str:
        if element.kind in ("class", "enum"):
            return names.pascal_case(element.name)
        return element.name if element.kind == "type" else names.de_space(element.name)

    def uri(self, element: Element) -> str:
        """The element's URI: the one written, expanded, or the default namespace and its encoded name."""
        if id(element) not in self._uris:
            self._uris[id(element)] = element, self._uri(element)
        return self._uris[id(element)][1]

    def _uri(self, element: Element) -> str:
        written = element.meta.get({"class": "class_uri", "slot": "slot_uri", "enum": "enum_uri", "type": "uri"}.get(element.kind, "uri"))
        if written is not None:
            return names.expand(written, self.prefixes(element.schema))
        return self.default_namespace(element.schema) + names.uri_encode(self.local_name(element))

    def meanings(self, enum: Element) -> dict[str, str]:
        """Permissible values with their URIs, in order."""
        if id(enum) in self._meanings:
            return self._meanings[id(enum)][1]
        out = {}
        for text, body in (enum.meta.get("permissible_values") or {}).items():
            meaning = body.get("meaning")
            out[text] = names.expand(meaning, self.prefixes(enum.schema)) if meaning else self.default_namespace(enum.schema) + names.uri_encode(names.de_space(text))
        self._meanings[id(enum)] = enum, out
        return out

    def by_meaning(self, enum: Element) -> dict[str, str]:
        return {uri: text for text, uri in self.meanings(enum).items()}

    def is_any(self, cls: Element) -> bool:
        return self.uri(cls) == ANY_URI

    def is_primitive(self, kind: Element) -> bool:
        return kind.schema.id.startswith(TYPES_ID)

    def tree_root(self, override: str | None = None) -> Element | None:
        if override is not None:
            if override not in self.classes:
                raise KeyError(f"no class {override} to be the tree root")
            return self.classes[override]
        return next((c for c in self.classes.values() if c.get("tree_root") and c.schema is self.root), None)

    # -- graphs

    def parents(self, element: Element) -> list[Element]:
        """Mixins, then is_a."""
        known = self.by_kind[element.kind]
        wanted = [*element.get("mixins"), element.meta.get("is_a")]
        return [known[n] for n in wanted if n in known]

    def ancestors(self, element: Element, reflexive: bool = True) -> list[Element]:
        key = (element.kind, element.name, reflexive)
        if self.by_kind[element.kind].get(element.name) is not element:
            return closure([element], self.parents, reflexive, lambda e: e.name)
        if key not in self._above:
            self._above[key] = closure([element], self.parents, reflexive, lambda e: e.name)
        return self._above[key]

    def lowest_common_ancestors(self, classes: Iterable[Element]) -> list[Element]:
        """Common ancestors that are no strict ancestors of others; several or none are possible."""
        classes = list(classes)
        if not classes:
            return []
        common = {e.name: e for e in self.ancestors(classes[0])}
        for cls in classes[1:]:
            own = {e.name for e in self.ancestors(cls)}
            common = {n: e for n, e in common.items() if n in own}
        above = {a.name for e in common.values() for a in self.ancestors(e, reflexive=False) if a.name != e.name}
        return [e for n, e in common.items() if n not in above]

    # -- derivation

    def direct_slots(self, cls: Element) -> list[str]:
        return [*cls.get("slots"), *(cls.meta.get("attributes") or {})]

    def _attribute_schemas(self, cls: Element) -> dict[str, Schema]:
        """Attributes of a class and its ancestors, with the schema of the nearest class that has each."""
        if cls.name not in self._declared:
            out: dict[str, Schema] = {}
            for ancestor in self.ancestors(cls):
                for name in ancestor.meta.get("attributes") or {}:
                    out.setdefault(name, ancestor.schema)
            self._declared[cls.name] = out
        return self._declared[cls.name]

    def from_attributes(self, cls: Element, name: str) -> bool:
        return name in self._attribute_schemas(cls)

    def _layers(self, cls: Element, path: tuple[str, ...] = ()) -> dict[str, dict]:
        """What a class and those it inherits from say of each slot: usage, attribute, mixins in depth, then is_a."""
        if cls.name in path:
            return {}
        if cls.name in self._folded:
            return self._folded[cls.name]
        out = {name: dict(meta) for name, meta in (cls.meta.get("slot_usage") or {}).items()}
        for name, meta in (cls.meta.get("attributes") or {}).items():
            out[name] = combine(out.get(name, {}), meta)
        for parent in self.parents(cls):
            for name, meta in self._layers(parent, (*path, cls.name)).items():
                out[name] = combine(out[name], meta) if name in out else meta  # shared, and never changed
        self._folded[cls.name] = out
        return out

    def _list_layers(self, cls: Element, path: tuple[str, ...] = ()) -> dict[str, list[dict]]:
        """The same layers one by one, of those that have lists the lists: a list is compared with all joined so far,
        so an ancestor met twice counts twice, and lists cannot be joined parent by parent."""
        if cls.name in path:
            return {}
        if cls.name in self._bags:
            return self._bags[cls.name]
        out: dict[str, list[dict]] = {}
        for metaslot in ("slot_usage", "attributes"):
            for name, meta in (cls.meta.get(metaslot) or {}).items():
                if lists := {k: v for k, v in meta.items() if k in SEQUENCE and v}:
                    out.setdefault(name, []).append(lists)
        for parent in self.parents(cls):
            for name, layers in self._list_layers(parent, (*path, cls.name)).items():
                out[name] = out[name] + layers if name in out else layers
        self._bags[cls.name] = out
        return out

    def derived_slots(self, cls: Element) -> dict[str, Element]:
        """The class's effective slots, in the order of its ancestors, attributes before slots."""
        if cls.name not in self._derived:
            out: dict[str, Element] = {}
            for ancestor in self.ancestors(cls):
                for name in (*(ancestor.meta.get("attributes") or ()), *(ancestor.meta.get("slots") or ())):
                    if name not in out:
                        out[name] = self.derived_slot(cls, name)
            self._derived[cls.name] = out
        return self._derived[cls.name]

    def derived_slot(self, cls: Element, name: str) -> Element:
        """A slot as a class has it; classes that add nothing to an inherited slot share it."""
        layers, declared = self._layers(cls).get(name), self._attribute_schemas(cls).get(name)
        top = self.slots.get(name) if declared is None else None
        source = declared or (top.schema if top is not None else cls.schema)
        key = (id(layers) if layers is not None else name, name, id(source), top is None)
        found = self._shared.get(key)
        if found is None:
            meta = dict(layers or {})
            lists: dict = {}
            for layer in self._list_layers(cls).get(name, ()):
                lists = combine(lists, layer)
            meta |= lists
            if top is not None:
                meta = combine(meta, top.meta)
                for ancestor in self.ancestors(top, reflexive=False):
                    meta = combine(meta, ancestor.meta, INHERITED)
            found = self._shared[key] = Element(name, "slot", source, meta)
            try:
                meta["slot_uri"] = self.uri(found)
            except names.UnknownPrefix:
                pass  # stays as written, for lint to tell of
            meta["inlined"] = bool(meta.get("inlined") or meta.get("inlined_as_list"))
            meta["required"] = bool(meta.get("required") or meta.get("identifier") or meta.get("key"))
        return found

    def range_of(self, slot: Element) -> str:
        return slot.meta.get("range") or self.default_range(slot.schema)

    def identifier(self, cls: Element) -> Element | None:
        return next((s for s in reversed(self.derived_slots(cls).values()) if s.get("identifier")), None)

    def key_slot(self, cls: Element) -> Element | None:
        return next((s for s in reversed(self.derived_slots(cls).values()) if s.get("identifier") or s.get("key")), None)

    def collection_form(self, cls: Element) -> Form:
        """list without a key; simple_dict with exactly two slots or two required ones; else compact_dict."""
        key = self.key_slot(cls)
        if key is None:
            return Form("list")
        slots = self.derived_slots(cls)
        others = [s for s in slots.values() if s.name != key.name]
        required = [s for s in others if s.get("required")]
        if len(others) == 1:
            return Form("simple_dict", key.name, others[0].name)
        if len(required) == 1 and key.get("required"):
            return Form("simple_dict", key.name, required[0].name)
        return Form("compact_dict", key.name)

    def inlined(self, slot: Element) -> bool:
        target = self.resolve(self.range_of(slot), "class", "type", "enum")
        return bool(slot.get("inlined")) or target is None or target.kind != "class" or self.identifier(target) is None

    def inline_form(self, slot: Element) -> Form:
        if not slot.get("multivalued"):
            return Form("plain" if slot.get("required") else "optional")
        target = self.resolve(self.range_of(slot), "class", "type", "enum")
        if target is None or target.kind != "class" or slot.get("inlined_as_list") or not self.inlined(slot):
            return Form("list")
        return self.collection_form(target)

    def root_form(self, cls: Element, override: str | None = None) -> Form:
        wanted = override
        if wanted is None:
            extension = (cls.meta.get("extensions") or {}).get("tree_root_as")
            wanted = (extension.get("value") if isinstance(extension, dict) else extension) or "plain"
        if wanted in ("plain", "optional", "list"):
            return Form(wanted)
        form = self.collection_form(cls)
        if wanted == "compact_dict" and form.key:
            return Form("compact_dict", form.key)
        if wanted == "simple_dict" and form.name == "simple_dict":
            return form
        raise ValueError(f"class {cls.name} has no form {wanted}")

    def attributes(self, cls: Element) -> dict[str, Attribute]:
        if cls.name not in self._attributes:
            out = {}
            for name, slot in self.derived_slots(cls).items():
                if id(slot) not in self._resolved:  # the slots live as long as the catalog
                    self._resolved[id(slot)] = self.attribute(slot)
                out[name] = self._resolved[id(slot)]
            self._attributes[cls.name] = out
        return self._attributes[cls.name]

    def attribute(self, slot: Element) -> Attribute:
        target = self.resolve(self.range_of(slot), "class", "type", "enum")
        if target is None:
            raise KeyError(f"slot {slot.name} has no usable range: {self.range_of(slot)}")
        if target.kind != "class":
            return Attribute(slot, target.kind, target)
        if self.is_any(target):
            return Attribute(slot, "any", target)
        if self.inlined(slot):
            return Attribute(slot, "inline", target, self.inline_form(slot))
        return Attribute(slot, "reference", target, identifier=self.attribute(self.identifier(target)))

    def materialized(self, cls: Element) -> Element:
        """The class with all its slots as attributes and nothing inherited."""
        drop = ("is_a", "mixins", "slots", "slot_usage")
        meta = {k: v for k, v in cls.meta.items() if k not in drop}
        meta["attributes"] = {n: dict(s.meta) for n, s in self.derived_slots(cls).items()}
        meta["class_uri"], meta["from_schema"] = self.uri(cls), cls.schema.id
        return Element(cls.name, "class", cls.schema, meta)

    def runtime_type(self, kind: Element) -> str:
        """The kind of a type's values; ``typeof`` is followed where there is no base."""
        seen = set()
        while kind is not None and kind.name not in seen:
            seen.add(kind.name)
            base = kind.meta.get("base")
            if base is not None:
                return BASES.get(base, ("any", ""))[0]
            kind = self.types.get(kind.meta.get("typeof"))
        return "any"

    def is_iri(self, kind: Element) -> bool:
        return self.runtime_type(kind) in ("uri", "curie", "uriorcurie") or kind.meta.get("implicit_prefix") is not None

    def subject_type(self, attribute: Attribute) -> str:
        """uri, curie, uriorcurie, base, or implicit:<prefix>."""
        kind = attribute.identifier if attribute.kind == "reference" else attribute
        if kind.kind != "type":
            return "base"
        runtime = self.runtime_type(kind.range)
        if runtime in ("uri", "curie", "uriorcurie"):
            return runtime
        prefix = attribute.slot.meta.get("implicit_prefix") or kind.slot.meta.get("implicit_prefix") or kind.range.meta.get("implicit_prefix")
        return f"implicit:{prefix}" if prefix else "base"

    # -- reachability

    def _derived_step(self, with_ancestors: bool, inlined_only: bool) -> Callable[[Element], list[Element]]:
        def step(e: Element) -> list[Element]:
            found: list[str | None] = []
            out: list[Element] = []
            if e.kind == "class":
                for slot in self.derived_slots(e).values():
                    target = self.resolve(self.range_of(slot), "class", "type", "enum")
                    if not (inlined_only and target is not None and target.kind == "class" and not self.inlined(slot)):
                        found.append(self.range_of(slot))
                    found += [x.get("range") for x in slot.get("any_of")]
                    found.append(slot.meta.get("domain"))
                if with_ancestors:
                    out += self.ancestors(e, reflexive=False)
            elif e.kind == "type":
                found += [e.meta.get("typeof"), *e.get("union_of")]
            elif e.kind == "enum":
                found += e.get("inherits")
            return out + [x for n in found if (x := self.resolve(n, "class", "type", "enum")) is not None]

        return step

    def _underived_step(self, e: Element) -> list[Element]:
        found: list[str | None] = []
        out = self.ancestors(e, reflexive=False) if e.kind in ("class", "slot") else []
        metas: list[Mapping] = []
        if e.kind == "class":
            out += [self.slots[n] for n in e.get("slots") if n in self.slots]
            metas = [*(e.meta.get("attributes") or {}).values(), *(e.meta.get("slot_usage") or {}).values()]
        elif e.kind == "slot":
            metas = [e.meta]
        elif e.kind == "type":
            found += [e.meta.get("typeof"), *e.get("union_of")]
        elif e.kind == "enum":
            found += e.get("inherits")
        for meta in metas:
            found += [meta.get("range"), meta.get("domain"), *(x.get("range") for x in meta.get("any_of") or [])]
        return out + [x for n in found if (x := self.resolve(n, "class", "type", "enum")) is not None]

    def reachable(self, seeds: Iterable[Element], derived: bool = True, ancestors: bool = True, inlined_only: bool = False) -> set[tuple[str, str]]:
        """(kind, name) of all that the seeds reach, themselves included."""
        step = self._derived_step(ancestors, inlined_only) if derived else self._underived_step
        return {(e.kind, e.name) for e in closure(seeds, step, True, lambda e: (e.kind, e.name))}

    def pruning(self, mode: str = "skip", override: str | None = None, derived: bool = True, ancestors: bool = True, inlined_only: bool = False) -> Callable[[Element], bool]:
        """Which elements a generator keeps: mode skip (all), tree_root or schema_root."""
        if mode == "skip":
            return lambda e: True
        seeds = [x for s in self.schemas if (x := self.resolve(self.default_range(s), "class", "type", "enum")) is not None]
        root = self.tree_root(override) if mode == "tree_root" else None
        seeds += [root] if root is not None else [c for c in self.classes.values() if c.schema is self.root]
        kept = self.reachable(seeds, derived, ancestors, inlined_only)
        return lambda e: (e.kind, e.name) in kept

    # -- expressions

    def default_value(self, attribute: Attribute) -> str | None:
        """The value that ``ifabsent: Enum(VALUE)`` names; other ranges have none."""
        from typeloom.functions.expressions import parse_constructor

        written = attribute.slot.meta.get("ifabsent")
        if written is None or attribute.kind != "enum":
            return None
        return parse_constructor(written, attribute.range.name, self.meanings(attribute.range))
