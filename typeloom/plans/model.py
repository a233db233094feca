"""The model: schema documents as elements with their metaslots, and the rules by which metaslots merge."""

from __future__ import annotations

from dataclasses import dataclass, field

KINDS = ("classes", "slots", "enums", "types", "subsets")
KIND_OF = {"classes": "class", "slots": "slot", "enums": "enum", "types": "type", "subsets": "subset"}

# How metaslots of the schema language are typed.
BOOLEAN = frozenset(
    "required recommended multivalued identifier key inlined inlined_as_list designates_type list_elements_ordered list_elements_unique shared inherited symmetric asymmetric reflexive irreflexive transitive locally_reflexive is_grouping_slot is_class_field is_usage_slot usage_slot_name abstract mixin tree_root slot_names_unique represents_relationship".split()
)
SEQUENCE = frozenset(
    "aliases see_also notes comments todos mixins slots imports emit_prefixes any_of all_of none_of exactly_one_of equals_string_in in_subset examples id_prefixes keywords categories union_of inherits apply_to exact_mappings close_mappings narrow_mappings broad_mappings related_mappings disjoint_with".split()
)
MAPPING = frozenset("annotations extensions alt_descriptions local_names structured_aliases".split())
#: Metaslots that a slot takes over from its own ancestors.
INHERITED = frozenset(
    "identifier multivalued required recommended inlined inlined_as_list pattern rank array designates_type domain equals_expression equals_number equals_string equals_string_in exact_cardinality minimum_cardinality maximum_cardinality ifabsent inherited key list_elements_ordered list_elements_unique minimum_value maximum_value range readonly relational_role role shared structured_pattern value_presence".split()
)
#: base of a type: (kind, Spark type)
BASES = {
    "str": ("string", "string"),
    "int": ("integer", "bigint"),
    "Bool": ("boolean", "boolean"),
    "float": ("float", "double"),
    "double": ("double", "double"),
    "Decimal": ("decimal", "decimal(38,18)"),
    "XSDDate": ("date", "date"),
    "XSDDateTime": ("datetime", "timestamp"),
    "XSDTime": ("time", "string"),
    "URI": ("uri", "string"),
    "Curie": ("curie", "string"),
    "URIorCURIE": ("uriorcurie", "string"),
    "NCName": ("ncname", "string"),
}
ANY_URI = "https://w3id.org/linkml/Any"
TYPES_ID = "https://w3id.org/linkml/types"
# name: (base, uri)
BUILTIN_TYPES = {
    "string": ("str", "xsd:string"),
    "integer": ("int", "xsd:integer"),
    "boolean": ("Bool", "xsd:boolean"),
    "float": ("float", "xsd:float"),
    "double": ("float", "xsd:double"),
    "decimal": ("Decimal", "xsd:decimal"),
    "time": ("XSDTime", "xsd:time"),
    "date": ("XSDDate", "xsd:date"),
    "datetime": ("XSDDateTime", "xsd:dateTime"),
    "date_or_datetime": ("str", "linkml:DateOrDatetime"),
    "uriorcurie": ("URIorCURIE", "xsd:anyURI"),
    "curie": ("Curie", "xsd:string"),
    "uri": ("URI", "xsd:anyURI"),
    "ncname": ("NCName", "xsd:string"),
    "objectidentifier": ("str", "shex:iri"),
    "nodeidentifier": ("str", "shex:nonLiteral"),
    "jsonpointer": ("str", "xsd:string"),
    "jsonpath": ("str", "xsd:string"),
    "sparqlpath": ("str", "xsd:string"),
}
#: Prefixes that every schema knows.
EMIT_PREFIXES = {
    "linkml": "https://w3id.org/linkml/",
    "xsd": "http://www.w3.org/2001/XMLSchema#",
    "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#",
    "rdfs": "http://www.w3.org/2000/01/rdf-schema#",
    "shex": "http://www.w3.org/ns/shex#",
    "schema": "http://schema.org/",
    "skos": "http://www.w3.org/2004/02/skos/core#",
    "owl": "http://www.w3.org/2002/07/owl#",
    "dcterms": "http://purl.org/dc/terms/",
}


#: Prefixes that a schema gets by ``default_curi_maps: [semweb_context]``.
SEMWEB_PREFIXES = {
    "dc": "http://purl.org/dc/terms/",
    "faldo": "http://biohackathon.org/resource/faldo#",
    "foaf": "http://xmlns.com/foaf/0.1/",
    "oa": "http://www.w3.org/ns/oa#",
    "idot": "http://identifiers.org/",
    "void": "http://rdfs.org/ns/void#",
    "prov": "http://www.w3.org/ns/prov#",
    "dcat": "http://www.w3.org/ns/dcat#",
}


@dataclass
class Element:
    """A named element of one kind: its metaslots as written, and the schema that defines it."""

    name: str
    kind: str
    schema: "Schema"
    meta: dict = field(default_factory=dict)

    def get(self, metaslot: str, default=None):
        found = self.meta.get(metaslot)
        if found is None:
            return default if default is not None else False if metaslot in BOOLEAN else [] if metaslot in SEQUENCE else None
        return found

    def __repr__(self) -> str:
        return f"{self.kind}:{self.name}"


@dataclass
class Schema:
    """One schema document; elements are keyed by kind and name, in the order written."""

    id: str
    name: str
    meta: dict = field(default_factory=dict)
    elements: dict[str, dict[str, Element]] = field(default_factory=lambda: {k: {} for k in KINDS})
    prefixes: dict[str, str] = field(default_factory=dict)
    imports: list[str] = field(default_factory=list)

    @property
    def default_range(self) -> str | None:
        return self.meta.get("default_range")


def combine_value(metaslot: str, near, far):
    """One metaslot of two layers, the nearer first."""
    if metaslot in BOOLEAN:
        return bool(near) or bool(far) if near is not None or far is not None else None
    if metaslot in SEQUENCE:
        near, far = near or [], far or []
        return near if not far or far == near else near + far
    if metaslot in MAPPING:
        return {**(near or {}), **(far or {})}
    return far if near is None else near


def combine(near: dict, far: dict, only: frozenset[str] | None = None) -> dict:
    """All metaslots of two layers; with ``only``, the farther layer gives these alone."""
    out = dict(near)
    for key, value in far.items():
        if only is None or key in only:
            merged = combine_value(key, near.get(key), value)
            if merged is not None:
                out[key] = merged
    return out


def builtin_schema() -> Schema:
    """The built-in types as a schema."""
    schema = Schema(TYPES_ID, "types", {"default_prefix": "linkml"}, prefixes=dict(EMIT_PREFIXES))
    for name, (base, uri) in BUILTIN_TYPES.items():
        schema.elements["types"][name] = Element(name, "type", schema, {"base": base, "uri": uri})
    return schema
