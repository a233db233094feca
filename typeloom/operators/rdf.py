"""RDF: shapes and vocabularies of a catalog as triples, instances as triples, N-Triples and Turtle sinks."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions.names import expand_col, namespace, ntriples_escape, ntriples_iri, ntriples_string
from typeloom.plans.catalog import Attribute, Catalog
from typeloom.plans.model import Element

# Vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
SH = "http://www.w3.org/ns/shacl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
_ROWS = "array<struct<s:string,s_kind:string,p:string,o:string,o_kind:string,o_datatype:string>>"
IRI, BLANK, LITERAL = "iri", "blank", "literal"
#: Triples after which a statement of Turtle ends, so that none outgrows a task that reads it.
STATEMENT = 10_000
TRIPLES = "s string, s_kind string, p string, o string, o_kind string, o_datatype string"


@dataclass(slots=True, unsafe_hash=True)
class Triple:
    s: str
    s_kind: str
    p: str
    o: str
    o_kind: str = IRI
    o_datatype: str | None = None

    def line(self) -> str:
        rest = f"{_iri(self.p)} _:{self.o} ." if self.o_kind == BLANK else _rest(self.p, self.o, self.o_kind, self.o_datatype)
        return f"_:{self.s} {rest}" if self.s_kind == BLANK else f"{_iri(self.s)} {rest}"


@functools.lru_cache(maxsize=1 << 16)
def _iri(value: str) -> str:
    return f"<{ntriples_escape(value, True)}>"


@functools.lru_cache(maxsize=1 << 14)
def _rest(p: str, o: str, kind: str, datatype: str | None) -> str:
    """A line from its predicate on, which triples of one slot in many classes share."""
    if kind == LITERAL:
        return f'{_iri(p)} "{ntriples_escape(o)}"' + ("" if datatype in (None, XSD + "string") else f"^^{_iri(datatype)}") + " ."
    return f"{_iri(p)} {_iri(o)} ."


def _literal(s: str, kind: str, p: str, value: str, datatype: str = XSD + "string") -> Triple:
    return Triple(s, kind, p, value, LITERAL, datatype)


def _list(items: list[tuple[str, str]], ids: Iterator[int]) -> tuple[tuple[str, str], list[Triple]]:
    """The head of an RDF list of (value, kind), and its triples."""
    if not items:
        return (RDF + "nil", IRI), []
    nodes = [f"b{next(ids)}" for _ in items]
    out, rests = [], [*((n, BLANK) for n in nodes[1:]), (RDF + "nil", IRI)]
    for node, (value, kind), (rest, rest_kind) in zip(nodes, items, rests):
        out.append(Triple(node, BLANK, RDF + "first", value, kind))
        out.append(Triple(node, BLANK, RDF + "rest", rest, rest_kind))
    return (nodes[0], BLANK), out


def shacl(catalog: Catalog, open_: bool = False, root_only: bool = False) -> Iterator[Triple]:
    """SHACL node shapes of the classes; a slot with any_of has its branches in place of its range."""
    ids = count()

    def ranged(subject: str, attribute: Attribute, expression: dict) -> Iterator[Triple]:
        branches = expression.get("any_of") or []
        if not branches:
            target = attribute.range
            if target.kind == "type":
                if catalog.is_iri(target) or expression.get("implicit_prefix"):
                    yield Triple(subject, BLANK, SH + "nodeKind", SH + "IRI")
                else:
                    yield Triple(subject, BLANK, SH + "datatype", catalog.uri(target))
                    yield Triple(subject, BLANK, SH + "nodeKind", SH + "Literal")
            elif target.kind == "class":
                if not catalog.is_any(target):
                    yield Triple(subject, BLANK, SH + "class", catalog.uri(target))
                    yield Triple(subject, BLANK, SH + "nodeKind", SH + "BlankNodeOrIRI")
            else:
                head, triples = _list([(m, IRI) for m in catalog.meanings(target).values()], ids)
                yield from triples
                yield Triple(subject, BLANK, SH + "in", *head)
        ends = []
        for branch in branches:
            node = f"b{next(ids)}"
            ends.append((node, BLANK))
            inner = catalog.attribute(Element(attribute.slot.name, "slot", attribute.slot.schema, dict(branch)))
            yield from ranged(node, inner, branch)
        if ends:
            head, triples = _list(ends, ids)
            yield from triples
            yield Triple(subject, BLANK, SH + "or", *head)

    def described(attribute: Attribute) -> Iterator[tuple]:
        """What is said of a slot without further nodes, as (p, o, o_kind, o_datatype)."""
        slot = attribute.slot
        if slot.meta.get("description"):
            yield SH + "description", slot.meta["description"], LITERAL, XSD + "string"
        if not slot.get("multivalued"):
            yield SH + "maxCount", "1", LITERAL, XSD + "integer"
        if slot.get("required"):
            yield SH + "minCount", "1", LITERAL, XSD + "integer"
        yield SH + "path", catalog.uri(slot), IRI, None
        if attribute.kind != "enum" and not slot.get("any_of"):
            yield from ((t.p, t.o, t.o_kind, t.o_datatype) for t in ranged("", attribute, slot.meta))

    plain: dict[int, list[tuple]] = {}  # classes share the attributes that they inherit
    for cls in catalog.classes.values():
        if root_only and cls.schema is not catalog.root:
            continue
        uri = catalog.uri(cls)
        yield Triple(uri, IRI, RDF + "type", SH + "NodeShape")
        if cls.meta.get("description"):
            yield _literal(uri, IRI, RDFS + "comment", cls.meta["description"])
        closed = not (open_ or cls.get("abstract") or cls.get("mixin"))
        yield _literal(uri, IRI, SH + "closed", str(closed).lower(), XSD + "boolean")
        key = catalog.identifier(cls)
        head, triples = _list([(RDF + "type", IRI)] + ([(key.meta["slot_uri"], IRI)] if key else []), ids)
        yield from triples
        yield Triple(uri, IRI, SH + "ignoredProperties", *head)
        order = 0
        for attribute in catalog.attributes(cls).values():
            if attribute.slot.get("identifier"):
                continue
            node = f"b{next(ids)}"
            yield Triple(uri, IRI, SH + "property", node, BLANK)
            if id(attribute) not in plain:
                plain[id(attribute)] = list(described(attribute))
            for p, o, kind, datatype in plain[id(attribute)]:
                yield Triple(node, BLANK, p, o, kind, datatype)
            if attribute.kind == "enum" or attribute.slot.get("any_of"):
                yield from ranged(node, attribute, attribute.slot.meta)
            yield Triple(node, BLANK, SH + "order", str(order), LITERAL, XSD + "integer")
            order += 1
        yield Triple(uri, IRI, SH + "targetClass", uri)


def rdfs(catalog: Catalog, root_only: bool = False) -> Iterator[Triple]:
    """RDFS classes, properties, enumerations and their values; what shares a URI is described once."""

    def about(uri: str, metas: Iterable[dict]) -> Iterator[Triple]:
        metas = list(metas)
        for metaslot, p in (("title", RDFS + "label"), ("description", RDFS + "comment")):
            for text in dict.fromkeys(m[metaslot] for m in metas if m.get(metaslot)):
                yield _literal(uri, IRI, p, text)

    inside = lambda e: not root_only or e.schema.id == catalog.root.id
    classes: dict[str, list[Element]] = {}
    uses: dict[str, list[tuple[Element, Attribute]]] = {}
    for cls in filter(inside, catalog.classes.values()):
        classes.setdefault(catalog.uri(cls), []).append(cls)
        for attribute in catalog.attributes(cls).values():
            if not attribute.slot.get("identifier"):
                uses.setdefault(catalog.uri(attribute.slot), []).append((cls, attribute))
    for uri, found in classes.items():
        yield Triple(uri, IRI, RDF + "type", RDFS + "Class")
        yield from about(uri, (c.meta for c in found))
        parents = [n for c in found for n in [c.meta.get("is_a"), *c.get("mixins")] if n in catalog.elements]
        for parent in dict.fromkeys(catalog.uri(catalog.elements[n]) for n in parents):
            yield Triple(uri, IRI, RDFS + "subClassOf", parent)
    for uri, found in uses.items():
        yield Triple(uri, IRI, RDF + "type", RDF + "Property")
        yield from about(uri, (a.slot.meta for _, a in found))
        for domain in catalog.lowest_common_ancestors({c.name: c for c, _ in found}.values()):
            yield Triple(uri, IRI, RDFS + "domain", catalog.uri(domain))
        for kind in dict.fromkeys(catalog.uri(a.range) for _, a in found if a.kind != "any"):
            yield Triple(uri, IRI, RDFS + "range", kind)
    enums: dict[str, list[Element]] = {}
    values: dict[str, list[tuple[str, dict]]] = {}
    for enum in filter(inside, catalog.enums.values()):
        enums.setdefault(catalog.uri(enum), []).append(enum)
        for text, meaning in catalog.meanings(enum).items():
            values.setdefault(meaning, []).append((catalog.uri(enum), (enum.meta.get("permissible_values") or {})[text]))
    for uri, found in enums.items():
        yield Triple(uri, IRI, RDF + "type", RDFS + "Class")
        yield from about(uri, (e.meta for e in found))
    for uri, found in values.items():
        for kind in dict.fromkeys(k for k, _ in found):
            yield Triple(uri, IRI, RDF + "type", kind)
        yield from about(uri, (m for _, m in found))


def namespaces(catalog: Catalog) -> list[tuple[str, str]]:
    """Prefixes and namespaces of the root schema, by prefix."""
    return sorted((p, namespace(r)) for p, r in catalog.prefixes(catalog.root).items())


def ntriples(triples: Iterable[Triple]) -> Iterator[str]:
    return (t.line() for t in triples)


def ntriples_text(triples: Iterable[Triple]) -> str:
    return "\n".join([*(t.line() for t in triples), ""])


def turtle(triples: Iterable[Triple], prefixes: list[tuple[str, str]]) -> str:
    """A plain Turtle text: prefixes, then the triples by subject."""

    def end(value: str, kind: str) -> str:
        if kind == BLANK:
            return f"_:{value}"
        for prefix, space in prefixes:
            local = value[len(space) :]
            if value.startswith(space) and local.replace("_", "a").replace("-", "a").isalnum():
                return f"{prefix}:{local}"
        return f"<{ntriples_escape(value, True)}>"

    by_subject: dict[tuple[str, str], list[str]] = {}
    for t in triples:
        o = f'"{ntriples_escape(t.o)}"' + ("" if t.o_datatype in (None, XSD + "string") else f"^^{end(t.o_datatype, IRI)}") if t.o_kind == LITERAL else end(t.o, t.o_kind)
        by_subject.setdefault((t.s, t.s_kind), []).append(f"{end(t.p, IRI)} {o}")
    head = "".join(f"@prefix {p}: <{s}> .\n" for p, s in prefixes)
    return head + "\n" + "\n".join(f"{end(*s)} " + " ;\n    ".join(found) + " .\n" for s, found in by_subject.items())


def to_frame(spark: SparkSession, triples: Iterable[Triple]) -> DataFrame:
    return spark.createDataFrame([(t.s, t.s_kind, t.p, t.o, t.o_kind, t.o_datatype) for t in triples], TRIPLES)


# -- over DataFrames


def instances(df: DataFrame, catalog: Catalog, cls: str, subject: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Rows of a class as triples, without a shuffle: a type, and each value of each slot.

    The subject is the identifier in the class's default namespace unless given; references become IRIs of
    their class's namespace, enumerations their meanings, CURIEs are expanded and implicit prefixes applied;
    nulls are left out. Inline objects, in lists and dictionaries too, are nodes of their own, to the end of
    the schema: named by their identifier, else blank, labelled by where they stand. What cannot be put as an
    IRI (a value that is none of its enumeration) and values of any type are literals. Columns to ``keep`` go along
    with the triples of their row.
    """
    named, rows = _instance(df, catalog, cls, subject)
    return named.select(*keep, F.explode(rows).alias("t")).select(*keep, "t.s", "t.s_kind", "t.p", "t.o", "t.o_kind", "t.o_datatype")


def instance_rows(df: DataFrame, catalog: Catalog, cls: str, subject: Column | None = None) -> DataFrame:
    """The rows with what ``instances`` makes of each as an array, ``triples``."""
    named, rows = _instance(df, catalog, cls, subject)
    return named.withColumn("triples", rows).drop("_subject")


def _instance(df: DataFrame, catalog: Catalog, cls: str, subject: Column | None) -> tuple[DataFrame, Column]:
    """The rows with their subjects, and the triples of each."""
    element = catalog.classes[cls]
    key = catalog.identifier(element)
    if subject is None:
        if key is None:
            raise ValueError(f"class {cls} has no identifier; give a subject")
        subject = F.concat(F.lit(instance_space(catalog, element)), F.col(catalog.alias(key)).cast("string"))
    return df.withColumn("_subject", subject), _node(catalog, element, df.schema, lambda name: F.col(f"`{name}`"), F.col("_subject"), F.lit(IRI))


def _row(s: Column, s_kind: Column, p: str, o: Column, kind: Column, datatype: str | None = None) -> Column:
    return F.struct(s.alias("s"), s_kind.alias("s_kind"), F.lit(p).alias("p"), o.alias("o"), kind.alias("o_kind"), F.lit(datatype).cast("string").alias("o_datatype"))


def _node(catalog: Catalog, cls: Element, schema: T.StructType, at: Callable[[str], Column], s: Column, kind: Column) -> Column:
    """The triples of one object as an array: its type, and what its members say."""
    rows = [F.array(_row(s, kind, RDF + "type", F.lit(catalog.uri(cls)), F.lit(IRI)))]
    fields = {f.name: f.dataType for f in schema.fields}
    for attribute in catalog.attributes(cls).values():
        if attribute.slot.get("identifier") or attribute.name not in fields:
            continue
        rows.append(F.coalesce(_values(catalog, attribute, at(attribute.name), fields[attribute.name], s, kind), F.array().cast(_ROWS)))
    return F.flatten(F.array(*rows))


def _values(catalog: Catalog, attribute: Attribute, col: Column, kind: T.DataType, s: Column, s_kind: Column) -> Column:
    """The triples of a slot's values; null where there are none."""
    inline = attribute.kind == "inline"
    if isinstance(kind, T.ArrayType):
        return F.flatten(F.transform(col, lambda x, i: F.coalesce(_value(catalog, attribute, x, kind.elementType, s, s_kind, i), F.array().cast(_ROWS))))
    if isinstance(kind, T.MapType) and inline and isinstance(kind.valueType, T.StructType):
        entries = F.map_entries(col)
        return F.flatten(F.transform(entries, lambda e, i: F.coalesce(_value(catalog, attribute, e["value"], kind.valueType, s, s_kind, i, e["key"]), F.array().cast(_ROWS))))
    if isinstance(kind, T.MapType) and inline and attribute.form and attribute.form.value:
        value = catalog.attributes(attribute.range)[attribute.form.value]
        only = T.StructType([T.StructField(value.name, kind.valueType)])

        def entry(e: Column, i: Column) -> Column:
            return F.coalesce(_value(catalog, attribute, F.struct(e["value"].alias(value.name)), only, s, s_kind, i, e["key"]), F.array().cast(_ROWS))

        return F.flatten(F.transform(F.map_entries(col), entry))
    return _value(catalog, attribute, col, kind, s, s_kind, F.lit(0))


def _value(catalog: Catalog, attribute: Attribute, x: Column, kind: T.DataType, s: Column, s_kind: Column, i: Column, key: Column | None = None) -> Column:
    """The triples of one value, null for a null; ``i`` is its place, ``key`` its key in a dictionary."""
    p = catalog.uri(attribute.slot)
    if attribute.kind == "inline" and isinstance(kind, T.StructType):
        own = catalog.identifier(attribute.range)
        name = catalog.alias(own) if own is not None else None
        given = key if key is not None and own is not None else x[name] if name in kind.names else None
        blank = F.concat(F.lit("b"), F.md5(F.concat_ws("|", s, F.lit(p), i.cast("string")).cast("binary")))
        node = blank if given is None else F.coalesce(F.concat(F.lit(instance_space(catalog, attribute.range)), given.cast("string")), blank)
        node_kind = F.lit(BLANK) if given is None else F.when(given.isNotNull(), IRI).otherwise(BLANK)
        inner = _node(catalog, attribute.range, kind, lambda n: x[n], node, node_kind)
        return F.when(x.isNotNull(), F.concat(F.array(_row(s, s_kind, p, node, node_kind)), inner))
    if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)):
        value, o_kind, datatype = F.to_json(x), F.lit(LITERAL), None
    else:
        value, o_kind, datatype = _object(catalog, attribute, x)
    return F.when(x.isNotNull(), F.array(_row(s, s_kind, p, value, o_kind, datatype)))


def instance_space(catalog: Catalog, element: Element) -> str:
    return f"{catalog.default_namespace(element.schema)}{catalog.local_name(element).lower()}/"


def _object(catalog: Catalog, attribute: Attribute, x: Column) -> tuple[Column, Column, str | None]:
    """A scalar as an object: its text, what it is, and a literal's type."""
    text = x.cast("string")
    if attribute.kind in ("any", "inline"):
        return text, F.lit(LITERAL), None
    if attribute.kind == "enum":
        found = catalog.meanings(attribute.range)
        if not found:
            return text, F.lit(LITERAL), None
        meaning = F.try_element_at(F.create_map(*[F.lit(v) for pair in found.items() for v in pair]), text)
        return F.coalesce(meaning, text), F.when(meaning.isNotNull(), IRI).otherwise(LITERAL), None
    how = catalog.subject_type(attribute)
    if how.startswith("implicit:"):
        space = namespace(catalog.prefixes(attribute.slot.schema)[how.removeprefix("implicit:")])
        return F.concat(F.lit(space), text), F.lit(IRI), None
    if how in ("uri", "curie", "uriorcurie"):
        return F.coalesce(expand_col(text, catalog.prefixes(attribute.slot.schema), strict=False), text), F.lit(IRI), None
    if attribute.kind == "reference":
        return F.concat(F.lit(instance_space(catalog, attribute.range)), text), F.lit(IRI), None
    return text, F.lit(LITERAL), catalog.uri(attribute.range)


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """value: one N-Triples line a triple, by built-in functions alone."""
    iri = lambda v: F.concat(F.lit("<"), ntriples_iri(v), F.lit(">"))
    end = lambda v, k: F.when(k == BLANK, F.concat(F.lit("_:"), v)).otherwise(iri(v))
    plain = F.col("o_datatype").isNull() | (F.col("o_datatype") == XSD + "string")
    quoted = F.concat(F.lit('"'), ntriples_string(F.col("o")), F.lit('"'))
    typed = F.when(plain, quoted).otherwise(F.concat(quoted, F.lit("^^"), iri(F.col("o_datatype"))))
    o = F.when(F.col("o_kind") == LITERAL, typed).otherwise(end(F.col("o"), F.col("o_kind")))
    return triples.select(F.concat(end(F.col("s"), F.col("s_kind")), F.lit(" "), iri(F.col("p")), F.lit(" "), o, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """Lines written by each partition as they come; the graph is never gathered."""
    ntriples_lines(triples).write.mode("overwrite").text(path)


def turtle_lines(triples: DataFrame, prefixes: list[tuple[str, str]]) -> DataFrame:
    """value: Turtle texts, in order within each partition; each partition is a document that stands alone.

    Triples are sorted by ranges of subject, predicate and object, so that a subject of any number of triples is split,
    and its run goes on from batch to batch. Of the prefixes whose namespace an IRI begins with, the longest is used,
    where the rest is a plain name. Repeated triples stay, languages (``o_lang``) too where there are any; a null subject,
    predicate or object gives no triple.
    """
    spaces = sorted(prefixes, key=lambda pair: (-len(pair[1]), pair[0]))

    def iri(v: Column) -> Column:
        short = [F.when(v.startswith(space) & F.substr(v, F.lit(len(space) + 1)).rlike("^([A-Za-z0-9_][A-Za-z0-9_-]*)?$"), F.concat(F.lit(f"{prefix}:"), F.substr(v, F.lit(len(space) + 1)))) for prefix, space in spaces]
        return F.coalesce(*short, F.concat(F.lit("<"), ntriples_iri(v), F.lit(">")))

    end = lambda v, k: F.when(k == BLANK, F.concat(F.lit("_:"), v)).otherwise(iri(v))
    quoted = F.concat(F.lit('"'), ntriples_string(F.col("o")), F.lit('"'))
    plain = F.col("o_datatype").isNull() | (F.col("o_datatype") == XSD + "string")
    literal = F.when(plain, quoted).otherwise(F.concat(quoted, F.lit("^^"), iri(F.col("o_datatype"))))
    if "o_lang" in triples.columns:
        literal = F.when(F.col("o_lang").isNull(), literal).otherwise(F.concat(quoted, F.lit("@"), F.col("o_lang")))
    verb = F.when(F.col("p") == RDF + "type", "a").otherwise(iri(F.col("p")))
    parts = triples.select(end(F.col("s"), F.col("s_kind")).alias("s"), verb.alias("p"), F.when(F.col("o_kind") == LITERAL, literal).otherwise(end(F.col("o"), F.col("o_kind"))).alias("o")).dropna()
    head = "".join(f"@prefix {p}: <{ntriples_escape(s, True)}> .\n" for p, s in prefixes)

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_s = last_p = None
        said = 0  # triples of the run that the batch before ended with
        for b in batches:
            if b.empty:
                continue
            s, p, o = b["s"], b["p"], b["o"]
            new = s != s.shift(1, fill_value=last_s)
            run = new.cumsum()
            place = run.groupby(run).cumcount() + (run == 0) * said
            first = new | (place % STATEMENT == 0)
            value = ("    , " + o).mask(p != p.shift(1, fill_value=last_p), "    ; " + p + " " + o).mask(first, ".\n" + s + " " + p + " " + o)
            if last_s is None:
                value.iloc[0] = head + value.iloc[0].removeprefix(".\n")
            yield value.to_frame("value")
            last_s, last_p, said = s.iloc[-1], p.iloc[-1], int(place.iloc[-1]) + 1
        if last_s is not None:
            yield pd.DataFrame({"value": ["."]})

    return parts.repartitionByRange("s", "p", "o").sortWithinPartitions("s", "p", "o").mapInPandas(lines, "value string")


def write_turtle(triples: DataFrame, path: str, prefixes: list[tuple[str, str]]) -> None:
    """Turtle files, each with all prefixes; the graph is never gathered."""
    turtle_lines(triples, prefixes).write.mode("overwrite").text(path)
