"""Schema documents as rows: a table of paths, on which lint rules are filters, groups and joins.

A table of documents (JSON texts) becomes one of nodes (document, path, shape, value) by exploding one level of
variants after the other. Whatever a rule asks, it asks of all documents at once; no document is loaded.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions.names import CURIE_PATTERN, URI_PATTERN
from typeloom.plans.model import BOOLEAN, EMIT_PREFIXES, KINDS, SEMWEB_PREFIXES
from typeloom.session import staged

#: Metaslots of an element whose value is a collection by name, as a document's kinds and prefixes are; as a list, each item has its name inside.
_NESTED = ("attributes", "slot_usage", "permissible_values")
_LANGUAGE = "https://w3id.org/linkml/"


def _shape(v: Column) -> Column:
    kind = F.schema_of_variant(v)
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def path_table(documents: DataFrame, key: str, text: str) -> DataFrame:
    """key, path, shape, value: a row for each node of each JSON text, the whole text at the empty path.

    Shapes are object, array, string, number, boolean and null; value is a scalar's text. Items of lists stand at their
    place, those of collections by name at their name; a bare name in such a list is a null there. A text that is null or
    no JSON has one row, of shape invalid. Documents are told apart by their key. A level costs a job.
    """
    v = F.try_parse_json(text)
    root = documents.select(key, F.array().cast("array<string>").alias("path"), F.when(v.isNull(), "invalid").otherwise(_shape(v)).alias("shape"), v.alias("_v"))
    rest = (F.col("shape").isin("object", "array"), F.to_json("_v"))
    given = lambda df: df.select(key, "path", "shape", F.when(F.col("shape").isin("string", "number", "boolean"), F.coalesce(F.try_variant_get("_v", "$", "string"), rest[1])).alias("value"), F.when(*rest).alias("_body"))
    level, _ = staged(given(root), "paths")
    found = level
    while True:
        held = level.filter("_body IS NOT NULL").withColumn("_v", F.try_parse_json("_body"))
        members = F.map_entries(F.try_variant_get("_v", "$", "map<string,variant>"))
        items = F.try_variant_get("_v", "$", "array<variant>")
        by_name = F.coalesce((_n() == 1) & _at(0).isin(*KINDS, "prefixes") | (_n() == 3) & _at(2).isin(*_NESTED), F.lit(False))

        def item(x: Column, i: Column) -> Column:
            is_object = F.schema_of_variant(x).startswith("OBJECT")
            name = F.when(is_object, F.coalesce(F.try_variant_get(x, "$.name", "string"), F.try_variant_get(x, "$.text", "string"))).otherwise(F.try_variant_get(x, "$", "string"))
            named = F.struct(F.coalesce(name, i.cast("string")).alias("key"), F.when(is_object, x).otherwise(F.parse_json(F.lit("null"))).alias("value"))
            return F.when(by_name, named).otherwise(F.struct(i.cast("string").alias("key"), x.alias("value")))

        children = F.when(F.col("shape") == "object", members).otherwise(F.transform(items, item)).cast("array<struct<key:string,value:variant>>")
        out = held.withColumn("_e", F.explode(F.coalesce(children, F.array().cast("array<struct<key:string,value:variant>>")))).select(key, F.concat("path", F.array("_e.key")).alias("path"), F.col("_e.value").alias("_v"))
        level, _ = staged(given(out.withColumn("shape", F.when(F.col("_v").isNull(), "null").otherwise(_shape(F.col("_v"))))), "paths")
        if level.isEmpty():
            return found.drop("_body")
        found = found.unionByName(level)


def _at(i: int) -> Column:
    return F.try_element_at("path", F.lit(i + 1))


def _n() -> Column:
    return F.size("path")


def _given() -> Column:
    return F.col("shape") != "null"


def _issue(rows: DataFrame, key: str, issue: str, where: Column, value: Column | None = None) -> DataFrame:
    return rows.select(key, F.lit(issue).alias("issue"), where.alias("path"), (F.lit(None).cast("string") if value is None else value).alias("value"))


def _pointer() -> Column:
    return F.concat(F.lit("/"), F.array_join("path", "/"))


def parse_errors(nodes: DataFrame, key: str) -> DataFrame:
    """SchemaParseError: no JSON object, no id or name, collections and elements that are no mappings, metaslots of a wrong type."""
    plural = _at(0).isin(*KINDS)
    nested = F.coalesce(_at(2).isin(*_NESTED), F.lit(False))
    body = (_n() == 1) & ~_at(0).isin(*KINDS, "prefixes", "imports") | (_n() == 3) & plural | (_n() == 5) & plural & nested
    collection = (_n() == 1) & _at(0).isin(*KINDS, "prefixes") | (_n() == 3) & plural & nested
    element = (_n() == 2) & plural | (_n() == 4) & plural & F.coalesce(_at(2).isin("attributes", "slot_usage"), F.lit(False))
    last = F.try_element_at("path", F.lit(-1))
    whole = F.col("value").try_cast("int")
    counted = (last == "rank") | last.endswith("_cardinality")
    wrong = (
        (_n() == 0) & (F.col("shape") != "object")
        | collection & ~F.col("shape").isin("object", "array", "null")
        | element & ~F.col("shape").isin("object", "null")
        | body & last.isin(*sorted(BOOLEAN)) & ~F.col("shape").isin("boolean", "null")
        | body & counted & ~(F.col("shape").isin("null") | (F.col("shape") == "number") & F.coalesce(whole.cast("string") == F.col("value"), F.lit(False)))
    )
    # a negated test of no element is unknown
    broken = _issue(nodes.filter(F.coalesce(wrong, F.lit(False))), key, "SchemaParseError", _pointer())
    roots = nodes.filter((_n() == 0) & (F.col("shape") == "object")).select(key)
    named = nodes.filter((_n() == 1) & _at(0).isin("id", "name") & _given()).groupBy(key).agg(F.count(F.lit(1)).alias("_k")).filter("_k = 2")
    return broken.unionByName(_issue(roots.join(named, key, "left_anti"), key, "SchemaParseError", F.lit("/")))


def _decoded(nodes: DataFrame, key: str) -> DataFrame:
    """key of the documents that are JSON objects."""
    return nodes.filter((_n() == 0) & (F.col("shape") == "object")).select(key)


def tree_roots(nodes: DataFrame, key: str) -> DataFrame:
    """MultipleTreeRoots, with the classes, and NoTreeRootClass."""
    marked = nodes.filter((_n() == 3) & (_at(0) == "classes") & (_at(2) == "tree_root") & (F.col("value") == "true"))
    counts = marked.groupBy(key).agg(F.count(F.lit(1)).alias("_k"), F.array_join(F.array_sort(F.collect_list(_at(1))), ",").alias("_names"))
    many = _issue(counts.filter("_k > 1"), key, "MultipleTreeRoots", F.lit(""), F.col("_names"))
    return many.unionByName(_issue(_decoded(nodes, key).join(counts, key, "left_anti"), key, "NoTreeRootClass", F.lit("")))


def default_ranges(nodes: DataFrame, key: str) -> DataFrame:
    """UndefinedDefaultRange of documents in which a slot has no range to fall back on, and InvalidDefaultRange for each slot that would.

    A range to fall back on is a default_range, a type string of its own, or any built-in schema imported.
    """
    built_in = F.col("value").startswith("linkml:") | F.col("value").startswith(_LANGUAGE)
    has = (_n() == 1) & (_at(0) == "default_range") & _given() | (_n() == 2) & (_at(0) == "types") & (_at(1) == "string") | (_n() <= 2) & (_at(0) == "imports") & built_in
    lost = _decoded(nodes, key).join(nodes.filter(F.coalesce(has, F.lit(False))).select(key).distinct(), key, "left_anti")
    is_slot = (_n() == 2) & (_at(0) == "slots") | (_n() == 4) & _at(0).isin(*KINDS) & (_at(2) == "attributes")
    is_range = (_n() == 3) & (_at(0) == "slots") & (_at(2) == "range") | (_n() == 5) & _at(0).isin(*KINDS) & (_at(2) == "attributes") & (_at(4) == "range")
    slots = nodes.filter(F.coalesce(is_slot | is_range & _given(), F.lit(False))).withColumn("path", F.when(is_slot, F.col("path")).otherwise(F.slice("path", 1, _n() - 1)))
    bare = slots.join(lost, key, "left_semi").groupBy(key, "path").agg(F.count(F.lit(1)).alias("_k")).filter("_k = 1")
    return _issue(lost, key, "UndefinedDefaultRange", F.lit("")).unionByName(_issue(bare, key, "InvalidDefaultRange", F.concat(_pointer(), F.lit("/range/"))))


def invalid_uris(nodes: DataFrame, key: str) -> DataFrame:
    """InvalidUriOrCurie: URIs of elements, attributes and permissible values that are neither, or whose prefix no one declares."""
    own = F.coalesce((_n() == 3) & F.concat_ws("/", _at(0), _at(2)).isin("classes/class_uri", "slots/slot_uri", "enums/enum_uri", "types/uri", "subsets/uri"), F.lit(False))
    inner = F.coalesce((_n() == 5) & F.concat_ws("/", _at(2), _at(4)).isin("attributes/slot_uri", "permissible_values/meaning"), F.lit(False))
    value = F.col("value")
    asked = nodes.filter((own | inner) & value.isNotNull()).withColumn("_p", F.when(value.contains(":"), F.substring_index(value, ":", 1)))
    declared = nodes.filter((_n() == 2) & (_at(0) == "prefixes")).select(key, _at(1).alias("_p"))
    maps = nodes.filter((_at(0) == "default_curi_maps") & (value == "semweb_context")).select(key, F.explode(F.array(*map(F.lit, SEMWEB_PREFIXES))).alias("_p"))
    known = declared.unionByName(maps).distinct().withColumn("_known", F.lit(True))
    is_uri = value.contains("://") | value.startswith("urn:")
    plain = value.rlike(r"^[^\s:<>\"{}|\\^`]*$")
    curie = value.rlike(CURIE_PATTERN) & (F.col("_p").isin(*EMIT_PREFIXES) | F.col("_known").isNotNull())
    fine = F.when(is_uri, value.rlike(URI_PATTERN)).otherwise(plain | F.coalesce(curie, F.lit(False)))
    return _issue(asked.join(known, [key, "_p"], "left").filter(~fine), key, "InvalidUriOrCurie", _pointer(), value)


def digests(nodes: DataFrame, key: str) -> DataFrame:
    """key, id, digest: of each document its id and a digest of its content, however its members are ordered and its text is spaced.

    Scalars count by shape and value, so 1 and "1" differ. A document's nodes are summed up as two 64-bit hashes, whose
    order is none; documents that differ agree with a chance of some 2^-128.
    """
    place = F.concat_ws("\x1f", F.col("path"))
    hashes = [F.sum(F.xxhash64(F.lit(seed), place, "shape", "value").cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    own = F.max(F.when((_n() == 1) & (_at(0) == "id"), F.col("value")))
    return nodes.groupBy(key).agg(own.alias("id"), F.concat_ws(",", *hashes, F.count(F.lit(1)).cast("string")).alias("digest"))


def id_clashes(documents: DataFrame) -> DataFrame:
    """id, n_documents, n_contents of the ids that documents (id, digest) of different contents share; SchemaIdClash for what loads them together."""
    by = documents.filter("id IS NOT NULL").groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("id").agg(F.sum("n").alias("n_documents"), F.count(F.lit(1)).alias("n_contents")).filter("n_contents > 1")


#: What keeps a document from being loaded; where there is any of it, nothing else is told.
FATAL = ("SchemaParseError", "InvalidDefaultRange")


def document_issues(nodes: DataFrame, key: str, fatal: Sequence[str] = FATAL) -> DataFrame:
    """key, issue, path, value: the rules of this module over all documents; parse errors hide all else, other fatal issues what is not fatal."""
    errors, _ = staged(parse_errors(nodes, key), "parse-errors")
    rest, _ = staged(reduce(DataFrame.unionByName, [rule(nodes, key) for rule in (tree_roots, default_ranges, invalid_uris)]).join(errors.select(key).distinct(), key, "left_anti"), "issues")
    hidden = rest.filter(F.col("issue").isin(*fatal)).select(key).distinct()
    told = rest.filter(F.col("issue").isin(*fatal)).unionByName(rest.filter(~F.col("issue").isin(*fatal)).join(hidden, key, "left_anti"))
    return errors.unionByName(told)
