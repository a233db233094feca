"""Readers of instances: CSV with JSON in the cells of lists, JSON lines, triples, any table of Spark's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.operators.render import struct_type
from typeloom.operators.validate import codec
from typeloom.plans.catalog import Catalog


def read_csv(spark: SparkSession, path: str, catalog: Catalog, cls: str) -> DataFrame:
    """Cells as texts, ready to be validated: an empty cell is null, a list is JSON in its cell."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    many = {a.name for a in catalog.attributes(catalog.classes[cls]).values() if a.slot.get("multivalued")}
    return raw.withColumns({c: F.from_json(c, "array<string>") for c in raw.columns if c in many}) if many & set(raw.columns) else raw


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """json: the text of each document, one a line, for the strict checks of validate.json_valid."""
    return spark.read.text(path).filter(F.trim("value") != "").select(F.col("value").alias("json"))


#: A line of N-Triples: subject, predicate, then an IRI or blank node, or a literal with its type or its language.
_LINE = r"^\s*(<[^>\s]*>|_:[^\s<>\"]+)\s*<([^>\s]*)>\s*(?:(<[^>\s]*>|_:[^\s<>\"]*[^\s<>\".])|\"((?:[^\"\\]|\\.)*)\"(?:\^\^<([^>\s]*)>|@([A-Za-z]+(?:-[A-Za-z0-9]+)*))?)\s*\.\s*(?:#.*)?$"
#: Escapes that stand for no character: a half of a pair, or beyond the last one.
_NO_CHARACTER = r"\\u[dD][89a-fA-F]|\\U(?!000[0-9A-Fa-f]|0010)|\\U0000[dD][89a-fA-F]"
_NO_ESCAPE = r"(?<!\\)(?:\\\\)*\\(?![tbnrf\"'\\]|u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8})"


def _unescaped(text: Column) -> Column:
    """A text with its escapes as the characters they stand for."""
    pieces = F.regexp_extract_all(text, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), F.lit(1))
    fixed = F.create_map(*[F.lit(x) for pair in {"\\t": "\t", "\\b": "\b", "\\n": "\n", "\\r": "\r", "\\f": "\f", '\\"': '"', "\\'": "'", "\\\\": "\\"}.items() for x in pair])

    def one(p: Column) -> Column:
        coded = F.decode(F.unhex(F.lpad(F.substring(p, 3, 8), 8, "0")), "UTF-32")
        return F.when(p.rlike(r"^\\[uU]"), coded).when(p.startswith("\\"), F.try_element_at(fixed, p)).otherwise(p)

    return F.when(text.contains("\\"), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def ntriples_table(lines: DataFrame, value: str = "value") -> DataFrame:
    """s, s_kind, p, o, o_kind, o_datatype, o_lang, line, reason of each line that is not blank or a comment alone.

    Escapes are decoded. A line that is no triple has its text in ``line`` and why in ``reason``: syntax, escape (one
    that there is not) or character (an escape that stands for none); its other columns are null.
    """
    text = F.col(value)
    rows = lines.filter(text.isNotNull() & ~text.rlike(r"^\s*(#.*)?$"))
    reason = F.when(~text.rlike(_LINE), "syntax").when(text.contains("\\") & text.rlike(_NO_ESCAPE), "escape").when(text.contains("\\") & text.rlike(_NO_CHARACTER), "character")
    fine = F.col("reason").isNull()
    part = lambda i: F.regexp_extract("line", _LINE, i)
    name = lambda c: _unescaped(F.regexp_replace(c, "^(<|_:)|>$", ""))
    kind = lambda c: F.when(c.startswith("_:"), "blank").otherwise("iri")
    # an empty object is a literal too
    literal = part(3) == ""
    columns = {
        "s": name(part(1)),
        "s_kind": kind(part(1)),
        "p": _unescaped(part(2)),
        "o": F.when(literal, _unescaped(part(4))).otherwise(name(part(3))),
        "o_kind": F.when(literal, "literal").otherwise(kind(part(3))),
        "o_datatype": _unescaped(F.nullif(part(5), F.lit(""))),
        "o_lang": F.nullif(part(6), F.lit("")),
    }
    return rows.select(text.alias("line"), reason.alias("reason")).select(*[F.when(fine, c).alias(n) for n, c in columns.items()], F.when(~fine, F.col("line")).alias("line"), "reason")


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """s, s_kind, p, o, o_kind, o_datatype of the lines of N-Triples, escapes decoded; for the lines that are no triples
    see ``ntriples_rejects``, for languages ``ntriples_table``."""
    return ntriples_table(spark.read.text(path)).filter("reason IS NULL").drop("o_lang", "line", "reason")


def ntriples_rejects(spark: SparkSession, path: str) -> DataFrame:
    """line, reason of the lines that ``read_ntriples`` leaves out."""
    return ntriples_table(spark.read.text(path)).filter("reason IS NOT NULL").select("line", "reason")


def decode_any(text: Column, spark_type: str) -> Column:
    """The value of an any-typed slot, kept as JSON text, as a Spark type; null where it does not fit."""
    return F.try_variant_get(F.try_parse_json(text), "$", spark_type)


def typed(df: DataFrame, catalog: Catalog, cls: str) -> DataFrame:
    """df with the class's types; a value that does not fit becomes null, so validate first."""
    out = {}
    ranges = {a.name: a.range.name for a in catalog.attributes(catalog.classes[cls]).values() if a.kind == "type"}
    for field in struct_type(catalog, cls).fields:
        if field.name not in df.columns:
            continue
        decode = codec(ranges.get(field.name, ""))
        if decode is not None and isinstance(df.schema[field.name].dataType, T.StringType):
            out[field.name] = decode(F.col(f"`{field.name}`"))
            continue
        given = df.schema[field.name].dataType
        if given == field.dataType:
            continue
        col = F.col(f"`{field.name}`")
        if isinstance(given, T.ArrayType) and isinstance(field.dataType, T.ArrayType):
            inner = field.dataType.elementType
            out[field.name] = F.transform(col, _cast(inner))
        else:
            out[field.name] = col.try_cast(field.dataType)
    return df.withColumns(out) if out else df


def _cast(kind: T.DataType):
    return lambda x: x.try_cast(kind)
