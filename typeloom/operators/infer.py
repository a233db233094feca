"""Computed and default values of a class, applied to DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions import expressions
from typeloom.plans.catalog import Attribute, Catalog


def _computed(df: DataFrame, catalog: Catalog, cls: str, strict: bool) -> dict[str, Column]:
    """Columns of the slots whose equals_expression counts: single-valued strings; others carry none."""
    out = {}
    for attribute in catalog.attributes(catalog.classes[cls]).values():
        text = attribute.slot.meta.get("equals_expression")
        if text is None or attribute.slot.get("multivalued") or attribute.kind != "type" or catalog.runtime_type(attribute.range) != "string":
            continue
        out[attribute.name] = expressions.interpolate(df, text, strict)
    return out


def inferred(df: DataFrame, catalog: Catalog, cls: str, strict: bool = True) -> DataFrame:
    """df with missing computed values filled in; one that differs is an error, or null if not strict.

    Expressions read the given values: one computed slot does not feed another.
    """
    found = _computed(df, catalog, cls, strict)
    given = {n: F.col(f"`{n}`") if n in df.columns else F.lit(None).cast("string") for n in found}
    return df.withColumns({n: expressions.infer_optional(given[n], c, strict) for n, c in found.items()}) if found else df


def conflicts(df: DataFrame, catalog: Catalog, cls: str, keys: Sequence[str]) -> DataFrame:
    """keys, slot, constraint for given values that contradict their expression."""
    found = {n: c for n, c in _computed(df, catalog, cls, strict=False).items() if n in df.columns}
    broken = [F.when(expressions.infer_conflict(F.col(f"`{n}`"), c), F.lit(n)) for n, c in found.items()]
    listed = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    return df.select(*keys, F.explode(listed).alias("slot")).withColumn("constraint", F.lit("equals_expression"))


def with_defaults(df: DataFrame, catalog: Catalog, cls: str) -> DataFrame:
    """df with missing enumeration values replaced by what ``ifabsent`` names."""
    out: dict[str, Column] = {}
    for attribute in catalog.attributes(catalog.classes[cls]).values():
        default = catalog.default_value(attribute)
        if default is not None and attribute.name in df.columns:
            out[attribute.name] = expressions.fill_default(F.col(f"`{attribute.name}`"), default)
    return df.withColumns(out) if out else df


def implicit_iris(df: DataFrame, catalog: Catalog, cls: str) -> DataFrame:
    """df with the values of slots with an implicit prefix as URIs."""
    out: dict[str, Column] = {}
    for attribute in catalog.attributes(catalog.classes[cls]).values():
        space = _space(catalog, attribute)
        if space is None or attribute.name not in df.columns:
            continue
        col = F.col(f"`{attribute.name}`")
        if isinstance(df.schema[attribute.name].dataType, T.ArrayType):
            out[attribute.name] = F.transform(col, _prefixed(space))
        else:
            out[attribute.name] = _prefixed(space)(col)
    return df.withColumns(out) if out else df


def _space(catalog: Catalog, attribute: Attribute) -> str | None:
    from typeloom.functions.names import namespace

    if attribute.kind not in ("type", "reference"):
        return None
    how = catalog.subject_type(attribute)
    return namespace(catalog.prefixes(attribute.slot.schema)[how.removeprefix("implicit:")]) if how.startswith("implicit:") else None


def _prefixed(space: str):
    return lambda x: F.concat(F.lit(space), x.cast("string"))
