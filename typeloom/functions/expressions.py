"""Expressions of a schema compiled to Columns: defaults, string interpolation and inference."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.functions import names


class ExpressionError(ValueError):
    pass


def parse_constructor(text: str, enum: str, values: Iterable[str]) -> str:
    """The value of ``Enum(VALUE)``; the enum must be the range and must have the value."""
    found = re.fullmatch(r"\s*([^()]+?)\s*\((.*)\)\s*", text, re.S)
    if found is None:
        raise ExpressionError(f"not a constructor: {text}")
    if found[1] not in (enum, names.pascal_case(enum)):
        raise ExpressionError(f"{found[1]} is not the range {enum}")
    if found[2] not in set(values):
        raise ExpressionError(f"{enum} has no value {found[2]}")
    return found[2]


@dataclass(frozen=True)
class Path:
    """A slot, or a slot of an inlined object, by its parts."""

    parts: tuple[str, ...]


def parse_interpolation(text: str) -> list[str | Path]:
    """Literals and paths of ``a {slot} b {slot.part}``; {{ and }} stand for braces, neighbouring literals are one."""
    out: list[str | Path] = []
    literal, at = "", 0
    while at < len(text):
        two = text[at : at + 2]
        if two in ("{{", "}}"):
            literal, at = literal + two[0], at + 2
        elif text[at] == "{":
            end = text.find("}", at)
            name = text[at + 1 : end].strip() if end > 0 else ""
            if not name or "{" in name or any(not p.strip() for p in name.split(".")):
                raise ExpressionError(f"a brace at {at} does not hold a slot: {text}")
            if literal:
                out.append(literal)
                literal = ""
            out.append(Path(tuple(p.strip() for p in name.split("."))))
            at = end + 1
        elif text[at] == "}":
            raise ExpressionError(f"a brace at {at} is not opened: {text}")
        else:
            literal, at = literal + text[at], at + 1
    if literal:
        out.append(literal)
    return out


_RENDERERS: dict[str, Callable[[Column], Column]] = {}


def register_renderer(spark_type: str, render: Callable[[Column], Column]) -> None:
    """How values of a Spark type become text in interpolations."""
    _RENDERERS[spark_type] = render


def stringify(value: Column, spark_type: str) -> Column:
    """Text of a value: lists joined by a comma and a space, others as Spark writes them."""
    if spark_type in _RENDERERS:
        return _RENDERERS[spark_type](value)
    if spark_type.startswith("array<"):
        inner = spark_type[6:-1]
        return F.array_join(F.transform(value, lambda x: stringify(x, inner)), ", ")
    return value if spark_type == "string" else value.cast("string")


def _type_at(df: DataFrame, path: Path) -> str:
    kind = df.schema
    for part in path.parts:
        fields = {f.name: f.dataType for f in getattr(kind, "fields", [])}
        if part not in fields:
            raise ExpressionError(f"unknown slot {'.'.join(path.parts)}")
        kind = fields[part]
    if kind.typeName() in ("struct", "map"):
        raise ExpressionError(f"{'.'.join(path.parts)} is an object")
    return kind.simpleString()


def interpolate(df: DataFrame, text: str, strict: bool = True) -> Column:
    """The text with slots of df filled in; a slot that is null is an error, or makes it null if not strict."""
    parts = []
    for part in parse_interpolation(text):
        if isinstance(part, str):
            parts.append(F.lit(part))
        else:
            name = ".".join(part.parts)
            value = stringify(F.col(".".join(f"`{p}`" for p in part.parts)), _type_at(df, part))
            parts.append(F.coalesce(value, F.raise_error(F.lit(f"{name} has no value"))) if strict else value)
    return F.concat(*parts) if parts else F.lit("")


def infer_optional(given: Column, computed: Column, strict: bool = True) -> Column:
    """The computed value where none is given; one that differs is an error, or null if not strict."""
    wrong = F.raise_error(F.concat(F.lit("given value differs from its expression: "), given.cast("string"))) if strict else F.lit(None)
    return F.when(given.isNull(), computed).when(given == computed, given).otherwise(wrong)


def infer_required(given: Column, computed: Column, strict: bool = True) -> Column:
    """The given value, which must equal the computed one; where it differs or is missing, an error, or null if not strict."""
    wrong = F.raise_error(F.concat(F.lit("required value differs from its expression: "), F.coalesce(given.cast("string"), F.lit("none")))) if strict else F.lit(None)
    return F.when(given.eqNullSafe(computed) & given.isNotNull(), given).otherwise(wrong)


def infer_conflict(given: Column, computed: Column) -> Column:
    """Whether a given value contradicts its expression; false where none is given."""
    return F.coalesce(given != computed, F.lit(False))


def fill_default(given: Column, default: str | None) -> Column:
    return given if default is None else F.coalesce(given, F.lit(default))
