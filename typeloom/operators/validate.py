"""Validation of DataFrames against a class of a catalog.

Every constraint of a class is one boolean Column that is true for invalid rows. A report counts them all
in one scan; a list of violations explodes them in one scan. The predicates are built-in functions only,
so they stay in generated code and run unchanged on streams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from typeloom.functions import names
from typeloom.plans.catalog import Attribute, Catalog
from typeloom.plans.model import BASES, Element

# How values are written.
LEXICAL = {
    "integer": r"^[+-]?[0-9]+$",
    "float": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "double": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "decimal": r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$",
    "boolean": r"^(true|false)$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "datetime": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "time": r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})?$",
    "uri": names.URI_PATTERN,
    "curie": names.CURIE_PATTERN,
    "uriorcurie": f"(?:{names.URI_PATTERN})|(?:{names.CURIE_PATTERN})",
    "ncname": names.NCNAME_PATTERN,
}
_CASTS = {kind: spark for kind, spark in BASES.values() if spark not in ("string",)}
#: Spark types that hold values of a kind without loss.
_HOLDS = {
    "string": ("string",),
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "boolean": ("boolean",),
    "float": ("float", "double", "decimal", "tinyint", "smallint", "int", "bigint"),
    "double": ("float", "double", "decimal", "tinyint", "smallint", "int", "bigint"),
    "decimal": ("decimal", "float", "double", "tinyint", "smallint", "int", "bigint"),
    "date": ("date",),
    "datetime": ("timestamp", "timestamp_ntz"),
}

_CODECS: dict[str, Callable[[Column], Column]] = {}


def register_codec(type_name: str, decode: Callable[[Column], Column] | None) -> None:
    """How texts of a schema type are decoded, null where they are none of it; None takes the codec away.

    Texts are then checked and typed by it in place of the type's own form.
    """
    if decode is None:
        _CODECS.pop(type_name, None)
    else:
        _CODECS[type_name] = decode


def codec(type_name: str) -> Callable[[Column], Column] | None:
    return _CODECS.get(type_name)


@dataclass
class Constraint:
    """One check: the slot's path, its kind, and the Column that is true where a row breaks it."""

    slot: str
    kind: str
    invalid: Column


def _value_checks(catalog: Catalog, attribute: Attribute, spark_type: str) -> list[tuple[str, Callable[[Column], Column]]]:
    """Checks of one value that is not null."""
    out: list[tuple[str, Callable[[Column], Column]]] = []
    kind = attribute
    while kind.kind == "reference":
        kind = kind.identifier
    if kind.kind == "enum":
        values = list(catalog.meanings(kind.range))
        out.append(("enum", lambda c: ~c.cast("string").isin(values)))
        return out
    if kind.kind != "type":
        return out
    runtime = catalog.runtime_type(kind.range)
    base = spark_type.split("(")[0]
    if kind.range.name in _CODECS and base == "string":
        decode = _CODECS[kind.range.name]
        out.append(("type", lambda c: decode(c).isNull()))
    elif runtime in LEXICAL and base == "string":
        lexical = LEXICAL[runtime]
        if runtime in _CASTS:
            out.append(("type", lambda c: ~c.rlike(lexical) | c.try_cast(_CASTS[runtime]).isNull()))
        else:
            out.append(("type", lambda c: ~c.rlike(lexical)))
    elif runtime in _HOLDS and base not in _HOLDS[runtime]:
        whole = runtime == "integer" and base in ("float", "double", "decimal")
        out.append(("type", (lambda c: c != F.floor(c)) if whole else (lambda c: F.lit(True))))
    low, high, pattern = (attribute.merged(m) for m in ("minimum_value", "maximum_value", "pattern"))
    if low is not None:
        out.append(("minimum", lambda c: F.coalesce(_ordered(c, base, low, lambda x, y: x < y), F.lit(False))))
    if high is not None:
        out.append(("maximum", lambda c: F.coalesce(_ordered(c, base, high, lambda x, y: x > y), F.lit(False))))
    if pattern is not None:
        out.append(("pattern", lambda c: ~c.cast("string").rlike(pattern)))
    return out


def _ordered(c: Column, base: str, bound: str, broken: Callable[[Column, Column], Column]) -> Column:
    """Whether a value breaks a bound: exactly, as decimals, unless either is written as a float."""
    exact = Decimal(bound)
    if base in ("float", "double") or abs(exact.adjusted()) > 18 or -exact.as_tuple().exponent > 18:
        return broken(c.cast("double"), F.lit(float(bound)))
    limit = F.lit(exact).cast("decimal(38,18)")
    if base == "string":  # what does not fit a decimal is compared as a double
        return F.coalesce(broken(c.try_cast("decimal(38,18)"), limit), broken(c.try_cast("double"), F.lit(float(bound))))
    return broken(c, F.lit(int(exact)) if exact == exact.to_integral_value() and base != "decimal" else F.lit(exact))


def _any_of(catalog: Catalog, attribute: Attribute, spark_type: str) -> Callable[[Column], Column] | None:
    """True where a value fits none of the slot's branches."""
    branches = []
    for branch in attribute.slot.get("any_of"):
        target = catalog.resolve(branch.get("range"), "class", "type", "enum")
        if target is None:
            return None
        own = catalog.attribute(Element(attribute.slot.name, "slot", attribute.slot.schema, {**branch, "range": target.name, "inlined": attribute.slot.get("inlined")}))
        branches.append([f for _, f in _value_checks(catalog, own, spark_type)])
    if not branches:
        return None

    def none_fits(c: Column) -> Column:
        bad = F.lit(True)
        for checks in branches:
            wrong = F.lit(False)
            for f in checks:
                wrong = wrong | f(c)
            bad = bad & wrong
        return bad

    return none_fits


#: A check of an object: slot path, kind, and from the object's members (by name) to the Column that is true where it is broken.
_Members = Callable[[str], Column]
_Check = tuple[str, str, Callable[[_Members], Column]]


def constraints(catalog: Catalog, cls: str, schema: T.StructType) -> list[Constraint]:
    """All constraints of a class over rows of a schema; nested objects are followed to the schema's end."""
    at = lambda name: F.col(f"`{name}`")
    return [Constraint(where, kind, invalid(at)) for where, kind, invalid in _object(catalog, catalog.classes[cls], schema, "")]


def _object(catalog: Catalog, cls: Element, schema: T.StructType, path: str, skip: str | None = None) -> Iterator[_Check]:
    fields = {f.name: f.dataType for f in schema.fields}
    for attribute in catalog.attributes(cls).values():
        name, slot = attribute.name, attribute.slot
        if slot.name == skip:
            continue
        where = path + name
        if name not in fields:
            if slot.get("required"):
                yield where, "required", lambda at: F.lit(True)
            continue
        if slot.get("required"):
            yield where, "required", lambda at, name=name: at(name).isNull()
        for inner, kind, invalid in _slot(catalog, attribute, fields[name], where):
            yield inner, kind, lambda at, name=name, invalid=invalid: invalid(at(name))


def _present(c: Column, check: Column) -> Column:
    """False, not null, where there is no value."""
    return F.coalesce(c.isNotNull() & check, F.lit(False))


def _sure(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The check of one item, false where it is unknown."""
    return lambda x: F.coalesce(check(x), F.lit(False))


def _any_item(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The check of a list: true where an item breaks ``check``."""
    return lambda col: _present(col, F.exists(col, _sure(check)))


def _slot(catalog: Catalog, attribute: Attribute, kind: T.DataType, where: str) -> Iterator[tuple[str, str, Callable[[Column], Column]]]:
    """Slot path, kind and check of a slot's values of one Spark type."""
    slot = attribute.slot
    given = lambda col: col.isNotNull()
    if isinstance(kind, T.ArrayType):
        if not slot.get("multivalued"):
            yield where, "at_most_one", lambda col: _present(col, F.size(col) > 1)
        if attribute.kind == "inline" and attribute.form and attribute.form.name not in ("list", "plain", "optional"):
            yield where, "form", given
        inner = kind.elementType
        if attribute.kind == "inline" and isinstance(inner, T.StructType):
            yield where, "null_item", _any_item(lambda x: x.isNull())
            for name, of, invalid in _object(catalog, attribute.range, inner, where + "."):
                yield name, of, _any_item(lambda x, invalid=invalid: x.isNotNull() & invalid(lambda n: x[n]))
        else:
            for name, check in _checks(catalog, attribute, inner.simpleString()):
                yield where, name, _any_item(check)
    elif isinstance(kind, T.MapType):
        form = attribute.form
        if attribute.kind != "inline" or form is None or form.key is None:
            yield where, "form", given
            return
        inner = catalog.attributes(attribute.range)
        for name, check in _checks(catalog, inner[form.key], kind.keyType.simpleString()):
            yield f"{where}.{inner[form.key].name}", name, lambda col, check=check: _any_item(check)(F.map_keys(col))
        if form.name == "simple_dict" and not isinstance(kind.valueType, T.StructType):
            value = inner[form.value]
            for name, of, invalid in _slot(catalog, value, kind.valueType, f"{where}.{value.name}"):
                yield name, of, lambda col, invalid=invalid: _any_item(invalid)(F.map_values(col))
        elif isinstance(kind.valueType, T.StructType):
            # an entry without a value has its key only
            for name, of, invalid in _object(catalog, attribute.range, kind.valueType, where + ".", form.key):
                yield name, of, lambda col, invalid=invalid: _any_item(lambda x: invalid(lambda n: x[n]))(F.map_values(col))
    elif attribute.kind == "inline" and isinstance(kind, T.StructType):
        if slot.get("multivalued"):
            yield where, "form", given
        else:
            for name, of, invalid in _object(catalog, attribute.range, kind, where + "."):
                yield name, of, lambda col, invalid=invalid: _present(col, invalid(lambda n: col[n]))
    elif attribute.kind == "inline":
        yield where, "form", given
    else:
        for name, check in _checks(catalog, attribute, kind.simpleString()):
            yield where, name, lambda col, check=check: _present(col, check(col))


def _checks(catalog: Catalog, attribute: Attribute, spark_type: str) -> list[tuple[str, Callable[[Column], Column]]]:
    union = _any_of(catalog, attribute, spark_type)
    return [("any_of", union)] if union is not None else _value_checks(catalog, attribute, spark_type)


def report(df: DataFrame, catalog: Catalog, cls: str) -> DataFrame:
    """slot, constraint, n_invalid: every constraint counted in one scan."""
    found = constraints(catalog, cls, df.schema)
    counts = df.agg(*[F.count_if(c.invalid).alias(f"_{i}") for i, c in enumerate(found)]) if found else df.limit(0).agg(F.lit(0).alias("_"))
    rows = F.array(*[F.struct(F.lit(c.slot).alias("slot"), F.lit(c.kind).alias("constraint"), F.col(f"_{i}").alias("n_invalid")) for i, c in enumerate(found)])
    if not found:
        return df.sparkSession.createDataFrame([], "slot string, constraint string, n_invalid long")
    return counts.select(F.inline(rows))


def violations(df: DataFrame, catalog: Catalog, cls: str, keys: Sequence[str]) -> DataFrame:
    """keys, slot, constraint: a row for each broken constraint of each row, in one scan."""
    found = constraints(catalog, cls, df.schema)
    broken = [F.when(c.invalid, F.struct(F.lit(c.slot).alias("slot"), F.lit(c.kind).alias("constraint"))) for c in found]
    listed = df.select(*keys, F.explode(F.array_compact(F.array(*broken))).alias("_v")) if broken else df.select(*keys, F.explode(F.array(F.struct(F.lit("").alias("slot"), F.lit("").alias("constraint")))).alias("_v")).limit(0)
    return listed.select(*keys, F.col("_v.slot").alias("slot"), F.col("_v.constraint").alias("constraint"))


def valid_rows(df: DataFrame, catalog: Catalog, cls: str) -> DataFrame:
    """The rows that break nothing."""
    bad = F.lit(False)
    for c in constraints(catalog, cls, df.schema):
        bad = bad | c.invalid
    return df.filter(~bad)


def cardinality(df: DataFrame, group: Sequence[str], least: int = 0, most: int | None = None, out: str = "n") -> DataFrame:
    """group and the number of its rows, for groups of fewer rows than ``least`` or more than ``most``."""
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias(out))
    wrong = F.col(out) < least
    return counted.filter(wrong if most is None else wrong | (F.col(out) > most))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_rows of the keys that more than one row holds; a key with a null is no key."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    return df.filter(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def key_duplicates(df: DataFrame, catalog: Catalog, cls: str) -> DataFrame:
    """duplicate_keys of the class's identifier or key slot."""
    key = catalog.key_slot(catalog.classes[cls])
    if key is None:
        raise ValueError(f"class {cls} has no key")
    return duplicate_keys(df, [catalog.alias(key)])


def orphans(child: DataFrame, reference: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose reference is not null and names no parent."""
    keys = parent.select(F.col(key).alias("_key")).distinct()
    return child.filter(F.col(reference).isNotNull()).join(keys, F.col(reference) == F.col("_key"), "left_anti")


def reference_report(tables: dict[str, DataFrame], catalog: Catalog) -> DataFrame:
    """class, slot, n_orphans for each class reference between the given tables (by class name)."""
    out = None
    for cls, df in tables.items():
        for attribute in catalog.attributes(catalog.classes[cls]).values():
            if attribute.kind == "reference" and attribute.range.name in tables and attribute.name in df.columns:
                child = df.select(F.explode(attribute.name).alias(attribute.name)) if isinstance(df.schema[attribute.name].dataType, T.ArrayType) else df.select(attribute.name)
                lost = orphans(child, attribute.name, tables[attribute.range.name], attribute.identifier.name)
                row = lost.agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(cls).alias("class"), F.lit(attribute.name).alias("slot"), "n_orphans")
                out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no references between these tables")
    return out


def outside_values(df: DataFrame, column: str, values: DataFrame, value: str) -> DataFrame:
    """Rows whose value is not null and not in a table of values, for enumerations too long for a list."""
    known = values.select(F.col(value).alias("_known")).distinct()
    return df.filter(F.col(column).isNotNull()).join(known, F.col(column) == F.col("_known"), "left_anti")


# -- JSON documents


_JSON_TYPES = {
    "string": "^STRING$",
    "boolean": "^BOOLEAN$",
    "integer": r"^(BIGINT|DECIMAL\([0-9]+,0\))$",
    "float": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "double": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
    "decimal": r"^(BIGINT|DECIMAL.*|DOUBLE|FLOAT)$",
}


def json_checks(catalog: Catalog, attribute: Attribute, v: Column | None, key: Column | None = None) -> list[tuple[str, Column]]:
    """Kind and Column, true or null where broken, of the checks of a variant that is no inline object; of a dictionary's key, which is a text."""
    if v is None:
        return [(name, F.coalesce(check(key), F.lit(False))) for name, check in _value_checks(catalog, attribute, "string")]
    shape, text = F.schema_of_variant(v), F.try_variant_get(v, "$", "string")
    kind = attribute.identifier if attribute.kind == "reference" else attribute
    if kind.kind == "enum":
        return [("enum", (shape != "STRING") | ~F.coalesce(text.isin(list(catalog.meanings(kind.range))), F.lit(False)))]
    runtime = catalog.runtime_type(kind.range)
    wrong = ~shape.rlike(_JSON_TYPES.get(runtime, "^STRING$")) if runtime != "any" else F.lit(False)
    if runtime == "integer":
        number = F.try_variant_get(v, "$", "double")
        wrong = wrong & ~(shape.rlike("^(DECIMAL.*|DOUBLE)$") & F.coalesce(number == F.floor(number), F.lit(False)))
    if runtime in LEXICAL and runtime not in _JSON_TYPES:
        wrong = wrong | ~F.coalesce(text.rlike(LEXICAL[runtime]), F.lit(False))
    typed = "string" if runtime not in ("integer", "float", "double", "decimal") else "double"
    value = F.try_variant_get(v, "$", typed)
    bounds = [(name, ~F.coalesce(wrong, F.lit(True)) & F.coalesce(check(value), F.lit(False))) for name, check in _value_checks(catalog, attribute, typed) if name in ("minimum", "maximum", "pattern")]
    return [("type", wrong), *bounds]


def json_branches(catalog: Catalog, attribute: Attribute) -> list[Attribute]:
    """The branches of a slot's any_of, as attributes that are inlined as the slot is."""
    slot = attribute.slot
    return [catalog.attribute(Element(slot.name, "slot", slot.schema, {"inlined": slot.get("inlined"), **b})) for b in slot.get("any_of") if b.get("range")]


def _json_value(catalog: Catalog, attribute: Attribute, v: Column, closed: bool, above: tuple[str, ...]) -> Column:
    """True where a variant value does not fit the attribute's range; ``above`` are the classes around it."""
    if attribute.kind == "any":
        return F.lit(False)
    if attribute.kind == "inline":
        return ~F.schema_of_variant(v).startswith("OBJECT") | _json_object(catalog, attribute.range, v, closed, above)
    wrong = F.lit(False)
    for _, broken in json_checks(catalog, attribute, v):
        wrong = wrong | broken
    return wrong


def _json_slot(catalog: Catalog, attribute: Attribute, v: Column, closed: bool, above: tuple[str, ...]) -> Column:
    """True where a slot's variant, which is not null, is wrong."""
    shape = F.schema_of_variant(v)
    branches = json_branches(catalog, attribute)

    def one(x: Column) -> Column:
        if not branches:
            return _json_value(catalog, attribute, x, closed, above)
        bad = F.lit(True)
        for b in branches:
            bad = bad & _json_value(catalog, b, x, closed, above)
        return bad

    if not attribute.slot.get("multivalued"):
        return one(v)
    form = attribute.form
    if form is not None and form.key is not None:
        entries = F.try_variant_get(v, "$", "map<string,variant>")
        inner = catalog.attributes(attribute.range)

        def wrong_key(k: Column) -> Column:
            wrong = F.lit(False)
            for _, check in _value_checks(catalog, inner[form.key], "string"):
                wrong = wrong | F.coalesce(check(k), F.lit(False))
            return wrong

        def wrong_entry(x: Column) -> Column:
            is_object = F.schema_of_variant(x).startswith("OBJECT")
            whole = is_object & ~_json_object(catalog, attribute.range, x, closed, above, form.key)
            if form.name == "simple_dict":
                return ~whole & _json_slot(catalog, inner[form.value], x, closed, (*above, attribute.range.name))
            # a null has the key only
            needs = any(a.slot.get("required") for a in inner.values() if a.slot.name != form.key)
            return ~whole & (F.lit(needs) | ~F.is_variant_null(x))

        bad = F.exists(F.map_values(entries), lambda x: F.coalesce(wrong_entry(x), F.lit(True))) | F.exists(F.map_keys(entries), wrong_key)
        return ~shape.startswith("OBJECT") | F.coalesce(bad, F.lit(True))
    items = F.try_variant_get(v, "$", "array<variant>")
    return ~shape.startswith("ARRAY") | F.coalesce(F.exists(items, lambda x: F.coalesce(one(x), F.lit(True)) | F.is_variant_null(x)), F.lit(False))


def _json_object(catalog: Catalog, cls: Element, v: Column, closed: bool, above: tuple[str, ...], key: str | None = None) -> Column:
    """True where a variant object is no instance of a class; the slot ``key`` may be absent, as a dictionary's key has it."""
    if cls.name in above:
        raise ValueError(f"class {cls.name} contains itself ({' > '.join((*above, cls.name))}): use recursive.json_faults")
    bad = F.lit(False)
    attributes = catalog.attributes(cls).values()
    for attribute in attributes:
        bad = bad | _json_attribute(catalog, attribute, v, closed, (*above, cls.name), attribute.slot.name == key)
    if closed:
        known = F.array(*[F.lit(a.name) for a in attributes]) if attributes else F.array().cast("array<string>")
        members = F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))
        bad = bad | F.coalesce(F.size(F.array_except(members, known)) > 0, F.lit(False))
    return bad


def _json_attribute(catalog: Catalog, attribute: Attribute, v: Column, closed: bool, above: tuple[str, ...], is_key: bool = False) -> Column:
    value = F.try_variant_get(v, f"$['{attribute.name}']", "variant")
    absent = value.isNull() | F.is_variant_null(value)
    return F.when(absent, F.lit(bool(attribute.slot.get("required")) and not is_key)).otherwise(F.coalesce(_json_slot(catalog, attribute, value, closed, above), F.lit(False)))


def json_valid(json: Column, catalog: Catalog, cls: str, closed: bool = True) -> Column:
    """Whether a JSON text is an instance of a class: its types are strict, unknown members only pass if not closed.

    Objects at every level are checked so; a class that contains itself raises a ValueError, and is for
    ``recursive.json_faults``.
    """
    v = F.try_parse_json(json)
    bad = _json_object(catalog, catalog.classes[cls], v, closed, ())
    return F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).otherwise(~bad)


def json_type(json: Column, path: str) -> Column:
    """The JSON type of a member: string, integer, number, boolean, array, object, null; null where absent."""
    value = F.try_variant_get(F.try_parse_json(json), path, "variant")
    shape = F.schema_of_variant(value)
    return (
        F.when(shape == "STRING", "string")
        .when(shape == "BIGINT", "integer")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape.startswith("ARRAY"), "array")
        .when(shape.startswith("OBJECT"), "object")
        .when(shape == "VOID", "null")
        .when(shape.isNotNull(), "number")
    )


def extra_members(json: Column, declared: Sequence[str]) -> Column:
    """Members of a JSON object that a closed class does not declare, in order."""
    return F.array_except(F.json_object_keys(json), F.array(*map(F.lit, declared)))


# -- collection forms


def to_dict(df: DataFrame, group: Sequence[str], key: str, values: Sequence[str], out: str, simple: bool = False) -> DataFrame:
    """Rows gathered into one dict a group: key to value (simple) or key to an object of values; the last row by value wins a repeated key."""
    value = F.col(values[0]) if simple else F.struct(*values)
    best = df.groupBy(*group, key).agg(F.max(value).alias("_value"))
    return best.groupBy(*group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col("_value").alias("value"))))).alias(out))


def from_dict(df: DataFrame, column: str, key: str, value: str) -> DataFrame:
    """A row for each entry of a dict column."""
    others = [c for c in df.columns if c != column]
    return df.select(*others, F.explode(column).alias(key, value))


def to_list(df: DataFrame, group: Sequence[str], values: Sequence[str], out: str) -> DataFrame:
    """Rows gathered into one sorted list of objects a group."""
    return df.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*values))).alias(out))


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "ord") -> DataFrame:
    """Rows of each group numbered from 0 in order."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1)
