"""Queries of the library's operators over the benchmark tables, each with its SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.functions import expressions, names
from typeloom.operators import frames, paths, rdf, reach, recursive, relational, render, shapes, validate
from typeloom.session import scratch_path, staged
from typeloom.sources import instances, turtle
from typeloom.streaming import validate as streaming
from typeloom.tables import tables_catalog

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of one small file dealt over the cores, for texts made of them that cost far more than the rows."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism)


def _report_sql(source: str, checks: list[tuple[str, str, str]]) -> str:
    """slot, constraint, n_invalid for (slot, constraint, predicate)."""
    return " UNION ALL ".join(f"SELECT '{s}' AS slot, '{c}' AS \"constraint\", count(*) FILTER (WHERE coalesce({p}, false)) AS n_invalid FROM {source}" for s, c, p in checks)


_LINE_CHECKS = [
    ("l_orderkey", "required", "l_orderkey IS NULL"),
    ("l_quantity", "minimum", "l_quantity < 2"),
    ("l_quantity", "maximum", "l_quantity > 49"),
    ("l_discount", "minimum", "l_discount < 0"),
    ("l_discount", "maximum", "l_discount > 0.09"),
    ("l_tax", "minimum", "l_tax < 0"),
    ("l_tax", "maximum", "l_tax > 0.07"),
    ("l_returnflag", "required", "l_returnflag IS NULL"),
    ("l_returnflag", "enum", "l_returnflag NOT IN ('R', 'A', 'N')"),
    ("l_linestatus", "enum", "l_linestatus NOT IN ('O', 'F')"),
]
# nulls are derived, as the tables hold none
_LINES = "(SELECT * REPLACE (nullif(l_returnflag, 'N') AS l_returnflag, CASE WHEN l_linestatus = 'F' AND l_quantity > 40 THEN 'X' ELSE l_linestatus END AS l_linestatus) FROM lineitem)"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").withColumns(
        {
            "l_returnflag": F.nullif("l_returnflag", F.lit("N")),
            "l_linestatus": F.when((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 40), "X").otherwise(F.col("l_linestatus")),
        }
    )


@query(_report_sql(_LINES, _LINE_CHECKS))
def lineitem_report(spark, sf_dir):
    """Every constraint of a class counted in one scan."""
    return validate.report(_lines(spark, sf_dir), tables_catalog(), "LineItem")


@query(" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{s}' AS slot, '{c}' AS \"constraint\" FROM {_LINES} WHERE coalesce({p}, false)" for s, c, p in _LINE_CHECKS))
def violations_long(spark, sf_dir):
    """A row for each violation, in one scan."""
    return validate.violations(_lines(spark, sf_dir), tables_catalog(), "LineItem", ["l_orderkey", "l_linenumber"])


@query(f"SELECT l_linestatus, count(*) AS n FROM {_LINES} WHERE NOT ({' OR '.join(f'coalesce({p}, false)' for _, _, p in _LINE_CHECKS)}) GROUP BY 1")
def valid_lines(spark, sf_dir):
    """Rows that break nothing."""
    return validate.valid_rows(_lines(spark, sf_dir), tables_catalog(), "LineItem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query(_report_sql("customer", [("c_custkey", "required", "c_custkey IS NULL"), ("c_name", "required", "c_name IS NULL"), ("c_name", "pattern", "NOT regexp_matches(c_name, '^Customer#[0-9]{9}$')"), ("c_acctbal", "minimum", "c_acctbal < 0"), ("c_mktsegment", "enum", "c_mktsegment NOT IN ('MACHINERY', 'FURNITURE', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD')")]))
def customer_report(spark, sf_dir):
    """D1, D4, D5, D6."""
    return validate.report(_table(spark, sf_dir, "customer"), tables_catalog(), "Customer")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < 0")
def range_min_violations(spark, sf_dir):
    """Rows under a minimum."""
    df = _table(spark, sf_dir, "customer")
    found = next(c for c in validate.constraints(tables_catalog(), "Customer", df.schema) if c.kind == "minimum")
    return df.filter(found.invalid).select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_brand FROM part WHERE NOT regexp_matches(p_brand, '^Brand#[0-9]$')")
def pattern_violations(spark, sf_dir):
    """Rows that miss a pattern."""
    df = _table(spark, sf_dir, "part")
    found = next(c for c in validate.constraints(tables_catalog(), "Part", df.schema) if c.kind == "pattern")
    return df.filter(found.invalid).select("p_partkey", "p_brand")


@query("SELECT page_id, url FROM pages WHERE NOT regexp_matches(url, '^https?://[^#]*$')")
def url_format_violations(spark, sf_dir):
    """URLs with a fragment."""
    df = _table(spark, sf_dir, "pages")
    found = next(c for c in validate.constraints(tables_catalog(), "Page", df.schema) if c.kind == "pattern")
    return df.filter(found.invalid).select("page_id", "url")


@query("SELECT page_id, page_id % 6 IN (0, 3, 5) AS is_uri, page_id % 6 IN (3, 5) AS is_curie FROM pages")
def uri_validity(spark, sf_dir):
    """The lexical checks of URIs and CURIEs, over URLs left as they are or spoilt in several ways."""
    url, k = F.col("url"), F.col("page_id")
    spoilt = [url, F.replace(url, F.lit("://"), F.lit(" ")), F.concat(F.lit("<"), url, F.lit(">")), F.concat(F.lit("ex:a"), k), F.concat(F.lit("no colon "), k), F.concat(F.lit("urn:x"), k)]
    text = F.element_at(F.array(*spoilt), (k % 6 + 1).cast("int"))
    return _table(spark, sf_dir, "pages").select("page_id", text.rlike(names.URI_PATTERN).alias("is_uri"), text.rlike(names.CURIE_PATTERN).alias("is_curie"))


@query("SELECT role, count(*) AS n FROM conversations WHERE role NOT IN ('user', 'assistant') GROUP BY role")
def enum_violations(spark, sf_dir):
    """Values outside an enumeration."""
    df = _table(spark, sf_dir, "conversations")
    found = next(c for c in validate.constraints(tables_catalog(), "Turn", df.schema) if c.kind == "enum")
    return df.filter(found.invalid).groupBy("role").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'fr')")
def enum_anti_join(spark, sf_dir):
    """The same by an anti join with a table of values."""
    enum = tables_catalog().enums["MainLang"]
    values = spark.createDataFrame(list(tables_catalog().meanings(enum).items()), "text string, meaning string")
    return validate.outside_values(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", values, "text")


@query("SELECT l_linestatus AS status, CASE l_linestatus WHEN 'O' THEN 'https://example.org/item/open' WHEN 'F' THEN 'https://example.org/item/filled' END AS meaning, count(*) AS n FROM lineitem GROUP BY ALL")
def enum_meaning_projection(spark, sf_dir):
    """Values with their meanings."""
    meanings = tables_catalog().meanings(tables_catalog().enums["LineStatus"])
    known = spark.createDataFrame(list(meanings.items()), "status string, meaning string")
    counted = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_linestatus").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(known, "status", "left").select("status", "meaning", "n")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def key_duplicates(spark, sf_dir):
    """Keys held by several rows."""
    return validate.duplicate_keys(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderkey AS o_orderkey, count(*) AS n_rows FROM (SELECT o_orderkey FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_custkey % 10 = 3 UNION ALL SELECT NULL FROM orders) WHERE o_orderkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def identifier_duplicates(spark, sf_dir):
    """The class's own identifier, over orders of which some come twice and some have lost it."""
    orders = _table(spark, sf_dir, "orders")
    again = orders.filter("o_custkey % 10 = 3")
    return validate.key_duplicates(orders.unionByName(again).unionByName(orders.withColumn("o_orderkey", F.lit(None).cast("long"))), tables_catalog(), "Order")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def fk_orphans(spark, sf_dir):
    """References to no row of the parent."""
    parents = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return validate.orphans(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey")


@query(
    "SELECT 'Customer' AS class, 'c_nationkey' AS slot, count(*) FILTER (WHERE n_nationkey IS NULL) AS n_orphans FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey = n_nationkey "
    "UNION ALL SELECT 'Order', 'o_custkey', count(*) FILTER (WHERE c_custkey IS NULL) FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
)
def reference_report(spark, sf_dir):
    """Every class reference between tables."""
    tables = {"Customer": _table(spark, sf_dir, "customer"), "Nation": _table(spark, sf_dir, "nation").filter("n_nationkey < 20"), "Order": _table(spark, sf_dir, "orders")}
    return validate.reference_report(tables, tables_catalog())


@query("SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1 HAVING count(*) > 7")
def cardinality_groups(spark, sf_dir):
    """Orders with more lines than allowed."""
    return validate.cardinality(_table(spark, sf_dir, "lineitem"), ["l_orderkey"], most=7, out="n_lines")


@query("SELECT count(*) AS n_invalid FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey), (SELECT l_orderkey, count(*) c FROM lineitem GROUP BY 1) WHERE o_orderkey = l_orderkey AND c > 1")
def at_most_one(spark, sf_dir):
    """A list where the slot allows one value."""
    lists = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("l_linenumber"))
    found = next(c for c in validate.constraints(tables_catalog(), "LineItem", lists.schema) if c.kind == "at_most_one")
    return lists.agg(F.count_if(found.invalid).alias("n_invalid"))


@query("SELECT p_type, count(*) FILTER (WHERE NOT (p_type IN ('PROMO', 'SMALL') OR regexp_matches(p_type, '^E'))) AS n_invalid FROM part GROUP BY p_type")
def any_of_branches(spark, sf_dir):
    """A value must fit one of several ranges."""
    catalog = _union_catalog()
    df = _table(spark, sf_dir, "part").select("p_type")
    found = next(c for c in validate.constraints(catalog, "U", df.schema) if c.kind == "any_of")
    return df.groupBy("p_type").agg(F.count_if(found.invalid).alias("n_invalid"))


def _union_catalog():
    from typeloom.operators.lint import loaded

    return loaded(
        text='{"id": "https://example.org/u", "name": "u", "imports": ["linkml:types"], "default_range": "string", "types": {"e": {"typeof": "string", "base": "str", "pattern": "^E"}},'
        ' "enums": {"Two": {"permissible_values": {"PROMO": {}, "SMALL": {}}}}, "classes": {"U": {"attributes": {"p_type": {"range": "string", "any_of": [{"range": "Two"}, {"range": "e"}]}}}}}'
    )


@query("SELECT r_name AS region, n_name AS nation, n_nationkey AS nationkey FROM nation JOIN region ON n_regionkey = r_regionkey")
def compact_dict(spark, sf_dir):
    """Rows to a dict a region and back."""
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dicts = validate.to_dict(nations, ["r_name"], "n_name", ["n_nationkey", "n_regionkey"], "nations")
    return validate.from_dict(dicts, "nations", "nation", "rest").select(F.col("r_name").alias("region"), "nation", F.col("rest.n_nationkey").alias("nationkey"))


@query("SELECT r_name AS region, count(*) AS n, min(n_name) AS first, max(n_nationkey) AS top FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def simple_dict(spark, sf_dir):
    """Key to value."""
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    dicts = validate.to_dict(nations, ["r_name"], "n_name", ["n_nationkey"], "nations", simple=True)
    keys, values = F.map_keys("nations"), F.map_values("nations")
    return dicts.select(F.col("r_name").alias("region"), F.size(keys).cast("long").alias("n"), F.array_min(keys).alias("first"), F.array_max(values).alias("top"))


@query("SELECT r_name AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def list_form(spark, sf_dir):
    """Rows to a sorted list a region."""
    nations = _table(spark, sf_dir, "nation").join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = validate.to_list(nations, ["r_name"], ["n_name"], "nations")
    return lists.select(F.col("r_name").alias("region"), F.array_join(F.col("nations.n_name"), ",").alias("nations"))


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)")
def dict_explode(spark, sf_dir):
    """Members of a JSON object as rows."""
    events = _table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("props"))
    return validate.from_dict(events, "props", "key", "value")


@query("SELECT CASE json_type(props, '$.k') WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'VARCHAR' THEN 'string' WHEN 'DOUBLE' THEN 'number' END AS json_type, count(*) AS n FROM events GROUP BY 1")
def variant_type_report(spark, sf_dir):
    """D3: strict types of JSON members."""
    return _table(spark, sf_dir, "events").groupBy(validate.json_type(F.col("props"), "$.k").alias("json_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, list_filter(json_keys(props), lambda x: x NOT IN ('other'))[1] AS extra FROM events WHERE len(list_filter(json_keys(props), lambda x: x NOT IN ('other'))) > 0")
def closed_record_extra(spark, sf_dir):
    """Members that a closed class does not declare."""
    extra = validate.extra_members(F.col("props"), ["other"])
    return _table(spark, sf_dir, "events").filter(F.size(extra) > 0).select("event_id", F.element_at(extra, 1).alias("extra"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) < 50 AS valid, count(*) AS n FROM events GROUP BY 1")
def json_instances(spark, sf_dir):
    """JSON texts as instances of a closed class."""
    from typeloom.operators.lint import loaded

    catalog = loaded(text='{"id": "https://example.org/p", "name": "p", "imports": ["linkml:types"], "classes": {"Props": {"attributes": {"k": {"range": "integer", "required": true, "maximum_value": 49}}}}}')
    return _table(spark, sf_dir, "events").groupBy(validate.json_valid(F.col("props"), catalog, "Props", closed=False).alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, c_name || ' (' || c_mktsegment || ') {' || c_custkey || '}' AS label FROM customer")
def interpolate_label(spark, sf_dir):
    """string interpolation."""
    df = _table(spark, sf_dir, "customer")
    return df.select("c_custkey", expressions.interpolate(df, "{c_name} ({c_mktsegment}) {{{c_custkey}}}").alias("label"))


@query("SELECT doc_id, length(text) AS n_chars, CASE WHEN doc_id % 3 = 0 THEN false ELSE doc_id % 3 = 1 END AS conflict FROM documents")
def infer_check(spark, sf_dir):
    """A missing value is computed, a different one is a conflict."""
    given = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    computed = F.length("text").cast("long")
    conflict = expressions.infer_conflict(given, computed)
    return _table(spark, sf_dir, "documents").select("doc_id", expressions.infer_optional(F.when(~conflict, given), computed).alias("n_chars"), conflict.alias("conflict"))


@query("SELECT coalesce(nullif(event_type, 'click'), 'view') AS event_type, count(*) AS n FROM events GROUP BY 1")
def default_fill(spark, sf_dir):
    """the default of an enumeration."""
    catalog = tables_catalog()
    default = catalog.default_value(catalog.attributes(catalog.classes["Event"])["event_type"])
    filled = expressions.fill_default(F.nullif("event_type", F.lit("click")), default)
    return _table(spark, sf_dir, "events").groupBy(filled.alias("event_type")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, lower(regexp_replace(p_name, '[ _-]+', '_', 'g')) AS snake FROM (SELECT p_partkey, regexp_replace(p_name, '[ _-]+([^A-Za-z]|$)', '\\1', 'g') AS p_name FROM part)")
def case_snake(spark, sf_dir):
    """F1, F2."""
    return _table(spark, sf_dir, "part").select("p_partkey", names.snake_case_col(F.col("p_name")).alias("snake"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Http' || upper(p_type[1]) || lower(p_type[2:]) || p_partkey WHEN 1 THEN p_type[1] || lower(p_type[2:]) WHEN 2 THEN upper(p_name[1]) || string_split(p_name, ' ')[1][2:] || upper(string_split(p_name, ' ')[2][1]) || string_split(p_name, ' ')[2][2:] ELSE 'AField' || p_size END AS pascal, lower(pascal[1]) || pascal[2:] AS camel FROM part")
def case_pascal(spark, sf_dir):
    """names of several words, of one, and with acronyms."""
    k, kind = F.col("p_partkey"), F.concat(F.substring("p_type", 1, 1), F.lower(F.expr("substring(p_type, 2)")))
    name = F.when(k % 4 == 0, F.concat(F.lit("HTTP"), kind, k)).when(k % 4 == 1, F.col("p_type")).when(k % 4 == 2, F.col("p_name")).otherwise(F.concat(F.lit("aField"), "p_size"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.pascal_case_col(name).alias("pascal"), names.camel_case_col(name).alias("camel"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'xml_' || lower(p_type) || p_size WHEN 1 THEN 'my_' || lower(p_brand[1:5]) || '_name' ELSE lower(p_type) || p_size END AS snake FROM part")
def case_snake_bounds(spark, sf_dir):
    """case boundaries, acronyms, and a separator before a digit, which goes."""
    k, kind = F.col("p_partkey"), F.concat(F.substring("p_type", 1, 1), F.lower(F.expr("substring(p_type, 2)")))
    name = F.when(k % 3 == 0, F.concat(F.lit("XML"), kind, F.lit("_"), "p_size")).when(k % 3 == 1, F.concat(F.lit("my"), F.substring("p_brand", 1, 5), F.lit("Name"))).otherwise(F.concat(kind, F.lit(" -"), "p_size"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.snake_case_col(name).alias("snake"))


@query("SELECT p_partkey, 'https://example.org/item/' || p_partkey AS uri FROM part")
def curie_expand(spark, sf_dir):
    """CURIEs by the prefixes of a schema."""
    catalog = tables_catalog()
    curie = F.concat(F.lit("ex:"), F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.expand_col(curie, catalog.prefixes(catalog.root)).alias("uri"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ex:' || p_partkey END AS curie FROM part")
def uri_compact(spark, sf_dir):
    """URIs back to CURIEs; an unknown base gives none."""
    catalog = tables_catalog()
    uri = F.concat(F.when(F.col("p_partkey") % 2 == 0, "https://example.org/item/").otherwise("https://nowhere.example/"), F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select("p_partkey", names.compact_col(uri, catalog.prefixes(catalog.root)).alias("curie"))


@query("SELECT n_nationkey, 'https://example.org/tables/' || replace(n_name, ' ', '+') AS uri FROM nation")
def synthetic_uri(spark, sf_dir):
    """P13, F4."""
    catalog = tables_catalog()
    return _table(spark, sf_dir, "nation").select("n_nationkey", names.synthetic_uri_col(F.lit(catalog.default_namespace(catalog.root)), F.col("n_name")).alias("uri"))


_RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


@query(
    f"SELECT '<https://example.org/tables/nation/' || n_nationkey || '> <{_RDF_TYPE}> <https://example.org/tables/Nation> .' AS value FROM nation "
    "UNION ALL SELECT '<https://example.org/tables/nation/' || n_nationkey || '> <https://example.org/tables/n_name> \"' || n_name || '\" .' FROM nation "
    "UNION ALL SELECT '<https://example.org/tables/nation/' || n_nationkey || '> <https://example.org/tables/n_regionkey> <https://example.org/tables/region/' || n_regionkey || '> .' FROM nation"
)
def nt_triples(spark, sf_dir):
    """Rows as N-Triples lines."""
    return rdf.ntriples_lines(rdf.instances(_table(spark, sf_dir, "nation"), tables_catalog(), "Nation"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord FROM events")
def shape_order(spark, sf_dir):
    """Ordinals within a group."""
    return validate.numbered(_table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], ["event_id"]).withColumn("ord", F.col("ord").cast("long"))


# -- objects within objects

_NESTED = """{"id": "https://example.org/nested", "name": "nested", "imports": ["linkml:types"], "default_range": "string", "default_prefix": "n", "prefixes": {"n": "https://example.org/n/", "ex": "https://example.org/item/"},
 "enums": {"Flag": {"permissible_values": {"R": {"meaning": "ex:returned"}, "A": {}, "N": {}}}},
 "classes": {
  "Line": {"attributes": {"number": {"range": "integer"}, "quantity": {"range": "double", "maximum_value": 49}, "flag": {"range": "Flag", "required": true}}},
  "Ord": {"attributes": {"okey": {"range": "integer", "identifier": true}, "lines": {"range": "Line", "multivalued": true, "inlined_as_list": true}}},
  "Cust": {"attributes": {"ckey": {"range": "integer", "identifier": true}, "orders": {"range": "Ord", "multivalued": true, "inlined": true, "inlined_as_list": true}}}}}"""


def _nested_catalog():
    from typeloom.operators.lint import loaded

    return loaded(text=_NESTED)


def _nested(spark, sf_dir) -> DataFrame:
    """Customers with their orders with their lines, some of which have no flag or one that there is not."""
    flag = F.when(F.col("l_partkey") % 90 == 2, "X").when(F.col("l_partkey") % 90 != 1, F.col("l_returnflag"))
    lines = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_linenumber").cast("long").alias("number"), F.col("l_quantity").alias("quantity"), flag.alias("flag"))).alias("lines"))
    orders = _table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return orders.groupBy(F.col("o_custkey").alias("ckey")).agg(F.collect_list(F.struct(F.col("o_orderkey").alias("okey"), "lines")).alias("orders"))


_OF = "(SELECT o_custkey AS ckey, o_orderkey AS okey, l_linenumber, l_quantity AS quantity, CASE WHEN l_partkey % 90 = 2 THEN 'X' WHEN l_partkey % 90 <> 1 THEN l_returnflag END AS flag FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey)"


@query(
    "WITH n AS (SELECT ckey, coalesce(bool_or(quantity > 49), false) AS q, coalesce(bool_or(l_linenumber IS NOT NULL AND flag IS NULL), false) AS r, coalesce(bool_or(flag NOT IN ('R', 'A', 'N')), false) AS e FROM " + _OF + " GROUP BY ckey) "
    + " UNION ALL ".join(f"SELECT '{w}' AS slot, '{k}' AS \"constraint\", count(*) FILTER (WHERE {p}) AS n_invalid FROM n" for w, k, p in [("ckey", "required", "false"), ("orders", "null_item", "false"), ("orders.okey", "required", "false"), ("orders.lines", "null_item", "false"), ("orders.lines.quantity", "maximum", "q"), ("orders.lines.flag", "required", "r"), ("orders.lines.flag", "enum", "e")])
)
def nested_report(spark, sf_dir):
    """Constraints of objects in lists of objects in lists, counted by the rows that break them."""
    return validate.report(_nested(spark, sf_dir), _nested_catalog(), "Cust")


@query(f"SELECT valid, count(*) AS n FROM (SELECT ckey, NOT coalesce(bool_or(quantity > 49 OR (l_linenumber IS NOT NULL AND flag IS NULL) OR flag NOT IN ('R', 'A', 'N') OR okey % 50 = 7), false) AS valid FROM {_OF} GROUP BY ckey) GROUP BY valid")
def nested_json(spark, sf_dir):
    """The same as JSON texts, some with a member that no class has."""
    extra = F.transform("orders", lambda o: F.struct(o["okey"].alias("okey"), o["lines"].alias("lines"), F.when(o["okey"] % 50 == 7, "x").alias("odd")))
    text = F.to_json(F.struct("ckey", extra.alias("orders")))
    return _nested(spark, sf_dir).groupBy(validate.json_valid(text, _nested_catalog(), "Cust").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"WITH o AS {_OF}, t AS (SELECT 'type' AS p, 'Cust' AS what, count(DISTINCT ckey) AS n FROM o UNION ALL SELECT 'type', 'Ord', count(DISTINCT okey) FROM o UNION ALL SELECT 'type', 'Line', count(l_linenumber) FROM o "
    "UNION ALL SELECT 'orders', 'iri', count(DISTINCT okey) FROM o UNION ALL SELECT 'lines', 'blank', count(l_linenumber) FROM o UNION ALL SELECT 'number', 'integer', count(l_linenumber) FROM o UNION ALL SELECT 'quantity', 'double', count(quantity) FROM o "
    "UNION ALL SELECT 'flag', CASE flag WHEN 'R' THEN 'https://example.org/item/returned' WHEN 'X' THEN 'literal X' ELSE 'https://example.org/n/' || flag END, count(*) FROM o WHERE flag IS NOT NULL GROUP BY 2) SELECT p, what, n FROM t"
)
def inline_triples(spark, sf_dir):
    """Inline objects as nodes of their own, named or blank, with all their values."""
    found = rdf.instances(_nested(spark, sf_dir), _nested_catalog(), "Cust")
    # counted by what few texts there are, of which the names are made then
    local = lambda c: F.regexp_extract(c, "[^/#]+$", 0)
    few = F.when((F.col("p") == rdf.RDF + "type") | F.col("p").endswith("/flag"), F.col("o"))
    found = found.groupBy("p", few.alias("o"), "o_kind", "o_datatype").agg(F.count(F.lit(1)).alias("n"))
    p = local(F.col("p"))
    what = F.when(p == "type", local(F.col("o"))).when(p == "flag", F.when(F.col("o_kind") == "iri", F.col("o")).otherwise(F.concat(F.lit("literal "), "o")))
    what = what.when(F.col("o_kind") == "literal", local(F.col("o_datatype"))).otherwise(F.col("o_kind"))
    return found.groupBy(p.alias("p"), what.alias("what")).agg(F.sum("n").alias("n"))


_LINE_TRIPLES = f"""WITH o AS {_OF}, l AS (SELECT *, 'https://example.org/n/ord/' || okey AS ord, '_:' || okey || '|' || l_linenumber AS node FROM o WHERE l_linenumber IS NOT NULL),
k AS (SELECT DISTINCT ckey, okey, 'https://example.org/n/cust/' || ckey AS cust, 'https://example.org/n/ord/' || okey AS ord FROM o), x(integer, double) AS (SELECT 'http://www.w3.org/2001/XMLSchema#integer', 'http://www.w3.org/2001/XMLSchema#double')
SELECT DISTINCT cust AS s, 'type' AS p, 'https://example.org/n/Cust' AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS o_datatype FROM k
UNION ALL SELECT cust, 'orders', ord, 'iri', NULL FROM k UNION ALL SELECT ord, 'type', 'https://example.org/n/Ord', 'iri', NULL FROM k
UNION ALL SELECT ord, 'lines', node, 'blank', NULL FROM l UNION ALL SELECT node, 'type', 'https://example.org/n/Line', 'iri', NULL FROM l
UNION ALL SELECT node, 'number', CAST(l_linenumber AS VARCHAR), 'literal', integer FROM l, x UNION ALL SELECT node, 'quantity', CAST(quantity AS VARCHAR), 'literal', double FROM l, x WHERE quantity IS NOT NULL
UNION ALL SELECT node, 'flag', CASE flag WHEN 'R' THEN 'https://example.org/item/returned' WHEN 'X' THEN 'X' ELSE 'https://example.org/n/' || flag END, CASE flag WHEN 'X' THEN 'literal' ELSE 'iri' END, NULL FROM l WHERE flag IS NOT NULL"""


#: A task names the blank nodes of about so many lines: what it holds of them takes some 150 bytes each.
_DEALT_LINES = 250_000


@query(_LINE_TRIPLES)
def inline_triples_each(spark, sf_dir):
    """Every triple of the nested objects, blank nodes named by their order and number."""
    # objects are far smaller than their triples: they are written and dealt by customer, and their triples stay where they are
    nested, _ = staged(_nested(spark, sf_dir), "nested")
    n_lines = nested.agg(F.expr("sum(aggregate(orders, 0L, (n, o) -> n + greatest(size(o.lines), 0)))")).first()[0] or 0
    dealt = nested.withColumn("key", F.coalesce(F.col("ckey").cast("string"), F.lit("")))
    dealt = dealt.repartition(max(spark.sparkContext.defaultParallelism, n_lines // _DEALT_LINES), "key")

    def cut(*fields: str) -> DataFrame:
        """The customers with only some of what their lines say, or without lines."""
        lines = lambda o: F.transform(o["lines"], lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias("lines")
        return dealt.withColumn("orders", F.transform("orders", lambda o: F.struct(o["okey"].alias("okey"), *([lines(o)] if fields else []))))

    def spread(p: str, label: str, value: Callable[[Column], Column]) -> Column:
        """The values that triples of a property give to labels, as maps of some 64 each, as a lookup goes through a map."""
        said = F.transform(F.filter("triples", lambda t: t["p"] == f"https://example.org/n/{p}"), lambda t: F.struct(t[label].alias("label"), value(t).alias("value")))
        held = lambda all_, i: F.filter(all_, lambda e: F.pmod(F.hash(e["label"]), F.floor(F.size(all_) / 64).cast("int") + 1) == i)
        maps = lambda all_: F.transform(F.sequence(F.lit(0), F.floor(F.size(all_) / 64).cast("int")), lambda i: F.map_from_entries(F.array_distinct(held(all_, i))))
        # as an element of an array, what is said is made once
        return F.transform(F.array(said), maps)[0]

    def name_of(label: str) -> Column:
        orders, numbers = (F.try_element_at(F.get(c, F.pmod(F.hash(label), F.size(c))), F.col(label)) for c in ("orders", "numbers"))
        return F.coalesce(F.concat(F.lit("_:"), orders, F.lit("|"), numbers), label)

    said = rdf.instance_rows(cut("number"), _nested_catalog(), "Cust")
    names = said.select("key", spread("lines", "o", lambda t: F.regexp_extract(t["s"], "[^/]+$", 0)).alias("orders"), spread("number", "s", lambda t: t["o"]).alias("numbers"))
    # only blank nodes meet their names, those of their customer; tables are small, and each side is where the other is
    of = lambda *fields: rdf.instances(cut(*fields), _nested_catalog(), "Cust", keep=["key"])
    blank = lambda end: F.col(f"{end}_kind") == "blank"
    named = lambda rows, *ends: rows.join(names.hint("shuffle_hash"), "key", "left").withColumns({e: F.when(blank(e), name_of(e)).otherwise(F.col(e)) for e in ends})
    columns = ["s", F.regexp_extract("p", "[^/#]+$", 0).alias("p"), "o", "o_kind", "o_datatype"]
    parts = [of().filter(~blank("s") & ~blank("o")), named(of("number", "quantity", "flag").filter(blank("s")), "s", "o"), named(of("number").filter(blank("o") & ~blank("s")), "o")]
    return parts[0].select(columns).unionByName(parts[1].select(columns)).unionByName(parts[2].select(columns))


_TREE = """{"id": "https://example.org/tree", "name": "tree", "imports": ["linkml:types"], "default_range": "string",
 "enums": {"Kind": {"permissible_values": {"a": {}, "b": {}}}},
 "classes": {"Item": {"attributes": {"id": {"required": true}, "qty": {"range": "integer", "minimum_value": 0}, "kind": {"range": "Kind"}, "parts": {"range": "Item", "multivalued": true, "inlined_as_list": true}}}}}"""
# a part's tree, from its lowest level up: up to 20 levels, each with a leaf beside the next
_TREE_LEVEL = """concat('{', CASE WHEN (p_partkey + CAST(i AS BIGINT)) % 13 = 0 THEN '' ELSE concat('"id": "n', i, '", ') END,
  '"qty": ', CASE WHEN (p_partkey + CAST(i AS BIGINT)) % 11 = 0 THEN '-3' WHEN (p_partkey + CAST(i AS BIGINT)) % 19 = 0 THEN '"many"' ELSE CAST(i AS STRING) END,
  CASE WHEN (p_partkey + CAST(i AS BIGINT)) % 17 = 0 THEN ', "odd": {"id": 1}' ELSE '' END, ', "kind": ', CASE WHEN (p_partkey + CAST(i AS BIGINT)) % 23 = 0 THEN '"q"' ELSE '"a"' END,
  CASE WHEN acc = '' THEN '' ELSE concat(', "parts": [', acc, ', {"id": "leaf", "kind": "b"}]') END, '}')"""


@query(
    f"""WITH RECURSIVE nodes(k, path, j) AS (
  SELECT p_partkey, '', CAST(list_reduce(list_transform(range(0, p_partkey % 21 + 1), lambda x: CAST(x AS STRING)), lambda acc, i: {_TREE_LEVEL}, '') AS JSON) FROM part
  UNION ALL SELECT k, path || '/parts/' || idx, json_extract(j, '$.parts[' || idx || ']') FROM (SELECT k, path, j, unnest(range(CAST(coalesce(json_array_length(j, '$.parts'), 0) AS BIGINT))) AS idx FROM nodes)
) SELECT k AS p_partkey, path || '/id' AS path, 'required' AS "constraint" FROM nodes WHERE json_extract(j, '$.id') IS NULL
UNION ALL SELECT k, path || '/qty', 'type' FROM nodes WHERE json_type(j, '$.qty') = 'VARCHAR'
UNION ALL SELECT k, path || '/qty', 'minimum' FROM nodes WHERE try_cast(json_extract_string(j, '$.qty') AS BIGINT) < 0
UNION ALL SELECT k, path || '/odd', 'extra' FROM nodes WHERE json_extract(j, '$.odd') IS NOT NULL
UNION ALL SELECT k, path || '/kind', 'enum' FROM nodes WHERE json_extract_string(j, '$.kind') NOT IN ('a', 'b')"""
)
def recursive_json(spark, sf_dir):
    """Instances of a class that contains itself, as JSON texts up to 21 levels deep: every fault and its place."""
    from typeloom.operators.lint import loaded

    text = F.expr(f"aggregate(sequence(0, CAST(p_partkey % 21 AS INT)), '', (acc, i) -> {_TREE_LEVEL})")
    rows = _spread(_table(spark, sf_dir, "part").select("p_partkey"))
    return recursive.json_faults(rows.select("p_partkey", text.alias("json")), loaded(text=_TREE), "Item", ["p_partkey"])



@query(f"SELECT ckey, okey, CAST(l_linenumber AS BIGINT) AS number, quantity, flag FROM {_OF}")
def framed_objects(spark, sf_dir):
    """Customers with their orders with their lines, taken apart into triples and put together from them again."""
    found = frames.frame(rdf.instances(_nested(spark, sf_dir), _nested_catalog(), "Cust"), _nested_catalog(), "Cust")
    orders = found.select("ckey", F.explode("orders").alias("o"))
    return orders.select("ckey", F.col("o.okey").alias("okey"), F.explode_outer("o.lines").alias("l")).select("ckey", "okey", F.col("l.number").alias("number"), F.col("l.quantity").alias("quantity"), F.col("l.flag").alias("flag"))


# an order's lines as a list: a cell for each, in the order of their numbers, the last of which leads to nil but for some orders
_CELLS = """SELECT concat('c', l_orderkey, '_', n) AS cell, l_orderkey, n, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS n FROM lineitem WHERE l_orderkey % 10 < 8) AS numbered"""
_LIST_TRIPLES = f"""
  SELECT cell AS s, 'blank' AS s_kind, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#first' AS p, CAST(l_partkey AS STRING) AS o, 'literal' AS o_kind FROM ({_CELLS}) AS a
  UNION ALL SELECT cell, 'blank', 'http://www.w3.org/1999/02/22-rdf-syntax-ns#rest', CASE WHEN following IS NOT NULL THEN following WHEN l_orderkey % 10 = 3 THEN concat('c', l_orderkey, '_1') ELSE 'http://www.w3.org/1999/02/22-rdf-syntax-ns#nil' END,
    CASE WHEN following IS NOT NULL OR l_orderkey % 10 = 3 THEN 'blank' ELSE 'iri' END FROM (SELECT cell, l_orderkey, lead(cell) OVER (PARTITION BY l_orderkey ORDER BY n) AS following FROM ({_CELLS}) AS b) AS c"""


@query(f"SELECT '_:c' || l_orderkey || '_1' AS head, n - 1 AS pos, CAST(l_partkey AS VARCHAR) AS o FROM ({_CELLS}) WHERE l_orderkey % 10 <> 3")
def rdf_lists(spark, sf_dir):
    """The members of RDF lists in order; lists that never end have none."""
    sql = re.sub(r"\bFROM lineitem", f"FROM (SELECT * FROM parquet.`{sf_dir}/lineitem.parquet`) AS lineitem", _LIST_TRIPLES)
    return frames.rdf_lists(spark.sql(sql)).select("head", "pos", "o")


@query("SELECT doc_id, md5(array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '\\' THEN '\\\\' WHEN c = '\"' THEN '\\\"' WHEN c = chr(10) THEN '\\n' WHEN c = chr(13) THEN '\\r' WHEN c = chr(9) THEN '\\t' WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN '\\u' || upper(lpad(to_hex(unicode(c)), 4, '0')) ELSE '\\U' || upper(lpad(to_hex(unicode(c)), 8, '0')) END), '')) AS escaped FROM (SELECT doc_id, text || ' ' || chr(128512) || '\"' || chr(9) AS text FROM documents)")
def nt_string_escapes(spark, sf_dir):
    """whole texts as N-Triples strings."""
    text = F.concat("text", F.lit(" \U0001F600\"\t"))
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(names.ntriples_string(text).cast("binary")).alias("escaped"))


@query("SELECT page_id, array_to_string(list_transform(string_split(iri, ''), lambda c: CASE WHEN unicode(c) BETWEEN 33 AND 126 AND NOT contains('<>\"{}|^`\\', c) THEN c ELSE '\\u' || upper(lpad(to_hex(unicode(c)), 4, '0')) END), '') AS iri FROM (SELECT page_id, url || CASE WHEN page_id % 2 = 0 THEN '/a <b>|{' || page_id || '} é\\^`\"' ELSE '' END AS iri FROM pages)")
def nt_iri_escapes(spark, sf_dir):
    """IRIs, some with what an IRI may not hold."""
    odd = F.concat(F.lit("/a <b>|{"), F.col("page_id").cast("string"), F.lit("} é\\^`\""))
    iri = F.concat("url", F.when(F.col("page_id") % 2 == 0, odd).otherwise(F.lit("")))
    return _table(spark, sf_dir, "pages").select("page_id", names.ntriples_iri(iri).alias("iri"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN length(text) END AS n_chars FROM documents")
def infer_required(spark, sf_dir):
    """a required value must equal its expression."""
    k, computed = F.col("doc_id") % 3, F.length("text").cast("long")
    given = F.when(k == 0, F.col("n_chars")).when(k == 1, F.col("n_chars") + 1)
    return _table(spark, sf_dir, "documents").select("doc_id", expressions.infer_required(given, computed, strict=False).alias("n_chars"))


_TYPED = '"imports": ["linkml:types"], "default_range": "string", '
_FAULTS = [
    (_TYPED + '"classes": {"R": {"tree_root": true}}', None),
    (_TYPED + '"classes": {"R": {"tree_root": true}, "A": {"is_a": "Nope"}}', "UnknownReference"),
    (_TYPED + '"classes": {"R": {"tree_root": true, "attributes": {"x": {"range": "sl"}}}}, "slots": {"sl": {}}', "InvalidRange"),
    (_TYPED + '"classes": {"R": {"tree_root": true, "is_a": "R"}}', "CyclicInheritance"),
    (_TYPED + '"classes": {"R": {"tree_root": true}, "S": {"tree_root": true}}', "MultipleTreeRoots"),
    (_TYPED + '"classes": {"R": {"tree_root": true}, "K": {"attributes": {"a": {"key": true}, "b": {"identifier": true}}}}', "MultipleKeyOrIdSlots"),
    (_TYPED + '"classes": {"R": {"tree_root": true}, "K": {"attributes": {"a": {"key": true, "range": "R"}}}}', "InvalidKeyOrIdSlotType"),
    (_TYPED + '"classes": {"R": {"tree_root": true}}, "enums": {"R": {}}', "NonUniqueName"),
    (_TYPED + '"classes": {"R": {"tree_root": true}}, "types": {"t": {"base": "str", "implicit_prefix": "nope"}}', "UndefinedPrefix"),
    (_TYPED + '"classes": {"R": {"tree_root": true}}, "slots": {"s": {"slot_uri": "no where:x"}}', "InvalidUriOrCurie"),
    (_TYPED + '"classes": {"R": {"tree_root": true}, "C": {"slot_usage": {"ghost": {"required": true}}}}', "InvalidSlotUsage"),
    (_TYPED + '"classes": {"A": {}}', "NoTreeRootClass"),
    (_TYPED + '"classes": 5', "SchemaParseError"),
    ('"imports": ["elsewhere"]', "SchemaImportError"),
    ('"default_range": "E", "enums": {"E": {}}, "classes": {"R": {"tree_root": true, "attributes": {"x": {"range": "string"}}}}', "UnknownStringReference"),
    ('"classes": {"R": {"tree_root": true, "attributes": {"x": {}}}}', "InvalidDefaultRange"),
    ('"classes": {"R": {"tree_root": true}}', "UndefinedDefaultRange"),
    ('"imports": ["linkml:units"], "id": "https://w3id.org/linkml/units"', "SchemaIdClash"),
]


@query("WITH faults(k, issue) AS (VALUES " + ", ".join(f"({i}, '{issue}')" for i, (_, issue) in enumerate(_FAULTS) if issue) + f") SELECT p_partkey, issue, 1 AS n FROM part JOIN faults ON p_partkey % {len(_FAULTS)} = k")
def corpus_lint(spark, sf_dir):
    """A schema text a row, each with one fault or none, linted where the rows are."""
    bodies = F.array(*[F.lit(body) for body, _ in _FAULTS])
    rest = F.element_at(bodies, (F.col("p_partkey") % len(_FAULTS) + 1).cast("int"))
    text = F.concat(F.lit('{"id": "https://e.org/'), F.col("p_partkey").cast("string"), F.lit('", "name": "s", '), rest, F.lit("}"))
    found = relational.lint_texts(_spread(_table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", text.alias("text")), "p_partkey", "text")
    return found.select("p_partkey", "issue", F.col("n").cast("int").alias("n"))


_FACTS = """
WITH k AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN 'https://p.org/ns#' ELSE 'https://e.org/' || p_partkey || '/' END AS ns FROM part),
facts(slot, kind, rng, prim, subject, form) AS (VALUES
  ('plain', 'type', '?', true, 'base', NULL), ('any', 'any', 'Any', false, 'base', NULL), ('code', 'type', 'code', false, 'implicit:p', NULL), ('link', 'type', 'uriorcurie', true, 'uriorcurie', NULL),
  ('e', 'enum', 'E', false, 'base', NULL), ('ref', 'reference', 'Keyed', false, '?', NULL), ('kids', 'inline', 'Keyed', false, 'base', '?'), ('one', 'inline', 'Bare', false, 'base', 'optional'))
SELECT k AS p_partkey, 'RootThing' AS cls, k % 5 = 0 AS tree_root, slot, ns || slot AS uri, kind,
  CASE WHEN slot <> 'plain' THEN rng WHEN k % 2 = 0 THEN 'integer' ELSE 'string' END AS "range", prim AS "primitive",
  CASE WHEN slot <> 'ref' THEN subject WHEN k % 4 = 0 THEN 'uri' ELSE 'base' END AS subject,
  CASE WHEN slot <> 'kids' THEN form WHEN k % 2 = 0 THEN 'simple_dict' ELSE 'compact_dict' END AS form
FROM k, facts"""


@query(_FACTS)
def corpus_attributes(spark, sf_dir):
    """Attributes as the catalogs of many schema texts resolve them."""
    k = F.col("p_partkey")
    pick = lambda check, yes, no: F.when(check, yes).otherwise(no)
    text = F.concat(
        F.lit('{"id": "https://e.org/'), k.cast("string"), F.lit('", "name": "s", "imports": ["linkml:types"], "prefixes": {"p": "https://p.org/ns#"}, "default_range": "'), pick(k % 2 == 0, "integer", "string"), F.lit('"'),
        pick(k % 3 == 0, ', "default_prefix": "p"', ""),
        F.lit(', "types": {"code": {"typeof": "string", "base": "str", "implicit_prefix": "p"}}, "enums": {"E": {"permissible_values": {"a": {}}}}, "classes": {"Any": {"class_uri": "linkml:Any"}, "Bare": {"attributes": {"n": {}}}, "Keyed": {"attributes": {"id": {"identifier": true, "range": "'),
        pick(k % 4 == 0, "uri", "string"), F.lit('"}'), pick(k % 2 == 0, ', "v": {}', ""),
        F.lit('}}, "root thing": {"tree_root": '), pick(k % 5 == 0, "true", "false"),
        F.lit(', "attributes": {"plain": {}, "any": {"range": "Any"}, "code": {"range": "code"}, "link": {"range": "uriorcurie"}, "e": {"range": "E"}, "ref": {"range": "Keyed"}, "kids": {"range": "Keyed", "multivalued": true, "inlined": true}, "one": {"range": "Bare"}}}}}'),
    )
    found = relational.describe_texts(_spread(_table(spark, sf_dir, "part").select("p_partkey")).select("p_partkey", text.alias("text")), "p_partkey", "text")
    return found.filter("cls = 'RootThing'")


# a schema document for each part, some of them broken
_DOCUMENT = """concat('{"id": "https://e.org/', p_partkey, '", "name": "s"', CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ', "default_range": "C1"' ELSE ', "imports": ["linkml:types"]' END,
  ', "prefixes": {"p": "https://p.org/"}, "slots": {"s": {', CASE p_partkey % 3 WHEN 0 THEN '"range": "C1"' WHEN 1 THEN '"required": true' ELSE '"range": "C1", "slot_uri": "p:x"' END, '}}, "classes": ',
  CASE WHEN p_partkey % 37 = 0 THEN '5' ELSE concat('{"C1": {"tree_root": ', CASE WHEN p_partkey % 4 = 0 THEN 'false' ELSE 'true' END, ', "class_uri": "',
    CASE p_partkey % 6 WHEN 0 THEN 'p:ok' WHEN 1 THEN 'zz:C' WHEN 2 THEN 'http://e.org/a b' WHEN 3 THEN 'plain' WHEN 4 THEN 'schema:Thing' ELSE concat('urn:x:', p_size) END,
    '"}, "C2": {"tree_root": ', CASE WHEN p_partkey % 5 = 0 THEN 'true' ELSE 'false' END, ', "attributes": {"a": {', CASE WHEN p_partkey % 2 = 0 THEN '"range": "C1"' ELSE '' END, '}}}}') END,
  CASE WHEN p_partkey % 31 = 0 THEN '' ELSE '}' END)"""


@query(f"""WITH docs AS (SELECT p_partkey, {_DOCUMENT} AS text FROM part),
errors AS (SELECT p_partkey, 'SchemaParseError' AS issue, CASE WHEN json_valid(text) THEN '/classes' ELSE '/' END AS path, NULL AS value FROM docs WHERE NOT json_valid(text) OR json_type(TRY_CAST(text AS JSON), '$.classes') <> 'OBJECT'),
good AS (SELECT p_partkey, TRY_CAST(text AS JSON) AS j, json_extract(TRY_CAST(text AS JSON), '$.default_range') IS NULL AND json_extract_string(TRY_CAST(text AS JSON), '$.imports[0]') IS NULL AS undefined FROM docs ANTI JOIN errors USING (p_partkey)),
roots AS (SELECT p_partkey, list_sort(list_filter(json_keys(j, '$.classes'), lambda c: json_extract_string(j, '$.classes.' || c || '.tree_root') = 'true')) AS names FROM good),
uris AS (SELECT p_partkey, '/slots/s/slot_uri' AS path, json_extract_string(j, '$.slots.s.slot_uri') AS value FROM good UNION ALL SELECT p_partkey, '/classes/C1/class_uri', json_extract_string(j, '$.classes.C1.class_uri') FROM good),
fatal AS (SELECT p_partkey, 'InvalidDefaultRange' AS issue, '/slots/s/range/' AS path, NULL AS value FROM good WHERE undefined AND json_extract(j, '$.slots.s.range') IS NULL
  UNION ALL SELECT p_partkey, 'InvalidDefaultRange', '/classes/C2/attributes/a/range/', NULL FROM good WHERE undefined AND json_extract(j, '$.classes.C2.attributes.a.range') IS NULL),
milder AS (SELECT p_partkey, 'MultipleTreeRoots' AS issue, '' AS path, array_to_string(names, ',') AS value FROM roots WHERE len(names) > 1
  UNION ALL SELECT p_partkey, 'NoTreeRootClass', '', NULL FROM roots WHERE len(names) = 0
  UNION ALL SELECT p_partkey, 'UndefinedDefaultRange', '', NULL FROM good WHERE undefined
  UNION ALL SELECT p_partkey, 'InvalidUriOrCurie', path, value FROM uris WHERE CASE WHEN contains(value, '://') OR value LIKE 'urn:%' THEN contains(value, ' ') ELSE contains(value, ':') AND split_part(value, ':', 1) NOT IN ('p', 'schema') END)
SELECT * FROM errors UNION ALL SELECT * FROM fatal UNION ALL SELECT * FROM milder ANTI JOIN fatal USING (p_partkey)""")
def lint_documents(spark, sf_dir):
    """Rules over the nodes of many schema documents."""
    docs = _spread(_table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.expr(_DOCUMENT).alias("text"))
    return paths.document_issues(paths.path_table(docs, "p_partkey", "text"), "p_partkey").select("p_partkey", "issue", "path", "value")


# documents that share ids by tens, written in two ways, of which some differ in content
_VERSION = """CASE WHEN p_partkey % 2 = 0
  THEN concat('{"id": "https://e.org/', CAST(floor(p_partkey / 10) AS BIGINT), '", "name": "s", "classes": {"A": {"rank": 1, "mixins": ["M", "N"]}, "B": {"description": "', CASE WHEN p_partkey % 30 < 10 THEN p_brand ELSE 'same' END, '"}}}')
  ELSE concat('{"classes" : {"B": { "description":"', CASE WHEN p_partkey % 30 < 10 THEN p_brand ELSE 'same' END, '"}, "A": {"mixins": [', CASE WHEN p_partkey % 50 = 15 THEN '"N", "M"' ELSE '"M", "N"' END, '], "rank": 1}}, "name": "s", "id": "https://e.org/', CAST(floor(p_partkey / 10) AS BIGINT), '"}') END"""


@query(f"""WITH docs AS (SELECT p_partkey, CAST({_VERSION} AS JSON) AS j FROM part),
flat AS (SELECT p_partkey, json_extract_string(j, '$.id') AS id, concat_ws('|', json_extract_string(j, '$.name'), json_extract_string(j, '$.classes.A.rank'), json_extract(j, '$.classes.A.mixins'), json_extract_string(j, '$.classes.B.description')) AS content FROM docs)
SELECT id, count(*) AS n_documents, count(DISTINCT content) AS n_contents FROM flat GROUP BY id HAVING count(DISTINCT content) > 1""")
def schema_id_clashes(spark, sf_dir):
    """V5: ids of documents that differ in structure, however they are written."""
    docs = _table(spark, sf_dir, "part").select("p_partkey", F.expr(_VERSION).alias("text"))
    return paths.id_clashes(paths.digests(paths.path_table(docs, "p_partkey", "text"), "p_partkey"))


# -- streams


def _streamed(spark, sf_dir, name, make):
    """A table read as a stream, made into another that is written until all has been read, and read back."""
    stream = spark.readStream.schema(_table(spark, sf_dir, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    out, path = make(stream), scratch_path(spark, "stream")
    run = out.writeStream.format("parquet").option("path", path).option("checkpointLocation", scratch_path(spark, "stream-state")).trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


@query("SELECT event_id, 'value' AS slot, 'minimum' AS \"constraint\" FROM events WHERE value < 1 UNION ALL SELECT event_id, 'event_type', 'enum' FROM events WHERE event_type NOT IN ('signup', 'error', 'click', 'view', 'purchase')")
def stream_violations(spark, sf_dir):
    """A row for each violation of a stream."""
    return _streamed(spark, sf_dir, "events", lambda s: streaming.violations(s, tables_catalog(), "Event", ["event_id"]))


@query("SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') AS window_start, 'value' AS slot, 'minimum' AS \"constraint\", count(*) AS n_invalid FROM events WHERE value < 1 AND time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') + INTERVAL 6 HOURS <= date_trunc('milliseconds', (SELECT max(ts) FROM events)) - INTERVAL 1 HOUR GROUP BY ALL")
def stream_windows(spark, sf_dir):
    """Violations by windows of event time, of those windows that the watermark has closed."""
    found = _streamed(spark, sf_dir, "events", lambda s: streaming.windowed_report(s.withColumn("ts", F.col("ts").cast("timestamp")), tables_catalog(), "Event", "ts", "6 hours", "1 hour"))
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def stream_orphans(spark, sf_dir):
    """Rows of a stream that refer to no row of a table."""
    parents = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return _streamed(spark, sf_dir, "orders", lambda s: streaming.orphans(s.select("o_orderkey", "o_custkey"), "o_custkey", parents, "c_custkey"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n > 1 AND user_id IS NOT NULL AND event_type IS NOT NULL")
def stream_duplicates(spark, sf_dir):
    """Every later row of a key of a stream."""
    return _streamed(spark, sf_dir, "events", lambda s: streaming.duplicates(s.select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"]))


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'syntax' WHEN c_custkey % 10 = 1 THEN 'escape' WHEN c_custkey % 10 = 2 THEN 'character' END AS reason, CASE WHEN c_custkey % 10 > 2 THEN c_name || ' \"é' || chr(128512) || '\\' || chr(10) || c_mktsegment END AS o, CASE WHEN c_custkey % 10 = 3 THEN 'en-GB' END AS o_lang FROM customer")
def ntriples_read(spark, sf_dir):
    """Lines of N-Triples with escapes and languages, and those that are none with the reason."""
    end = F.when(F.col("c_custkey") % 10 == 0, F.lit('" no end')).when(F.col("c_custkey") % 10 == 1, F.lit('\\q" .')).when(F.col("c_custkey") % 10 == 2, F.lit('\\uD800" .')).when(F.col("c_custkey") % 10 == 3, F.lit('"@en-GB .')).otherwise(F.lit('" .'))
    line = F.concat(F.lit("<https://e.org/"), F.col("c_custkey").cast("string"), F.lit('> <https://e.org/p> "'), "c_name", F.lit(' \\"\\u00e9\\U0001F600\\\\\\n'), "c_mktsegment", end)
    found = instances.ntriples_table(_table(spark, sf_dir, "customer").select(line.alias("value")))
    key = F.regexp_extract(F.coalesce("s", "line"), "e.org/([0-9]+)", 1).cast("long")
    return found.select(key.alias("c_custkey"), "reason", "o", "o_lang")


@query(
    "SELECT c_custkey, 'name' AS slot, c_name || ' . \"' || c_mktsegment || '\"' || chr(10) || 'é #' AS o, 'en-GB' AS o_lang FROM customer "
    "UNION ALL SELECT c_custkey, 'key', 'https://example.org/o' || c_custkey % 3 || '/' || c_nationkey, NULL FROM customer UNION ALL SELECT c_custkey, 'prefix', NULL, NULL FROM customer WHERE c_custkey % 50 = 0"
)
def turtle_read(spark, sf_dir):
    """Turtle files whose prefixes change from statement to statement, with long strings, blank nodes and statements that are none."""
    k, c = F.col("c_custkey").cast("string"), F.lit("<https://example.org/")
    text = F.concat(
        F.lit("@prefix o: <https://example.org/o"), (F.col("c_custkey") % 3).cast("string"), F.lit("/> .\n"),
        c, F.lit("c/"), k, F.lit("> <https://example.org/name> \"\"\""), "c_name", F.lit(' . "'), "c_mktsegment", F.lit('"\n\\u00e9 #"""@en-GB ;\n  <https://example.org/has> [ <https://example.org/key> o:'), F.col("c_nationkey").cast("string"), F.lit(" ] .\n"),
        F.when(F.col("c_custkey") % 50 == 0, F.concat(c, F.lit("c/"), k, F.lit("> <https://example.org/name> q:x ."))).otherwise(""),
    )
    path = scratch_path(spark, "turtle-text")
    _table(spark, sf_dir, "customer").select(text.alias("value")).write.text(path)
    found, _ = staged(turtle.turtle_table(spark, path), "turtle-read")
    key = F.regexp_extract(F.coalesce("s", "line"), "/c/([0-9]+)", 1).cast("long").alias("c_custkey")
    names = found.filter("p = 'https://example.org/name'").select(key, F.lit("name").alias("slot"), "o", "o_lang")
    rejects = found.filter("reason IS NOT NULL").select(key, F.col("reason").alias("slot"), F.lit(None).cast("string").alias("o"), F.lit(None).cast("string").alias("o_lang"))
    held = found.filter("p = 'https://example.org/has'").select(key, F.col("o").alias("node"))
    keys = held.join(found.filter("p = 'https://example.org/key'").select(F.col("s").alias("node"), "o", "o_lang"), "node").select("c_custkey", F.lit("key").alias("slot"), "o", "o_lang")
    return names.unionByName(keys).unionByName(rejects)


_ORDER_TRIPLES = """
  SELECT concat('https://example.org/order/', o_orderkey) AS s, 'iri' AS s_kind, 'https://example.org/of' AS p, concat('https://example.org/customer/', o_custkey) AS o, 'iri' AS o_kind, CAST(NULL AS STRING) AS o_datatype FROM orders
  UNION ALL SELECT concat('https://example.org/customer/', o_custkey), 'iri', 'https://example.org/orders', concat('https://example.org/order/', o_orderkey), 'iri', NULL FROM orders
  UNION ALL SELECT concat('https://example.org/order/', o_orderkey), 'iri', 'https://example.org/priority', concat(o_orderpriority, ' "', o_orderstatus, '"'), 'literal', 'https://example.org/text' FROM orders"""


@query(_ORDER_TRIPLES)
def turtle_written(spark, sf_dir):
    """Triples written as Turtle by ranges of subjects with the longest prefixes, and read back."""
    _table(spark, sf_dir, "orders").createOrReplaceTempView("_turtle_orders")
    path = scratch_path(spark, "turtle-files")
    spaces = [("x", "https://example.org/"), ("o", "https://example.org/order/"), ("c", "https://example.org/customer/")]
    rdf.write_turtle(spark.sql(_ORDER_TRIPLES.replace("FROM orders", "FROM _turtle_orders")), path, spaces)
    return turtle.read_turtle(spark, path)


# -- the schema algebra over a corpus: classes, slots and references made of the tables' rows by SQL that both engines read

_CORPUS = {
    "class_parents": """
        SELECT concat('C', p_partkey) AS cls, concat('C', CAST(floor(p_partkey / 2) AS BIGINT)) AS parent, 'is_a' AS kind, 0 AS ord FROM part WHERE p_partkey >= 2
        UNION ALL SELECT concat('C', p_partkey), concat('C', CAST(floor(p_partkey / 3) AS BIGINT)), 'mixin', 0 FROM part WHERE p_partkey % 5 = 0 AND p_partkey >= 3
        UNION ALL SELECT concat('C', p_partkey), concat('C', p_partkey - 3), 'mixin', 1 FROM part WHERE p_partkey % 7 = 0 AND p_partkey > 3""",
    "class_slots": """
        SELECT concat('C', p_partkey) AS cls, concat('s', p_size % 12) AS slot, 'attribute' AS source, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 7 = 1 THEN concat('C', p_partkey % 60) END AS rng,
               CASE WHEN p_partkey % 4 = 0 THEN true END AS required, CASE WHEN p_partkey % 6 = 0 THEN true END AS multivalued,
               CASE WHEN p_partkey % 11 = 0 THEN true END AS identifier, CASE WHEN p_partkey % 2 = 0 THEN concat('^', p_type) END AS pattern
        FROM part WHERE p_partkey % 2 = 1 OR p_partkey < 40
        UNION ALL SELECT concat('C', p_partkey), concat('s', p_partkey % 13), 'slot_usage', p_type, CASE WHEN p_partkey % 8 = 1 THEN true END, CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), p_name
        FROM part WHERE p_partkey % 3 = 1
        UNION ALL SELECT concat('C', p_partkey), concat('t', p_partkey % 5), 'slot', CAST(NULL AS STRING), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), CAST(NULL AS BOOLEAN), CAST(NULL AS STRING)
        FROM part WHERE p_partkey % 9 = 2""",
    "slots": """
        SELECT concat('t', r_regionkey) AS slot, 0 AS ord, r_name AS rng, r_regionkey % 2 = 0 AS required, CAST(NULL AS BOOLEAN) AS multivalued, CAST(NULL AS BOOLEAN) AS identifier, CAST(NULL AS STRING) AS pattern FROM region
        UNION ALL SELECT concat('t', n_regionkey), 1 + n_nationkey, 'far', CAST(NULL AS BOOLEAN), n_nationkey % 3 = 0, CAST(NULL AS BOOLEAN), n_name FROM nation""",
    "graph": """
        SELECT concat('https://e.org/c/', c_custkey) AS s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, CASE WHEN c_custkey % 7 = 0 THEN 'https://e.org/Vip' ELSE 'https://e.org/Buyer' END AS o, 'iri' AS o_kind, CAST(NULL AS STRING) AS o_datatype FROM customer WHERE c_custkey % 41 <> 0
        UNION ALL SELECT concat('https://e.org/c/', c_custkey), 'https://e.org/name', c_name, 'literal', CASE WHEN c_custkey % 5 = 0 THEN 'http://www.w3.org/2001/XMLSchema#string' END FROM customer WHERE c_custkey % 11 <> 0
        UNION ALL SELECT concat('https://e.org/c/', c_custkey), 'https://e.org/name', concat(c_name, 'x'), 'literal', CAST(NULL AS STRING) FROM customer WHERE c_custkey % 13 = 0
        UNION ALL SELECT concat('https://e.org/c/', c_custkey), 'https://e.org/nation', CASE WHEN c_custkey % 17 = 0 THEN 'n/a' ELSE CAST(c_nationkey AS STRING) END, 'literal', CASE WHEN c_custkey % 19 = 0 THEN CAST(NULL AS STRING) ELSE 'http://www.w3.org/2001/XMLSchema#integer' END FROM customer
        UNION ALL SELECT concat('https://e.org/c/', c_custkey), 'https://e.org/segment', concat('https://e.org/', CASE WHEN c_custkey % 23 = 0 THEN 'NONE' ELSE c_mktsegment END), CASE WHEN c_custkey % 29 = 0 THEN 'literal' ELSE 'iri' END, CAST(NULL AS STRING) FROM customer
        UNION ALL SELECT concat('https://e.org/c/', c_custkey), 'https://e.org/tier', CAST(c_custkey % 3 AS STRING), 'literal', 'http://www.w3.org/2001/XMLSchema#integer' FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 31 = 0
        UNION ALL SELECT concat('https://e.org/o/', o_orderkey), 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'https://e.org/Sale', 'iri', CAST(NULL AS STRING) FROM orders
        UNION ALL SELECT concat('https://e.org/o/', o_orderkey), 'https://e.org/buyer', CASE WHEN o_orderkey % 100 = 3 THEN concat('https://e.org/o/', o_orderkey) ELSE concat('https://e.org/c/', o_custkey) END, CASE WHEN o_orderkey % 100 = 4 THEN 'literal' ELSE 'iri' END, CAST(NULL AS STRING) FROM orders WHERE o_orderkey % 100 <> 5
        UNION ALL SELECT concat('https://e.org/o/', o_orderkey), 'https://e.org/mark', CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN concat('https://e.org/c/', o_custkey) WHEN 2 THEN 'https://e.org/BUILDING' ELSE o_orderpriority END, CASE WHEN o_orderkey % 4 IN (1, 2) THEN 'iri' ELSE 'literal' END, CASE WHEN o_orderkey % 4 = 0 THEN 'http://www.w3.org/2001/XMLSchema#integer' END FROM orders
        UNION ALL SELECT concat('https://e.org/o/', o_orderkey), 'https://e.org/odd', o_orderstatus, 'literal', CAST(NULL AS STRING) FROM orders WHERE o_orderkey % 37 = 0""",
    "schema_imports": """
        SELECT concat('m', p_partkey) AS schema, concat('m', CAST(floor(p_partkey / 12) AS BIGINT) * 12 + (p_partkey * 2) % 12) AS import, 0 AS position FROM part
        UNION ALL SELECT concat('m', p_partkey), concat('m', CAST(floor(p_partkey / 12) AS BIGINT) * 12 + (p_partkey + 7) % 12), 1 FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT concat('m', p_partkey), concat('b', p_partkey % 5), p_size % 3 + 2 FROM part WHERE p_partkey % 4 = 1
        UNION ALL SELECT concat('m', p_partkey), concat('gone', p_partkey % 3), 5 FROM part WHERE p_partkey % 50 = 9
        UNION ALL SELECT concat('b', r_regionkey), concat('b', (r_regionkey + 2) % 5), 0 FROM region
        UNION ALL SELECT concat('b', r_regionkey), concat('b', (r_regionkey + 1) % 5), 1 FROM region WHERE r_regionkey % 2 = 0""",
    "schema_files": "SELECT concat('m', p_partkey) AS schema FROM part UNION ALL SELECT concat('b', r_regionkey) FROM region",
    "schema_elements": """
        SELECT concat('m', p_partkey) AS schema, 'class' AS kind, concat('C', p_size % 9) AS name FROM part
        UNION ALL SELECT concat('m', p_partkey), 'enum', concat('C', p_size % 11) FROM part WHERE p_partkey % 6 = 1
        UNION ALL SELECT concat('m', p_partkey), 'slot', p_brand FROM part
        UNION ALL SELECT concat('b', r_regionkey), 'type', r_name FROM region UNION ALL SELECT concat('b', r_regionkey), 'class', concat('C', r_regionkey) FROM region""",
    "schema_refs": """
        SELECT concat('m', p_partkey) AS schema, '/classes/A/is_a' AS path, concat('C', (p_size + 1) % 10) AS value, 'class' AS expected_kind FROM part
        UNION ALL SELECT concat('m', p_partkey), '/slots/s/range', CASE p_partkey % 4 WHEN 0 THEN 'string' WHEN 1 THEN p_brand WHEN 2 THEN 'ASIA' ELSE concat('C', p_size % 11) END, 'range' FROM part""",
    "layers": """
        SELECT concat('C', p_partkey) AS cls, concat('s', p_size % 6) AS slot, 'attribute' AS source, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN concat(p_brand, ',', p_type) WHEN 2 THEN p_type END AS aliases,
               concat('a', p_partkey % 3, '=', p_partkey, ',b=', p_size) AS notes, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS title
        FROM part WHERE p_partkey % 2 = 1 OR p_partkey < 60
        UNION ALL SELECT concat('C', p_partkey), concat('s', p_partkey % 7), 'slot_usage', p_type, CASE WHEN p_partkey % 2 = 0 THEN concat('u', p_partkey % 5, '=', p_name) END, p_name
        FROM part WHERE p_partkey % 3 = 1
        UNION ALL SELECT concat('C', p_partkey), concat('t', p_partkey % 5), 'slot', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(NULL AS STRING) FROM part WHERE p_partkey % 9 = 2
        UNION ALL SELECT concat('C', p_partkey), concat('t', p_partkey % 5), 'slot_usage', p_brand, concat('c=', p_partkey), p_type FROM part WHERE p_partkey % 8 = 3""",
    "top_slots": """
        SELECT concat('t', r_regionkey) AS slot, 0 AS ord, concat(r_name, ',x') AS aliases, concat('c=', r_name) AS notes, r_name AS title FROM region
        UNION ALL SELECT concat('t', n_regionkey), 1 + n_nationkey, n_name, concat('d', n_nationkey, '=', n_name), n_name FROM nation""",
    "elements": """
        SELECT concat('C', p_partkey) AS name, 'class' AS kind, CAST(p_partkey % 3 AS INT) AS schema_ord, concat('u:c', p_size) AS uri FROM part
        UNION ALL SELECT concat('C', p_partkey), 'class', 3, concat('u:d', p_size) FROM part WHERE p_partkey % 10 = 0
        UNION ALL SELECT concat('C', p_partkey), 'enum', 4, concat('u:e', p_size) FROM part WHERE p_partkey % 50 = 0
        UNION ALL SELECT DISTINCT p_brand, 'type', 1, concat('u:', p_brand) FROM part
        UNION ALL SELECT DISTINCT p_type, 'enum', 2, concat('u:', p_type) FROM part
        UNION ALL SELECT concat('s', p_partkey), 'slot', 0, concat('u:c', p_partkey) FROM part WHERE p_partkey < 12
        UNION ALL SELECT concat('C', p_partkey), 'slot', 1, 'u:x' FROM part WHERE p_partkey % 70 = 3
        UNION ALL SELECT n_name, 'subset', 0, concat('u:', n_name) FROM nation""",
    "refs": """
        SELECT concat('/classes/C', p_partkey, '/is_a/') AS path, concat('C', 2 * p_partkey) AS value, 'class' AS expected_kind FROM part
        UNION ALL SELECT concat('/classes/C', p_partkey, '/attributes/a/range/'), CASE WHEN p_partkey % 5 = 0 THEN 'string' WHEN p_partkey % 7 = 0 THEN concat('s', p_partkey % 20) WHEN p_partkey % 11 = 0 THEN 'NATION_3' WHEN p_partkey % 13 = 0 THEN p_type ELSE p_brand END, 'range' FROM part""",
    "edges": """
        SELECT concat('C', p_partkey) AS src, concat('C', CAST(floor(p_partkey / 2) AS BIGINT)) AS dst FROM part WHERE p_partkey % 4 <> 3
        UNION ALL SELECT concat('C', p_partkey), p_brand FROM part WHERE p_partkey % 3 = 0
        UNION ALL SELECT p_brand, p_type FROM part WHERE p_partkey % 5 = 0
        UNION ALL SELECT p_type, concat('C', p_partkey) FROM part WHERE p_partkey % 97 = 5""",
    "typed_elements": """
        SELECT DISTINCT concat('C', p_partkey) AS name, 'class' AS kind FROM part
        UNION ALL SELECT concat('C', p_partkey), 'enum' FROM part WHERE p_partkey % 10 = 0
        UNION ALL SELECT DISTINCT p_brand, 'type' FROM part
        UNION ALL SELECT DISTINCT p_type, 'enum' FROM part
        UNION ALL SELECT DISTINCT p_type, 'slot' FROM part
        UNION ALL SELECT concat('t', r_regionkey), 'slot' FROM region""",
    "types": "SELECT p_brand AS type, CASE WHEN count(*) % 2 = 0 THEN max(p_type) END AS typeof, CASE WHEN count(*) % 3 = 0 THEN split(concat('C', min(p_partkey), ',nowhere,C', max(p_partkey)), ',') END AS union_of FROM part GROUP BY p_brand",
    "enums": "SELECT p_type AS enum, CASE WHEN count(*) % 2 = 1 THEN split(concat('C', 10 * min(p_partkey), ',', max(p_brand)), ',') END AS inherits FROM part GROUP BY p_type",
    "slot_says": "SELECT concat('t', r_regionkey) AS slot, concat('C', r_regionkey * 31 + 1) AS rng, CASE WHEN r_regionkey = 2 THEN 'C40' END AS domain FROM region",
    "slot_parents": "SELECT concat('t', r_regionkey) AS slot, concat('t', (r_regionkey + 1) % 5) AS parent FROM region WHERE r_regionkey % 2 = 0",
    "seeds": "SELECT concat('C', p_partkey) AS seed FROM part WHERE p_partkey % 90 = 17",
    "grps": """
        SELECT concat('g', s_suppkey) AS grp, concat('C', s_suppkey * 7 + 3) AS cls FROM supplier
        UNION ALL SELECT concat('g', s_suppkey), concat('C', s_suppkey * 5 + 11) FROM supplier
        UNION ALL SELECT concat('g', s_suppkey), concat('C', s_suppkey + 40) FROM supplier WHERE s_suppkey % 3 = 0""",
    "used": "SELECT DISTINCT lower(c_mktsegment) AS prefix FROM customer",
    "prefixes": """
        SELECT DISTINCT 0 AS schema_ord, lower(c_mktsegment) AS prefix, concat('https://example.org/', lower(c_mktsegment), CASE WHEN c_mktsegment < 'C' THEN '#' WHEN c_mktsegment < 'H' THEN '' ELSE '/' END) AS namespace
        FROM customer WHERE c_mktsegment <> 'MACHINERY'""",
    "curies": """
        SELECT CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN concat('urn:x:', c_custkey) WHEN 2 THEN concat('http://e.org/', c_custkey) ELSE concat(lower(c_mktsegment), ':', c_custkey, ':a') END AS curie FROM customer
        UNION ALL SELECT concat(lower(c_mktsegment), ':', c_custkey) FROM customer WHERE c_custkey % 4 = 0""",
    "seqs": """
        SELECT concat('s', o_custkey % 200) AS slot, o_orderkey AS p, o_orderstatus AS a, o_orderpriority AS b FROM orders WHERE o_orderkey % 5 = 0""",
    "issues": "SELECT CASE l_returnflag WHEN 'R' THEN 'fatal' WHEN 'A' THEN 'error' ELSE 'warning' END AS severity, l_linestatus AS what FROM lineitem",
}


def _corpus(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relation of the corpus; ``rng`` stands for range, which SQL reserves."""
    sql = re.sub(r"\bFROM (\w+)", lambda m: f"FROM parquet.`{sf_dir}/{m[1]}.parquet`", _CORPUS[name])
    return spark.sql(sql).withColumnRenamed("rng", "range")


def _with(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_CORPUS[n]})" for n in names)


# every way up from each class, with the place of each step among a class's parents; the first way in that order ranks an ancestor
_UP = """ways(cls, ancestor, way) AS (
  SELECT c, c, CAST([] AS BIGINT[]) FROM (SELECT cls AS c FROM class_parents UNION SELECT parent FROM class_parents)
  UNION ALL SELECT w.cls, e.parent, list_append(w.way, e.ord + CASE e.kind WHEN 'is_a' THEN 100 ELSE 0 END) FROM ways w JOIN class_parents e ON w.ancestor = e.cls
), anc AS (SELECT cls, ancestor, CAST(min(len(way)) AS INTEGER) AS depth, CAST(row_number() OVER (PARTITION BY cls ORDER BY min(way)) - 1 AS INTEGER) AS p FROM ways GROUP BY cls, ancestor)"""


@query(f"{_with('class_parents')}, {_UP} SELECT cls, ancestor, depth, p FROM anc")
def class_ancestors(spark, sf_dir):
    """Ancestors with their distance and their rank by precedence."""
    return relational.ancestors(_corpus(spark, sf_dir, "class_parents")).select("cls", "ancestor", "depth", "p")


@query(f"{_with('class_parents', 'grps')}, {_UP}, held AS (SELECT grp, g.cls, coalesce(ancestor, g.cls) AS ancestor FROM grps g LEFT JOIN anc ON g.cls = anc.cls), sizes AS (SELECT grp, count(DISTINCT cls) AS n FROM grps GROUP BY grp), common AS (SELECT held.grp, ancestor FROM held JOIN sizes ON held.grp = sizes.grp GROUP BY held.grp, ancestor, n HAVING count(DISTINCT cls) = n) SELECT grp, ancestor FROM common c WHERE NOT EXISTS (SELECT 1 FROM common d JOIN anc ON d.ancestor = anc.cls WHERE d.grp = c.grp AND anc.ancestor = c.ancestor AND anc.cls <> c.ancestor)")
def lca(spark, sf_dir):
    """G5, U2, U3."""
    return relational.lowest_common_ancestors(_corpus(spark, sf_dir, "class_parents"), _corpus(spark, sf_dir, "grps"))


_SHAPES = """{"id": "https://example.org/shapes", "name": "shapes", "imports": ["linkml:types"], "default_range": "string", "default_prefix": "e", "prefixes": {"e": "https://e.org/"},
 "enums": {"Segment": {"permissible_values": {"MACHINERY": {}, "FURNITURE": {}, "BUILDING": {}, "AUTOMOBILE": {}, "HOUSEHOLD": {}}}},
 "classes": {
  "Agent": {"abstract": true, "attributes": {"id": {"identifier": true}, "name": {"required": true}, "nation": {"range": "integer"}}},
  "Buyer": {"is_a": "Agent", "attributes": {"segment": {"range": "Segment"}}},
  "Vip": {"is_a": "Buyer", "attributes": {"tier": {"range": "integer"}}},
  "Sale": {"attributes": {"buyer": {"range": "Buyer", "required": true}, "mark": {"any_of": [{"range": "integer"}, {"range": "Segment"}, {"range": "Vip"}]}}}}}"""


@query(
    f"""WITH g AS ({_CORPUS['graph']}), t AS (SELECT s, o AS type FROM g WHERE p LIKE '%#type'), up(type, shape) AS (VALUES ('Vip', 'Vip'), ('Vip', 'Buyer'), ('Vip', 'Agent'), ('Buyer', 'Buyer'), ('Buyer', 'Agent'), ('Sale', 'Sale')),
targets AS (SELECT DISTINCT s, 'https://e.org/' || shape AS shape FROM t JOIN up ON t.type = 'https://e.org/' || up.type),
props(shape, p) AS (VALUES ('Agent', 'name'), ('Agent', 'nation'), ('Buyer', 'name'), ('Buyer', 'nation'), ('Buyer', 'segment'), ('Vip', 'name'), ('Vip', 'nation'), ('Vip', 'segment'), ('Vip', 'tier'), ('Sale', 'buyer'), ('Sale', 'mark')),
v AS (SELECT DISTINCT targets.s, targets.shape, g.p, o, o_kind, o_datatype, props.p IS NOT NULL AS known FROM g JOIN targets USING (s) LEFT JOIN props ON targets.shape = 'https://e.org/' || props.shape AND g.p = 'https://e.org/' || props.p WHERE g.p NOT LIKE '%#type'),
k AS (SELECT *, split_part(p, '.org/', 2) AS n, EXISTS (SELECT 1 FROM t WHERE t.s = v.o AND t.type IN ('https://e.org/Buyer', 'https://e.org/Vip')) AS buys, EXISTS (SELECT 1 FROM t WHERE t.s = v.o AND t.type = 'https://e.org/Vip') AS vip,
  o_kind = 'literal' AND o_datatype = 'http://www.w3.org/2001/XMLSchema#integer' AND regexp_full_match(o, '[+-]?[0-9]+') AS whole, o_kind = 'iri' AND o IN ('https://e.org/MACHINERY', 'https://e.org/FURNITURE', 'https://e.org/BUILDING', 'https://e.org/AUTOMOBILE', 'https://e.org/HOUSEHOLD') AS segment FROM v WHERE known),
found AS (SELECT s, shape, p, 'closed' AS "constraint", o FROM v WHERE NOT known AND shape <> 'https://e.org/Agent' AND p <> 'https://e.org/id'
UNION ALL SELECT s, shape, p, 'datatype', o FROM k WHERE n IN ('nation', 'tier') AND NOT coalesce(whole, false)
UNION ALL SELECT s, shape, p, 'in', o FROM k WHERE n = 'segment' AND NOT segment
UNION ALL SELECT s, shape, p, 'nodeKind', o FROM k WHERE n = 'buyer' AND o_kind = 'literal'
UNION ALL SELECT s, shape, p, 'class', o FROM k WHERE n = 'buyer' AND (o_kind = 'literal' OR NOT buys)
UNION ALL SELECT s, shape, p, 'or', o FROM k WHERE n = 'mark' AND NOT (coalesce(whole, false) OR segment OR (o_kind = 'iri' AND vip))
UNION ALL SELECT s, shape, p, 'maxCount', NULL FROM k WHERE n <> 'id' GROUP BY s, shape, p HAVING count(*) > 1
UNION ALL SELECT s, targets.shape, 'https://e.org/' || r.p, 'minCount', NULL FROM targets JOIN (VALUES ('Agent', 'name'), ('Buyer', 'name'), ('Vip', 'name'), ('Sale', 'buyer')) r(shape, p) ON targets.shape = 'https://e.org/' || r.shape WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.s = targets.s AND g.p = 'https://e.org/' || r.p))
SELECT s, shape, p AS path, "constraint", o AS value FROM found"""
)
def shape_violations(spark, sf_dir):
    """D1-D3, D6, D8, D9, D11 over triples: nodes against the shapes of their classes and of their ancestors."""
    from typeloom.operators.lint import loaded

    return shapes.shape_violations(_corpus(spark, sf_dir, "graph"), loaded(text=_SHAPES))


# what each root reaches, by the simple path that comes first: that is the order in which schemas are loaded
_LOADED = f"""{_with('schema_imports', 'schema_files')}, known AS (SELECT * FROM schema_imports WHERE import IN (SELECT schema FROM schema_files)), paths(root, schema, way, met) AS (
  SELECT schema, schema, CAST([] AS BIGINT[]), [schema] FROM schema_files
  UNION ALL SELECT root, k.import, list_append(way, k.position), list_append(met, k.import) FROM paths JOIN known k USING (schema) WHERE NOT list_contains(met, k.import)
), loaded AS (SELECT root, schema, CAST(row_number() OVER (PARTITION BY root ORDER BY min(way)) - 1 AS INTEGER) AS ord FROM paths GROUP BY root, schema)"""
_SEEN = f"""{_LOADED}, schema_elements AS ({_CORPUS['schema_elements']}), seen AS (SELECT root, kind, name, arg_max(e.schema, ord) AS schema FROM loaded JOIN schema_elements e USING (schema) GROUP BY root, kind, name)"""


def _loaded(spark, sf_dir):
    return relational.import_closure(_corpus(spark, sf_dir, "schema_imports"), _corpus(spark, sf_dir, "schema_files"))


@query(_LOADED + " SELECT root, schema, ord FROM loaded")
def import_closure(spark, sf_dir):
    """What each of many schemas loads, in order, through cycles and diamonds of imports."""
    return _loaded(spark, sf_dir)


@query(_LOADED + " SELECT DISTINCT root, l.schema, i.import FROM loaded l JOIN schema_imports i USING (schema) WHERE i.import NOT IN (SELECT schema FROM schema_files)")
def missing_imports(spark, sf_dir):
    """S3, V6: imports that cannot be loaded, for each root that meets them."""
    return relational.missing_imports(_loaded(spark, sf_dir), _corpus(spark, sf_dir, "schema_imports"), _corpus(spark, sf_dir, "schema_files"))


@query(_SEEN + " SELECT * FROM seen")
def root_index(spark, sf_dir):
    """P1, P2 for many roots: the schema that gives each name, the one loaded last."""
    return relational.root_index(_loaded(spark, sf_dir), _corpus(spark, sf_dir, "schema_elements"))


@query(f"""{_SEEN}, schema_refs AS ({_CORPUS['schema_refs']}), kinds AS (SELECT root, name AS value, list(kind) AS kinds FROM seen GROUP BY root, name)
SELECT root, schema, path, value, CASE WHEN kinds IS NULL THEN CASE WHEN value = 'string' THEN 'UnknownStringReference' ELSE 'UnknownReference' END WHEN expected_kind = 'range' THEN 'InvalidRange' ELSE 'UnknownReference' END AS issue
FROM loaded JOIN schema_refs USING (schema) LEFT JOIN kinds USING (root, value)
WHERE kinds IS NULL OR NOT CASE WHEN expected_kind = 'range' THEN list_has_any(kinds, ['class', 'type', 'enum']) ELSE list_contains(kinds, expected_kind) END""")
def root_references(spark, sf_dir):
    """P3, V1-V3 for many roots: references that what a root loads does not resolve."""
    loaded = _loaded(spark, sf_dir)
    index = relational.root_index(loaded, _corpus(spark, sf_dir, "schema_elements"))
    return relational.root_reference_issues(loaded, index, _corpus(spark, sf_dir, "schema_refs"))


_REACHED = f"{_with('elements', 'edges', 'seeds')}, r(node) AS (SELECT seed FROM seeds UNION SELECT dst FROM r JOIN edges ON node = src)"


@query(_REACHED + " SELECT node FROM r")
def reachable_elements(spark, sf_dir):
    """A closure over a cyclic graph."""
    return relational.reachable(_corpus(spark, sf_dir, "edges"), _corpus(spark, sf_dir, "seeds"))


@query(_REACHED + " SELECT name, kind, schema_ord, uri FROM elements WHERE name NOT IN (SELECT node FROM r)")
def unused_elements(spark, sf_dir):
    """Elements that no seed reaches."""
    return relational.unused(_corpus(spark, sf_dir, "elements"), _corpus(spark, sf_dir, "edges"), _corpus(spark, sf_dir, "seeds")).select("name", "kind", "schema_ord", "uri")


@query(f"{_with('elements', 'edges')}, start AS (SELECT name FROM elements WHERE kind = 'class' AND schema_ord = 0 UNION SELECT 'Brand#7'), r(node) AS (SELECT name FROM start UNION SELECT dst FROM r JOIN edges ON node = src) SELECT kind, count(*) AS n FROM elements WHERE name IN (SELECT node FROM r) GROUP BY kind")
def pruned_elements(spark, sf_dir):
    """What a generator keeps from the root schema's classes and the default range on."""
    elements = _corpus(spark, sf_dir, "elements")
    kept = relational.pruned(elements, _corpus(spark, sf_dir, "edges"), default_ranges=["Brand#7"])
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_MERGED = f"""{_with('class_parents', 'class_slots', 'slots')}, {_UP}, held AS (
  SELECT cls, ancestor, p FROM anc UNION SELECT cls, cls, 0 FROM class_slots WHERE cls NOT IN (SELECT cls FROM anc)
), own AS (
  SELECT h.cls, s.slot, s.rng, s.required, s.multivalued, s.identifier, s.pattern, s.source, 10 * p + CASE source WHEN 'slot_usage' THEN 1 WHEN 'attribute' THEN 2 ELSE 3 END AS q
  FROM held h JOIN class_slots s ON h.ancestor = s.cls
), layers AS (
  SELECT * FROM own UNION ALL
  SELECT o.cls, s.slot, s.rng, s.required, s.multivalued, s.identifier, s.pattern, 'top', 1000000000 + s.ord
  FROM (SELECT cls, slot FROM own GROUP BY cls, slot HAVING NOT bool_or(source = 'attribute')) o JOIN slots s ON o.slot = s.slot
), derived AS (SELECT cls, slot, arg_min(rng, q) FILTER (WHERE rng IS NOT NULL) AS "range",
  coalesce(bool_or(required), false) OR coalesce(bool_or(identifier), false) AS required, coalesce(bool_or(multivalued), false) AS multivalued, coalesce(bool_or(identifier), false) AS identifier,
  arg_min(pattern, q) FILTER (WHERE pattern IS NOT NULL) AS pattern FROM layers GROUP BY cls, slot HAVING bool_or(source IN ('attribute', 'slot')))"""


def _derived(spark, sf_dir):
    return relational.derive_slots(*(_corpus(spark, sf_dir, n) for n in ("class_parents", "class_slots", "slots")))


@query(_MERGED + ' SELECT cls, slot, "range", required, multivalued, identifier, pattern FROM derived')
def derive_slots(spark, sf_dir):
    """The precedence-ordered merge, with the schema's own slots last."""
    return _derived(spark, sf_dir)


@query(_MERGED + ", steps AS (SELECT cls AS src, \"range\" AS dst FROM derived WHERE \"range\" IS NOT NULL UNION SELECT cls, ancestor FROM anc WHERE cls <> ancestor), r(node) AS (SELECT seed FROM (SELECT concat('C', p_partkey) AS seed FROM part WHERE p_partkey % 90 = 17) UNION SELECT dst FROM r JOIN steps ON node = src) SELECT node FROM r")
def derived_reachability(spark, sf_dir):
    """What classes reach by the ranges of their derived slots and by their ancestors."""
    edges = relational.derived_edges(_derived(spark, sf_dir), _corpus(spark, sf_dir, "class_parents"))
    return relational.reachable(edges, _corpus(spark, sf_dir, "seeds"))


@query(f"{_with('class_parents', 'class_slots', 'seeds')}, steps AS (SELECT cls AS src, rng AS dst FROM class_slots WHERE rng IS NOT NULL UNION SELECT cls, slot FROM class_slots WHERE source = 'slot' UNION SELECT cls, parent FROM class_parents), r(node) AS (SELECT seed FROM seeds UNION SELECT dst FROM r JOIN steps ON node = src) SELECT node FROM r")
def underived_reachability(spark, sf_dir):
    """The same over what is written: ranges, named slots and parents."""
    edges = relational.underived_edges(_corpus(spark, sf_dir, "class_slots"), _corpus(spark, sf_dir, "class_parents"))
    return relational.reachable(edges, _corpus(spark, sf_dir, "seeds"))


_TYPED = f"""typed_elements AS ({_CORPUS['typed_elements']}), types AS ({_CORPUS['types']}), enums AS ({_CORPUS['enums']}), seeds AS ({_CORPUS['seeds']}),
means AS (SELECT name, arg_min(kind, CASE kind WHEN 'class' THEN 0 WHEN 'type' THEN 1 ELSE 2 END) AS kind FROM typed_elements WHERE kind <> 'slot' GROUP BY name),
below AS (SELECT 'type' AS src_kind, type AS src, 'typeof' AS how, typeof AS name, true AS inlined FROM types UNION ALL SELECT 'type', type, 'union_of', unnest(union_of), true FROM types UNION ALL SELECT 'enum', enum, 'inherits', unnest(inherits), true FROM enums)"""
_TYPED_WALK = """, e AS (SELECT src_kind, src, m.kind AS dst_kind, u.name AS dst FROM uses u JOIN means m ON u.name = m.name WHERE how NOT IN ('parent', 'slot') AND (how <> 'range' OR m.kind <> 'class' OR inlined)
UNION SELECT src_kind, src, t.kind, u.name FROM uses u JOIN typed_elements t ON u.name = t.name AND t.kind = CASE how WHEN 'slot' THEN 'slot' ELSE src_kind END WHERE how IN ('parent', 'slot')),
r(kind, name) AS (SELECT 'class', seed FROM seeds UNION SELECT dst_kind, dst FROM r JOIN e ON kind = src_kind AND name = src) SELECT kind, name FROM r"""
_BRANCHES = {"any_of": "CASE WHEN slot = 's5' THEN split(concat(cls, '0,', rng), ',') END", "domain": "CASE WHEN slot = 's7' THEN concat('C', 10 * length(cls)) END"}


def _typed(spark, sf_dir, uses, inlined_only):
    edges = reach.typed_edges(uses, _corpus(spark, sf_dir, "typed_elements"), inlined_only)
    seeds = _corpus(spark, sf_dir, "seeds").select(F.lit("class").alias("kind"), F.col("seed").alias("name"))
    return reach.reached(edges, seeds).select("kind", "name")


@query(f"""{_MERGED}, {_TYPED}, said AS (SELECT *, {_BRANCHES['any_of']} AS any_of, {_BRANCHES['domain']} AS domain FROM (SELECT *, "range" AS rng FROM derived)),
uses AS (SELECT 'class' AS src_kind, cls AS src, 'range' AS how, rng AS name, multivalued AS inlined FROM said UNION ALL SELECT 'class', cls, 'any_of', unnest(any_of), true FROM said UNION ALL SELECT 'class', cls, 'domain', domain, true FROM said
  UNION ALL SELECT 'class', cls, 'parent', parent, true FROM class_parents UNION ALL SELECT * FROM below){_TYPED_WALK}""")
def typed_derived_reach(spark, sf_dir):
    """Elements by kind and name that classes reach by inlined ranges, unions, domains and parents, and by types and enumerations."""
    # in the SQL a missing range is an empty text of the union
    branches = {name: F.expr(sql.replace("rng", "coalesce(`range`, '')")) for name, sql in _BRANCHES.items()}
    derived = _derived(spark, sf_dir).withColumns(branches).withColumn("inlined", F.col("multivalued"))
    return _typed(spark, sf_dir, reach.derived_uses(derived, *(_corpus(spark, sf_dir, n) for n in ("class_parents", "types", "enums"))), True)


@query(f"""{_with('class_parents', 'class_slots', 'slot_says', 'slot_parents')}, {_TYPED}, uses AS (SELECT 'class' AS src_kind, cls AS src, CASE source WHEN 'slot' THEN 'slot' ELSE 'range' END AS how, CASE source WHEN 'slot' THEN slot ELSE rng END AS name, true AS inlined FROM class_slots
  UNION ALL SELECT 'class', cls, 'parent', parent, true FROM class_parents UNION ALL SELECT 'slot', slot, 'parent', parent, true FROM slot_parents
  UNION ALL SELECT 'slot', slot, 'range', rng, true FROM slot_says UNION ALL SELECT 'slot', slot, 'domain', domain, true FROM slot_says UNION ALL SELECT * FROM below){_TYPED_WALK}""")
def typed_written_reach(spark, sf_dir):
    """The same by what elements say as written: classes, the slots they name, slots above those, types and enumerations."""
    return _typed(spark, sf_dir, reach.written_uses(*(_corpus(spark, sf_dir, n) for n in ("class_slots", "class_parents", "slot_says", "slot_parents", "types", "enums"))), False)


@query(_MERGED + " SELECT cls, count(*) AS n_slots, string_agg(slot, ',' ORDER BY slot) AS slots FROM derived GROUP BY cls")
def materialized_classes(spark, sf_dir):
    """A7."""
    return relational.materialize(_derived(spark, sf_dir)).withColumn("slots", F.array_join("slots", ","))


_FORMS = "CASE WHEN count(*) FILTER (WHERE identifier) = 0 THEN 'list' WHEN count(*) = 2 OR count(*) FILTER (WHERE required) = 2 THEN 'simple_dict' ELSE 'compact_dict' END"


@query(_MERGED + f" SELECT cls, {_FORMS} AS form FROM derived GROUP BY cls")
def collection_forms(spark, sf_dir):
    """A9."""
    return relational.collection_forms(_derived(spark, sf_dir))


@query(_MERGED + f", forms AS (SELECT cls, {_FORMS} AS form FROM derived GROUP BY cls), uses AS (SELECT concat('C', p_partkey) AS cls, concat('C', 1999 - p_partkey) AS \"range\", p_partkey % 2 = 0 AS multivalued, p_partkey % 3 = 0 AS inlined_as_list FROM part) SELECT u.cls, u.\"range\", CASE WHEN NOT u.multivalued THEN 'optional' WHEN f.form IS NULL OR u.inlined_as_list THEN 'list' ELSE f.form END AS form FROM uses u LEFT JOIN forms f ON u.\"range\" = f.cls")
def range_forms(spark, sf_dir):
    """A10: the form of a slot by that of its range."""
    k = F.col("p_partkey")
    uses = _table(spark, sf_dir, "part").select(F.concat(F.lit("C"), k).alias("cls"), F.concat(F.lit("C"), 1999 - k).alias("range"), (k % 2 == 0).alias("multivalued"), (k % 3 == 0).alias("inlined_as_list"))
    return relational.range_forms(uses, relational.collection_forms(_derived(spark, sf_dir))).select("cls", "range", "form")


@query(_MERGED + " SELECT cls, count(*) FILTER (WHERE identifier) AS n_keys FROM derived GROUP BY cls HAVING count(*) FILTER (WHERE identifier) > 1")
def multi_ids(spark, sf_dir):
    """V8."""
    return relational.multiple_keys(_derived(spark, sf_dir))


@query(_MERGED + " SELECT cls, slot, \"range\" FROM derived WHERE identifier AND (\"range\" IN (SELECT p_type FROM part) OR \"range\" LIKE 'C%')")
def bad_key_types(spark, sf_dir):
    """V8: keys whose range is no type."""
    return relational.bad_key_types(_derived(spark, sf_dir), _corpus(spark, sf_dir, "elements")).select("cls", "slot", "range")


@query(f"{_with('class_parents', 'class_slots')}, {_UP} SELECT DISTINCT cls, slot FROM class_slots u WHERE source = 'slot_usage' AND NOT EXISTS (SELECT 1 FROM anc JOIN class_slots s ON anc.ancestor = s.cls WHERE anc.cls = u.cls AND s.source <> 'slot_usage' AND s.slot = u.slot)")
def bad_slot_usage(spark, sf_dir):
    """V12."""
    return relational.bad_slot_usage(_corpus(spark, sf_dir, "class_parents"), _corpus(spark, sf_dir, "class_slots"))


@query(f"{_with('seqs')}, lists AS (SELECT slot, list(CASE WHEN p % 3 = 0 THEN CAST([] AS VARCHAR[]) WHEN p % 2 = 0 THEN [a, b] ELSE [a] END ORDER BY p) AS vs FROM seqs GROUP BY slot) SELECT slot, array_to_string(list_reduce(vs, lambda acc, x: CASE WHEN len(x) = 0 OR acc = x THEN acc ELSE list_concat(acc, x) END), ',') AS merged FROM lists")
def seq_merge(spark, sf_dir):
    """A3: lists appended in order of precedence."""
    v = F.when(F.col("p") % 3 == 0, F.array().cast("array<string>")).when(F.col("p") % 2 == 0, F.array("a", "b")).otherwise(F.array("a"))
    return _corpus(spark, sf_dir, "seqs").withColumn("v", v).groupBy("slot").agg(F.array_join(relational.appended("v"), ",").alias("merged"))


@query(f"{_with('seqs')}, entries AS (SELECT slot, p, a AS k, b AS v FROM seqs UNION ALL SELECT slot, p, 'last', a FROM seqs WHERE p % 2 = 0) SELECT slot, k AS \"key\", arg_max(v, p) AS value FROM entries GROUP BY slot, k")
def map_merge(spark, sf_dir):
    """A4: maps merged key by key, where the farthest layer wins."""
    both = F.create_map("a", "b", F.lit("last"), "a")
    layers = _corpus(spark, sf_dir, "seqs").withColumn("v", F.when(F.col("p") % 2 == 0, both).otherwise(F.create_map("a", "b")))
    return relational.merged_maps(layers, ["slot"], "v").select("slot", F.explode("v").alias("key", "value"))



# all layers of each slot in the order of the ways up; the schema's own slots last, where no class declares the slot
_LAYERS = f"""{_with('class_parents', 'layers', 'top_slots')}, ways(cls, ancestor, way) AS (
  SELECT c, c, CAST([] AS BIGINT[]) FROM (SELECT cls AS c FROM class_parents UNION SELECT parent FROM class_parents UNION SELECT cls FROM layers)
  UNION ALL SELECT w.cls, e.parent, list_append(w.way, e.ord + CASE e.kind WHEN 'is_a' THEN 100 ELSE 0 END) FROM ways w JOIN class_parents e ON w.ancestor = e.cls
), held AS (
  SELECT w.cls, slot, source, aliases, notes, title, list_append(list_append(way, -1), CASE source WHEN 'slot_usage' THEN 0 WHEN 'attribute' THEN 1 ELSE 2 END) AS p FROM ways w JOIN layers l ON l.cls = w.ancestor
), named AS (SELECT cls, slot FROM held GROUP BY cls, slot HAVING count(*) FILTER (WHERE source = 'attribute') = 0),
whole AS (
  SELECT * FROM held UNION ALL
  SELECT cls, slot, 'top', CASE WHEN ord = 0 THEN aliases END, notes, title, CAST([1000000, ord] AS BIGINT[]) FROM named JOIN top_slots USING (slot)
), owned AS (SELECT cls, slot FROM whole GROUP BY cls, slot HAVING count(*) FILTER (WHERE source IN ('attribute', 'slot')) > 0)"""


def _folded(spark, sf_dir, *wanted):
    """The wanted metaslots of the corpus's layers folded; ``notes`` stands for one that slots inherit from slots, ``aliases`` for one that they do not."""
    forms = {"aliases": F.split("aliases", ","), "notes": F.expr("str_to_map(notes, ',', '=')")}
    read = lambda name, *keys: _corpus(spark, sf_dir, name).select(*keys, *[forms.get(c, F.col(c)).alias(c) for c in wanted])
    return relational.fold_layers(_corpus(spark, sf_dir, "class_parents"), read("layers", "cls", "slot", "source"), read("top_slots", "slot", "ord"), frozenset({"notes", "title"}))


@query(f"{_LAYERS} SELECT cls, slot, array_to_string(list_reduce(list(CASE WHEN aliases IS NULL THEN CAST([] AS VARCHAR[]) ELSE split(aliases, ',') END ORDER BY p), lambda acc, x: CASE WHEN len(x) = 0 OR acc = x THEN acc ELSE acc || x END, CAST([] AS VARCHAR[])), ',') AS aliases, arg_min(title, p) FILTER (WHERE title IS NOT NULL) AS title FROM whole JOIN owned USING (cls, slot) GROUP BY cls, slot")
def derive_lists(spark, sf_dir):
    """Lists of all layers joined from the left, ancestors as often as ways lead to them."""
    return _folded(spark, sf_dir, "aliases", "title").select("cls", "slot", F.array_join("aliases", ",").alias("aliases"), "title")


@query(f"{_LAYERS}, entries AS (SELECT cls, slot, p, unnest(split(notes, ',')) AS e FROM whole JOIN owned USING (cls, slot) WHERE notes IS NOT NULL) SELECT cls, slot, split_part(e, '=', 1) AS key, arg_max(split_part(e, '=', 2), p) AS value FROM entries GROUP BY ALL")
def derive_maps(spark, sf_dir):
    """Maps of all layers, where the farthest layer with a key counts, by its last place."""
    return _folded(spark, sf_dir, "notes").select("cls", "slot", F.explode("notes").alias("key", "value"))


@query(f"{_with('elements')} SELECT name, kind, schema_ord, uri FROM elements QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY schema_ord DESC) = 1")
def element_index(spark, sf_dir):
    """P1, P3, P4."""
    return relational.index(_corpus(spark, sf_dir, "elements"))


@query(f"{_with('elements')}, one AS (SELECT * FROM elements QUALIFY row_number() OVER (PARTITION BY kind, name ORDER BY schema_ord DESC) = 1) SELECT name, kind, schema_ord, uri FROM one QUALIFY row_number() OVER (PARTITION BY name ORDER BY list_position(['class', 'type', 'enum', 'slot', 'subset'], kind)) = 1")
def global_index(spark, sf_dir):
    """P2, U1."""
    return relational.global_index(_corpus(spark, sf_dir, "elements"))


@query(f"{_with('elements', 'refs')} SELECT path, value, expected_kind, EXISTS (SELECT 1 FROM elements WHERE name = value AND kind = expected_kind) AS found FROM refs")
def resolve_references(spark, sf_dir):
    """P3."""
    return relational.resolve(_corpus(spark, sf_dir, "refs"), _corpus(spark, sf_dir, "elements"))


@query(f"{_with('elements', 'refs')} SELECT path, value, expected_kind FROM refs WHERE NOT EXISTS (SELECT 1 FROM elements WHERE name = value AND kind = expected_kind)")
def unknown_refs(spark, sf_dir):
    """V1."""
    return relational.unknown_references(_corpus(spark, sf_dir, "refs"), _corpus(spark, sf_dir, "elements"))


@query(f"{_with('elements', 'refs')}, known AS (SELECT name, bool_or(kind IN ('class', 'type', 'enum')) AS as_range, bool_or(kind = 'class') AS as_class FROM elements GROUP BY name), judged AS (SELECT path, value, CASE WHEN value = 'string' AND name IS NULL THEN 'UnknownStringReference' WHEN name IS NULL THEN 'UnknownReference' WHEN expected_kind = 'range' AND NOT as_range THEN 'InvalidRange' WHEN expected_kind = 'class' AND NOT as_class THEN 'UnknownReference' END AS issue FROM refs LEFT JOIN known ON name = value) SELECT path, value, issue FROM judged WHERE issue IS NOT NULL")
def reference_issues(spark, sf_dir):
    """V1, V2, V3: which problem each bad reference is."""
    return relational.reference_issues(_corpus(spark, sf_dir, "refs"), _corpus(spark, sf_dir, "elements"))


@query(f"{_with('elements')} SELECT CASE WHEN kind IN ('class', 'type', 'enum') THEN 'named' ELSE kind END AS space, name, count(*) AS n FROM elements GROUP BY ALL HAVING count(*) > 1")
def nonunique_names(spark, sf_dir):
    """V9."""
    return relational.nonunique_names(_corpus(spark, sf_dir, "elements"))


@query(f"{_with('used', 'prefixes')} SELECT prefix FROM used WHERE prefix NOT IN (SELECT prefix FROM prefixes)")
def undefined_prefixes(spark, sf_dir):
    """V10."""
    return relational.undefined_prefixes(_corpus(spark, sf_dir, "used"), _corpus(spark, sf_dir, "prefixes"))


@query(f"{_with('curies', 'prefixes')} SELECT curie, CASE WHEN strpos(curie, '://') > 0 OR starts_with(curie, 'urn:') OR strpos(curie, ':') = 0 THEN curie ELSE CASE WHEN right(namespace, 1) IN ('/', '#', '?') THEN namespace ELSE namespace || '/' END || substr(curie, strpos(curie, ':') + 1) END AS uri FROM curies LEFT JOIN prefixes ON split_part(curie, ':', 1) = prefix")
def expand_table(spark, sf_dir):
    """P9, P10 by a prefix table."""
    return relational.expand_curies(_corpus(spark, sf_dir, "curies"), _corpus(spark, sf_dir, "prefixes"))


@query(f"{_with('elements')} SELECT uri, count(*) AS n, min(name) AS first_name, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM elements GROUP BY uri")
def rdfs_groups(spark, sf_dir):
    """Elements that share a URI."""
    return relational.uri_groups(_corpus(spark, sf_dir, "elements"))


@query(f"{_with('issues')} SELECT severity, CAST(list_position(['fatal', 'error', 'warning'], severity) - 1 AS INTEGER) AS ordinal, count(*) AS n FROM issues GROUP BY severity")
def issue_summary(spark, sf_dir):
    """A12, V16."""
    return relational.issue_summary(_corpus(spark, sf_dir, "issues"))


@query("SELECT p_brand AS grp, p_name || p_partkey AS name, row_number() OVER (PARTITION BY p_brand ORDER BY CASE p_partkey % 40 WHEN 3 THEN -2 WHEN 5 THEN -1 ELSE CASE WHEN p_size % 4 = 0 THEN 10000 ELSE p_size END END, p_name || p_partkey) - 1 AS pos FROM part")
def slot_order(spark, sf_dir):
    """O2: by rank and name; a missing rank is late, the key and the value come first."""
    k = F.col("p_partkey") % 40
    slots = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.concat("p_name", "p_partkey").alias("name"), F.when(F.col("p_size") % 4 != 0, F.col("p_size")).alias("rank"), (k == 3).alias("is_key"), (k == 5).alias("is_value"))
    return relational.slot_order(slots, ["grp"]).select("grp", "name", F.col("pos").cast("long").alias("pos"))


# -- generators of the tables' model against the tables' own columns

_CLASSES = {"Region": "region", "Nation": "nation", "Customer": "customer", "Supplier": "supplier", "Part": "part", "Order": "orders", "LineItem": "lineitem", "Event": "events", "Page": "pages", "Turn": "conversations"}
_KEYS = "('r_regionkey', 'n_nationkey', 'c_custkey', 's_suppkey', 'p_partkey', 'o_orderkey', 'event_id', 'page_id')"
_COLUMNS = "WITH named(cls, tbl) AS (VALUES " + ", ".join(f"('{c}', '{t}')" for c, t in _CLASSES.items()) + "), cols AS (SELECT DISTINCT cls, column_name AS name, data_type AS type, ordinal_position AS pos FROM named JOIN information_schema.columns ON tbl = table_name)"


_REFS = "refs(name, target) AS (VALUES ('n_regionkey', 'Region'), ('c_nationkey', 'Nation'), ('s_nationkey', 'Nation'), ('o_custkey', 'Customer'), ('l_orderkey', 'Order'), ('l_partkey', 'Part'), ('l_suppkey', 'Supplier'))"
_ENUMS = "('c_mktsegment', 'p_type', 'o_orderstatus', 'l_returnflag', 'l_linestatus', 'event_type', 'role')"


def _sql_type(**named: str) -> str:
    return f"CASE WHEN type IN ('BIGINT', 'INTEGER') THEN '{named['integer']}' WHEN type = 'DOUBLE' THEN '{named['double']}' WHEN type LIKE 'TIMESTAMP%' THEN '{named['time']}' ELSE '{named['text']}' END"


def _gathered(spark, rows: list[tuple], columns: str):
    return spark.createDataFrame(rows, columns)


@query(f"{_COLUMNS} SELECT row_number() OVER (ORDER BY name = 'l_linenumber', name) - 1 AS pos, name, {_sql_type(integer='integer', double='number', time='datetime', text='string')} AS type FROM cols WHERE cls = 'LineItem'")
def table_fields(spark, sf_dir):
    """Fields of a table schema, by rank and name."""
    fields = render.table_schema(tables_catalog())["fields"]
    return _gathered(spark, [(i, f["name"], f["type"]) for i, f in enumerate(fields)], "pos long, name string, type string")


@query(f"{_COLUMNS} SELECT cls, name, {_sql_type(integer='integer', double='number', time='string', text='string')} AS type FROM cols")
def json_schema_types(spark, sf_dir):
    """Properties of the JSON Schema of each class and their types."""
    rows = []
    for cls in _CLASSES:
        defs = render.json_schema(tables_catalog(), tree_root=cls)["$defs"]
        for name, body in defs[cls]["properties"].items():
            rows.append((cls, name, (defs[body["$ref"].rsplit("/", 1)[1]] if "$ref" in body else body)["type"]))
    return _gathered(spark, rows, "cls string, name string, type string")


@query(f"{_COLUMNS} SELECT cls, name, {_sql_type(integer='bigint', double='double', time='timestamp', text='string')} AS type, row_number() OVER (PARTITION BY cls ORDER BY pos) - 1 AS pos FROM cols WHERE cls <> 'LineItem'")
def spark_types(spark, sf_dir):
    """Each class as a Spark schema, its columns in order."""
    rows = [(cls, f.name, f.dataType.simpleString(), i) for cls in _CLASSES if cls != "LineItem" for i, f in enumerate(render.struct_type(tables_catalog(), cls).fields)]
    return _gathered(spark, rows, "cls string, name string, type string, pos long")


@query(f"{_COLUMNS} SELECT cls, name, name IN {_KEYS} AS is_key FROM cols")
def graphql_fields(spark, sf_dir):
    """Fields of the GraphQL types; a key is never null."""
    rows, cls = [], None
    for line in render.graphql(tables_catalog()).split("\n"):
        head, body = re.match(r"type (\w+)", line), re.match(r"  (\w+): (\w+!?)", line)
        cls = head[1] if head else None if line == "}" else cls
        if body and cls in _CLASSES:
            rows.append((cls, body[1], body[2] == "Int!"))
    return _gathered(spark, rows, "cls string, name string, is_key boolean")


@query(f"{_COLUMNS}, {_REFS} SELECT cls, c.name, target AS edge_to, c.name IN {_KEYS} AND target IS NULL AS is_key FROM cols c LEFT JOIN refs r ON c.name = r.name AND cls <> target")
def er_diagram_rows(spark, sf_dir):
    """Attributes and edges of the ER diagram."""
    rows, cls = [], None
    for line in render.er_diagram(tables_catalog()).split("\n"):
        head, body, edge = re.match(r"  (\w+) \{", line), re.match(r"    (\w+)\?? (\w+)( PK)?$", line), re.match(r'  (\w+) \S+ (\w+) : "(\w+)"', line)
        cls = head[1] if head else cls
        if body and cls in _CLASSES:
            rows.append((cls, body[2], None, body[3] is not None))
        elif edge:
            rows.append((edge[1], edge[3], edge[2], False))
    return _gathered(spark, rows, "cls string, name string, edge_to string, is_key boolean")


@query(f"{_COLUMNS} SELECT name, string_agg(cls, ',' ORDER BY cls) AS domains FROM cols WHERE NOT (name IN {_KEYS} AND pos = 1) GROUP BY name")
def rdfs_domains(spark, sf_dir):
    """Properties of the RDFS vocabulary with the classes they belong to."""
    triples = rdf.to_frame(spark, rdf.rdfs(tables_catalog()))
    local = lambda c: F.element_at(F.split(c, "/"), -1)
    found = triples.filter(F.col("p") == rdf.RDFS + "domain").select(local("s").alias("name"), local("o").alias("cls"))
    return found.filter(F.col("cls").isin(list(_CLASSES))).groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("cls")), ",").alias("domains"))


@query(f"{_COLUMNS} SELECT cls, name, row_number() OVER (PARTITION BY cls ORDER BY pos) - 1 AS ord FROM cols WHERE NOT (name IN {_KEYS} AND pos = 1) AND cls <> 'LineItem'")
def shape_orders(spark, sf_dir):
    """The properties of each SHACL shape, numbered without the key."""
    triples = rdf.to_frame(spark, rdf.shacl(tables_catalog()))
    shapes = triples.filter(F.col("p") == rdf.SH + "property").select(F.element_at(F.split("s", "/"), -1).alias("cls"), F.col("o").alias("s"))
    of = lambda p, name: triples.filter(F.col("p") == rdf.SH + p).select("s", F.element_at(F.split("o", "/"), -1).alias(name))
    found = shapes.join(of("path", "name"), "s").join(of("order", "ord"), "s")
    return found.filter(F.col("cls").isin([c for c in _CLASSES if c != "LineItem"])).select("cls", "name", F.col("ord").cast("long").alias("ord"))


@query(f"{_COLUMNS}, {_REFS} SELECT cls, c.name AS slot, CASE WHEN target IS NOT NULL THEN 'https://example.org/tables/' || target ELSE 'http://www.w3.org/2001/XMLSchema#' || {_sql_type(integer='integer', double='double', time='dateTime', text='string')} END AS \"range\" FROM cols c LEFT JOIN refs r ON c.name = r.name AND cls <> target WHERE c.name NOT IN {_ENUMS} AND NOT (c.name IN {_KEYS} AND pos = 1 AND cls <> 'LineItem')")
def shape_ranges(spark, sf_dir):
    """What the shape of each class says of its slots' ranges."""
    triples = rdf.to_frame(spark, rdf.shacl(tables_catalog()))
    local = lambda c: F.element_at(F.split(c, "/"), -1)
    shapes = triples.filter(F.col("p") == rdf.SH + "property").select(local("s").alias("cls"), F.col("o").alias("s")).filter(F.col("cls").isin(list(_CLASSES)))
    held = triples.join(shapes.select("s"), "s", "left_semi")
    paths = held.filter(F.col("p") == rdf.SH + "path").select("s", local("o").alias("slot"))
    ranges = held.filter(F.col("p").isin(rdf.SH + "datatype", rdf.SH + "class")).select("s", F.col("o").alias("range"))
    return shapes.join(paths, "s").join(ranges, "s").select("cls", "slot", "range")
