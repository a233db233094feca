"""The model of the benchmark tables, as a schema of this library's own language."""

from __future__ import annotations

import functools

from typeloom.operators.lint import loaded
from typeloom.plans.catalog import Catalog

# JSON, which is YAML too, so it loads with or without a YAML library.
MODEL = """
{"id": "https://example.org/tables", "name": "tables", "imports": ["linkml:types"], "default_range": "string", "default_prefix": "t",
 "prefixes": {"t": "https://example.org/tables/", "ex": "https://example.org/item/"},
 "enums": {
  "Segment": {"permissible_values": {"MACHINERY": {}, "FURNITURE": {}, "BUILDING": {}, "AUTOMOBILE": {}, "HOUSEHOLD": {}}},
  "PartType": {"permissible_values": {"MEDIUM": {}, "STANDARD": {}, "LARGE": {}, "PROMO": {}, "SMALL": {}, "ECONOMY": {}}},
  "OrderStatus": {"permissible_values": {"P": {}, "O": {}, "F": {}}},
  "ReturnFlag": {"permissible_values": {"R": {}, "A": {}, "N": {}}},
  "LineStatus": {"permissible_values": {"O": {"meaning": "ex:open"}, "F": {"meaning": "ex:filled"}}},
  "EventType": {"permissible_values": {"signup": {}, "error": {}, "click": {}, "view": {}, "purchase": {}}},
  "MainLang": {"permissible_values": {"en": {"meaning": "ex:en"}, "fr": {"meaning": "ex:fr"}}},
  "Speaker": {"permissible_values": {"user": {}, "assistant": {}}}},
 "classes": {
  "Region": {"attributes": {"r_regionkey": {"range": "integer", "identifier": true}, "r_name": {"required": true}}},
  "Nation": {"attributes": {"n_nationkey": {"range": "integer", "identifier": true}, "n_name": {"required": true}, "n_regionkey": {"range": "Region"}}},
  "Party": {"abstract": true, "attributes": {"name": {"required": true}}},
  "Customer": {"attributes": {"c_custkey": {"range": "integer", "identifier": true}, "c_name": {"required": true, "pattern": "^Customer#[0-9]{9}$"}, "c_nationkey": {"range": "Nation"}, "c_acctbal": {"range": "double", "minimum_value": 0}, "c_mktsegment": {"range": "Segment"}}},
  "Supplier": {"attributes": {"s_suppkey": {"range": "integer", "identifier": true}, "s_name": {}, "s_nationkey": {"range": "Nation"}, "s_acctbal": {"range": "double"}}},
  "Part": {"attributes": {"p_partkey": {"range": "integer", "identifier": true}, "p_name": {}, "p_brand": {"pattern": "^Brand#[0-9]$"}, "p_type": {"range": "PartType"}, "p_size": {"range": "integer", "minimum_value": 1, "maximum_value": 40}, "p_retailprice": {"range": "double"}}},
  "Order": {"attributes": {"o_orderkey": {"range": "integer", "identifier": true}, "o_custkey": {"range": "Customer"}, "o_orderstatus": {"range": "OrderStatus"}, "o_totalprice": {"range": "double", "maximum_value": 400000}, "o_orderdate": {"range": "datetime"}, "o_orderpriority": {"required": true}}},
  "LineItem": {"tree_root": true, "attributes": {
    "l_orderkey": {"range": "Order", "required": true}, "l_partkey": {"range": "Part"}, "l_suppkey": {"range": "Supplier"}, "l_linenumber": {"range": "integer", "rank": 1},
    "l_quantity": {"range": "double", "minimum_value": 2, "maximum_value": 49}, "l_extendedprice": {"range": "double"}, "l_discount": {"range": "double", "minimum_value": 0, "maximum_value": 0.09},
    "l_tax": {"range": "double", "minimum_value": 0, "maximum_value": 0.07}, "l_returnflag": {"range": "ReturnFlag", "required": true}, "l_linestatus": {"range": "LineStatus"}, "l_shipdate": {"range": "datetime"}}},
  "Event": {"attributes": {"event_id": {"range": "integer", "identifier": true}, "ts": {"range": "datetime"}, "user_id": {"range": "integer"}, "event_type": {"range": "EventType", "ifabsent": "EventType(view)"}, "value": {"range": "double", "minimum_value": 1}, "props": {}}},
  "Page": {"attributes": {"page_id": {"range": "integer", "identifier": true}, "url": {"pattern": "^https?://[^#]*$"}, "html": {}}},
  "Turn": {"attributes": {"conv_id": {"range": "integer"}, "turn": {"range": "integer"}, "role": {"range": "Speaker"}, "text": {"required": true}}},
  "Article": {"attributes": {"article_id": {"range": "integer", "identifier": true}, "lang": {"range": "MainLang"}, "source": {"required": true}, "n_chars": {"range": "integer", "minimum_value": 100}}}}}
"""


@functools.cache
def tables_catalog() -> Catalog:
    return loaded(text=MODEL)
