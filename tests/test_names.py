import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from typeloom.functions import expressions, names


@pytest.mark.parametrize("raw, snake, pascal, camel", [
    ("", "", "", ""), ("order line", "order_line", "OrderLine", "orderLine"), ("OrderLine", "order_line", "OrderLine", "orderLine"),
    ("order_line_2", "order_line2", "OrderLine2", "orderLine2"), ("XMLParser", "xml_parser", "XmlParser", "xmlParser"), ("XML", "xml", "Xml", "xml"),
    ("aField", "a_field", "AField", "aField"), ("NET-VALUE", "net_value", "NetValue", "netValue"),
])
def test_cases(raw, snake, pascal, camel):
    assert (names.snake_case(raw), names.pascal_case(raw), names.camel_case(raw)) == (snake, pascal, camel)


def test_uri_encoding():
    assert names.uri_encode("a b/ü~*") == "a+b%2F%C3%BC%7E*"


def test_expand_and_compact():
    known = {"ex": "https://e.org/x", "h": "https://e.org/h#"}
    assert names.expand("ex:1", known) == "https://e.org/x/1"
    assert names.expand("h:1", known) == "https://e.org/h#1"
    assert names.expand("plain", known) == "plain" and names.expand("urn:a:b", known) == "urn:a:b"
    with pytest.raises(names.UnknownPrefix):
        names.expand("zz:1", known)
    assert names.compact("https://e.org/h#a", known) == "h:a" and names.compact("https://e.org/x/1", known) == "ex:1"
    assert names.compact("https://other/1", known) is None


@given(st.text())
def test_ntriples_is_ascii_and_reversible(text):
    escaped = names.ntriples_escape(text)
    assert escaped.isascii() and "\n" not in escaped
    assert escaped.encode().decode("unicode_escape") == text or any(0xD800 <= ord(c) < 0xE000 for c in text)


def test_columns_follow_the_driver(spark):
    raw = ["order line", "OrderLine", "order_line_2", "XMLParser", "a-b", "aField", "x"]
    df = spark.createDataFrame([(r,) for r in raw], "n string").select("n", names.snake_case_col("n" and df_col("n")).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == {r: names.snake_case(r) for r in raw}


def df_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


@pytest.mark.parametrize("text, parts", [
    ("", []), ("a", ["a"]), ("{x}", [expressions.Path(("x",))]), ("a{x.y}b", ["a", expressions.Path(("x", "y")), "b"]), ("{{a}}", ["{a}"]), ("{{{x}}}", ["{", expressions.Path(("x",)), "}"]),
])
def test_interpolation_parts(text, parts):
    assert expressions.parse_interpolation(text) == parts


@pytest.mark.parametrize("text", ["{", "}", "{}", "{a", "{a.}", "a}b"])
def test_bad_interpolation(text):
    with pytest.raises(expressions.ExpressionError):
        expressions.parse_interpolation(text)


def test_constructor():
    assert expressions.parse_constructor("Kind(a b)", "Kind", ["a b"]) == "a b"
    for text in ("Kind", "Other(a b)", "Kind(z)"):
        with pytest.raises(expressions.ExpressionError):
            expressions.parse_constructor(text, "Kind", ["a b"])


def test_interpolate_and_infer(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, "a", [1, 2]), (2, "b", None)], "i int, s string, l array<int>")
    got = df.select(expressions.interpolate(df, "{i}-{s}: {l}", strict=False).alias("x")).collect()
    assert [r["x"] for r in got] == ["1-a: 1, 2", None]
    with pytest.raises(Exception, match="has no value"):
        df.select(expressions.interpolate(df, "{l}")).collect()
    with pytest.raises(expressions.ExpressionError):
        expressions.interpolate(df, "{nothing}")
    filled = df.select(expressions.infer_optional(F.when(F.col("i") == 1, F.lit("a")), F.col("s")).alias("x"))
    assert [r["x"] for r in filled.collect()] == ["a", "b"]
    with pytest.raises(Exception, match="differs"):
        df.select(expressions.infer_optional(F.lit("z"), F.col("s"))).collect()


def test_strings_of_few_and_of_many_kinds_of_odd_characters(spark):
    many = "".join(chr(c) for c in range(0x3B1, 0x3B1 + 70)) + "\U0001F600\x07"
    texts = ['é\U0001F600é"\\\n\t\x7f\u00e9', "\\u00E9 é", many, many[:60] + "\\", "plain", ""]
    column = names.ntriples_string(F.col("t"))
    found = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(column).collect()]
    assert found == [names.ntriples_escape(t) for t in texts]
    assert "array_distinct" in str(column)
