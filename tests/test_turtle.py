"""Turtle read in ranges of any size and written by ranges of subjects."""

import pytest
from pyspark.sql import functions as F

from typeloom.operators import rdf
from typeloom.sources import instances, turtle

HEAD = """@prefix e: <http://e.org/> . # a comment . with a dot
e:a e:p "x.y" , '''long . "q" @prefix e: <http://wrong/> .
 e:not e:a e:statement .
''' ; a e:C ; e:n 1.5 , .5, -2 , 1e3, true ; .
PREFIX
  f: <http://f.org/>
f:b.c e:p [ e:q ( 1 ( ) ) ; e:r [] ], "it\\u00e9"@en-GB, "7"^^e:int.
[ e:x <rel> ] . <http://x/a.b> e:p _:l.m .
"""
XSD = turtle.XSD
E = "http://e.org/"


def table(spark, path, **kwargs):
    return [tuple(r) for r in turtle.turtle_table(spark, path, **kwargs).collect()]


@pytest.fixture
def sized(spark):
    """Sets the size of the ranges of files."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_every_form_at_every_size_of_range(spark, tmp_path, sized, size):
    (tmp_path / "a.ttl").write_text(HEAD)
    sized(size)
    found = table(spark, str(tmp_path), base="http://base/z#f")
    assert not [r for r in found if r[8]]
    plain = [(r[0], r[2].rpartition("/")[2], r[3], r[5], r[6]) for r in found if r[1] == "iri" and r[4] != "blank"]
    typed = lambda v, t: (E + "a", "n", v, XSD + t, None)
    assert sorted(plain, key=repr) == sorted(
        [
            (E + "a", "p", "x.y", None, None),
            (E + "a", "p", 'long . "q" @prefix e: <http://wrong/> .\n e:not e:a e:statement .\n', None, None),
            (E + "a", "22-rdf-syntax-ns#type", E + "C", None, None),
            typed("1.5", "decimal"),
            typed(".5", "decimal"),
            typed("-2", "integer"),
            typed("1e3", "double"),
            typed("true", "boolean"),
            ("http://f.org/b.c", "p", "ité", None, "en-GB"),
            ("http://f.org/b.c", "p", "7", E + "int", None),
        ],
        key=repr,
    )
    by = {(r[0], r[2]): r[3] for r in found}
    inner = by["http://f.org/b.c", E + "p"] if (by["http://f.org/b.c", E + "p"], E + "q") in by else next(r[3] for r in found if r[0] == "http://f.org/b.c" and r[4] == "blank")
    first = by[inner, E + "q"]
    second = by[first, turtle.RDF + "rest"]
    assert by[first, turtle.RDF + "first"] == "1" and by[second, turtle.RDF + "first"] == turtle.RDF + "nil" == by[second, turtle.RDF + "rest"]
    assert (inner, E + "r") in by and "http://base/rel" in by.values() and by["http://x/a.b", E + "p"] == "l.m"


def test_bad_statements_are_rows_with_a_reason_and_take_no_other_along(spark, tmp_path, sized):
    bad = {
        'e:a e:p "open .': "syntax",
        "e:a e:p .": "syntax",
        "e:a e:p e:b ,.": "syntax",
        "e:a e:p ( e:b .": "syntax",
        "e:a e:p e:b ] .": "syntax",
        '"s" e:p e:b .': "syntax",
        "e:a _:p e:b .": "prefix",
        "g:a e:p e:b .": "prefix",
        'e:a e:p "\\q" .': "escape",
        'e:a e:p "\\uD800" .': "character",
        "e:a e:p <rel> .": "base",
        "@prefix g <http://g/> .": "syntax",
        "e:a e:p [ ] . .": "syntax",
    }
    (tmp_path / "a.ttl").write_text("@prefix e: <http://e.org/> .\n" + "".join(f"{b}\ne:ok{i} e:p e:b .\n" for i, b in enumerate(bad)) + "e:z e:p e:b")
    for size in (60, 1 << 20):
        sized(size)
        found = table(spark, str(tmp_path))
        assert {r[0] for r in found if r[0] and "ok" in r[0]} == {f"{E}ok{i}" for i in range(len(bad))}
        faults = {(r[7], r[8]) for r in found if r[8]}
        # the lone dot is a statement of its own
        assert faults == {(b if b != "e:a e:p [ ] . ." else ".", why) for b, why in bad.items()} | {("e:z e:p e:b", "syntax")}


def test_directives_hold_from_where_they_stand(spark, tmp_path, sized):
    text = "".join(f"@prefix e: <http://{i}/> .\n" * (i % 3 == 0) + f"e:a <http://p> {i} .\n" for i in range(60))
    (tmp_path / "a.ttl").write_text(text)
    (tmp_path / "b.ttl").write_text("BASE <http://b/x/>\nPREFIX e: <y/>\ne:a <http://p> 100 .\nBASE <../z/>\nPREFIX e: <w>\ne:a <http://p> 101 .\n")
    for size in (90, 1 << 20):
        sized(size)
        found = {int(r[3]): r[0] for r in table(spark, str(tmp_path))}
        assert found == {i: f"http://{i - i % 3}/a" for i in range(60)} | {100: "http://b/x/y/a", 101: "http://b/z/wa"}


def test_deep_nesting_and_empty_files(spark, tmp_path):
    (tmp_path / "a.ttl").write_text("<http://a> <http://p> " + "[ <http://p> " * 5000 + "1" + "]" * 5000 + " .")
    (tmp_path / "b.ttl").write_text("")
    (tmp_path / "c.ttl").write_text("# nothing\n\n")
    assert len(table(spark, str(tmp_path))) == 5001


def test_labels_by_file(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.ttl").write_text("_:x <http://p> _:x . [] <http://p> 1 .")
    assert len({r[0] for r in table(spark, str(tmp_path))}) == 3
    scoped = table(spark, str(tmp_path), by_file=True)
    assert len({r[0] for r in scoped}) == 4 and all(r[0] == r[3] for r in scoped if r[4] == "blank")


def test_rows_of_statements_stay_small(spark, tmp_path, monkeypatch):
    kept = []

    def staged(df, label):
        kept.append(before(df, label))
        return kept[-1]

    before = turtle.staged
    monkeypatch.setattr(turtle, "staged", staged)
    for spaces in (1, 300):
        kept.clear()
        head = "".join(f"@prefix p{i}: <http://e.org/{i}/> .\n" for i in range(spaces))
        (tmp_path / f"{spaces}.ttl").write_text(head + "".join(f"p{i % spaces}:a <http://p> {i} .\n" for i in range(20_000)))
        found = table(spark, str(tmp_path / f"{spaces}.ttl"))
        assert sorted((int(r[3]), r[0]) for r in found) == [(i, f"http://e.org/{i % spaces}/a") for i in range(20_000)]
        # 10,000 rows, as many as a batch may have, take a worker little; directives take no more than the statements
        text, told, longest = kept[-1][0].filter("text IS NOT NULL").select(F.sum(F.length("text")), F.sum(F.length("before")), F.max(F.length("text"))).first()
        assert longest < 5000 if spaces == 1 else told < 2 * text


@pytest.mark.parametrize("n,size", [(turtle.ROWS * 2 + 1, 1), (5, turtle.TEXT)])
def test_batches_are_bounded(n, size):
    texts = [("x" * size, [("a", None)] * n), ("y", [("b", "c")]), ("z", [])]
    batches = list(turtle._batches(texts, "s string, o string"))
    assert [b.num_rows for b in batches] == ([turtle.ROWS, turtle.ROWS, 1, 1] if size == 1 else [5, 1])
    assert batches[-1].to_pylist() == [{"s": "b", "o": "c"}] and batches[0].schema.names == ["s", "o"]


def test_written_turtle_gives_the_same_triples(spark, tmp_path, sized, monkeypatch):
    monkeypatch.setattr(rdf, "STATEMENT", 7)
    rows = [(f"http://e.org/s{i % 9}", "iri", f"http://e.org/p/{i % 4}", f"v\"\\\n\té{i}", "literal", None, "en" if i % 5 == 0 else None) for i in range(120)]
    rows += [("hub", "blank", "http://e.org/p/1", f"http://e.org/x y/{i}" if i % 2 else f"http://e.org/p/n-{i}", "iri", None, None) for i in range(200)]
    rows += [("http://e.org/", "iri", rdf.RDF + "type", "hub", "blank", None, None), ("http://o", "iri", "http://o#p", "5", "literal", XSD + "integer", None)] * 2
    rows += [("http://o", "iri", "http://p", None, "iri", None, None)]
    triples = spark.createDataFrame(rows, rdf.TRIPLES + ", o_lang string").repartition(5)
    path = str(tmp_path / "t")
    rdf.write_turtle(triples, path, [("e", "http://e.org/"), ("ep", "http://e.org/p/"), ("xsd", XSD)])
    text = "".join(r[0] + "\n" for r in spark.read.text(path).collect())
    assert "ep:n-0" in text and "e:s1" in text and "xsd:integer" in text and " a _:hub" in text and "<http://e.org/x\\u0020y/1>" in text
    for size in (900, 1 << 20):
        sized(size)
        assert sorted((r[:7] for r in table(spark, path)), key=repr) == sorted((r for r in rows if r[3] is not None), key=repr)
    rdf.write_turtle(triples.filter("false"), path, [])
    assert table(spark, path) == []


def test_as_n_triples_read(spark, tmp_path, sized, small):
    nation = spark.read.parquet(f"{small}/customer.parquet")
    triples = nation.select(F.concat(F.lit("http://e.org/c/"), "c_custkey").alias("s"), F.lit("iri").alias("s_kind"), F.lit("http://e.org/name").alias("p"), F.concat("c_name", F.lit(' """ \'\'\' .')).alias("o"), F.lit("literal").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))
    rdf.write_ntriples(triples, str(tmp_path / "n"))
    sized(3000)
    one, other = turtle.read_turtle(spark, str(tmp_path / "n")), instances.read_ntriples(spark, str(tmp_path / "n"))
    assert one.count() == triples.count() and one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()
