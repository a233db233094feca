import pytest

from typeloom import api
from typeloom.operators import infer, validate
from typeloom.sources import instances
from typeloom.streaming import validate as streaming

MODEL = """
id: https://e.org/s
name: s
imports: [linkml:types]
default_range: string
prefixes: {ex: https://e.org/x/}
enums: {E: {permissible_values: {a: {}, b c: {}}}}
classes:
  In: {attributes: {x: {}}}
  R:
    attributes:
      id: {identifier: true}
      n: {range: integer, maximum_value: 5}
      o: {range: In}
      e: {range: E, ifabsent: E(b c)}
      label: {equals_expression: 'no. {n} of {o.x}'}
      chained: {equals_expression: '<{label}>'}
      many: {multivalued: true, equals_expression: '{n}'}
      ref: {implicit_prefix: ex}
"""
DDL = "id string, n long, o struct<x:string>, e string, label string, chained string, many array<string>, ref string"


@pytest.fixture(scope="module")
def schema():
    return api.load_string(MODEL)


def test_inference(spark, schema):
    df = spark.createDataFrame([("1", 2, ("q",), None, None, "<given>", None, "z"), ("2", 3, ("r",), "a", "given", None, None, None)], DDL)
    got = {r["id"]: r for r in infer.inferred(df, schema.catalog, "R", strict=False).collect()}
    assert got["1"]["label"] == "no. 2 of q" and got["1"]["many"] is None
    assert got["2"]["label"] is None and got["2"]["chained"] == "<given>"  # reads the given label, not the computed one
    found = infer.conflicts(df, schema.catalog, "R", ["id"]).collect()
    assert [(r["id"], r["slot"]) for r in found] == [("2", "label")]
    with pytest.raises(Exception, match="differs"):
        infer.inferred(df.filter("id = '2'"), schema.catalog, "R").collect()
    assert [r["e"] for r in infer.with_defaults(df, schema.catalog, "R").orderBy("id").collect()] == ["b c", "a"]
    assert [r["ref"] for r in infer.implicit_iris(df, schema.catalog, "R").orderBy("id").collect()] == ["https://e.org/x/z", None]


def test_csv_and_json_instances(spark, schema, tmp_path):
    (tmp_path / "a.csv").write_text('id,n,many\n1,3,"[""a"",""b""]"\n2,x,\n3,9,"[]"\n')
    df = instances.read_csv(spark, str(tmp_path / "a.csv"), schema.catalog, "R")
    assert {(r["id"], r["slot"], r["constraint"]) for r in schema.validate(df, "R", ["id"]).collect()} == {("2", "n", "type"), ("3", "n", "maximum")}
    assert [r["n"] for r in instances.typed(df, schema.catalog, "R").orderBy("id").collect()] == [3, None, 9]
    (tmp_path / "a.json").write_text('{"id": "1", "n": 2}\n\n{"id": "1", "n": "2"}\n')
    rows = instances.read_json(spark, str(tmp_path / "a.json"))
    assert sorted(r["v"] for r in rows.select(validate.json_valid(rows["json"], schema.catalog, "R").alias("v")).collect()) == [False, True]


def test_windows_and_unique_keys_on_streams(spark, schema, tmp_path):
    ddl = "id string, n long, ts timestamp"
    spark.sql("SELECT '1' AS id, 9L AS n, TIMESTAMP '2024-01-01 00:00:10' AS ts UNION ALL SELECT '1', 9, TIMESTAMP '2024-01-01 00:00:50' UNION ALL SELECT '2', 1, TIMESTAMP '2024-01-01 00:05:00'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
    for name, df, mode in (("w", streaming.windowed_report(stream, schema.catalog, "R", "ts", "1 minute", "30 seconds"), "complete"), ("u", streaming.unique_rows(stream, ["id"], "ts", "10 minutes"), "append")):
        run = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).start()
        run.processAllAvailable()
        run.stop()
    assert [(r["slot"], r["constraint"], r["n_invalid"]) for r in spark.sql("SELECT * FROM w").collect()] == [("n", "maximum", 2)]
    assert spark.sql("SELECT count(*) FROM u").first()[0] == 2
