"""N-Triples of any form, and keys of a stream over several batches."""

import datetime

import pytest

from typeloom.sources import instances
from typeloom.streaming import validate as streaming

LINES = [
    ("<http://e.org/s> <http://e.org/p> <http://e.org/o> .", ("http://e.org/s", "iri", "http://e.org/p", "http://e.org/o", "iri", None, None)),
    ('_:b1 <http://e.org/p> "" .', ("b1", "blank", "http://e.org/p", "", "literal", None, None)),
    ('_:b1 <http://e.org/p> "a\\tb\\\\n\\"\\u00E9\\U0001F600" . # told', ("b1", "blank", "http://e.org/p", 'a\tb\\n"é\U0001F600', "literal", None, None)),
    ('<http://e.org/\\u00e9> <http://e.org/p> "x"^^<http://e.org/t> .', ("http://e.org/é", "iri", "http://e.org/p", "x", "literal", "http://e.org/t", None)),
    ('<http://e.org/s><http://e.org/p>"x"@en-GB.', ("http://e.org/s", "iri", "http://e.org/p", "x", "literal", None, "en-GB")),
    ("<http://e.org/s> <http://e.org/p> _:b.2 .", ("http://e.org/s", "iri", "http://e.org/p", "b.2", "blank", None, None)),
    ('<http://e.org/s> <http://e.org/p> "é . \\\\" .', ("http://e.org/s", "iri", "http://e.org/p", "é . \\", "literal", None, None)),
    ("", None),
    ("  # only told", None),
    ("<http://e.org/s> <http://e.org/p> <http://e.org/o>", "syntax"),
    ("<http://e.org/s> p <http://e.org/o> .", "syntax"),
    ('"s" <http://e.org/p> <http://e.org/o> .', "syntax"),
    ('<http://e.org/s> <http://e.org/p> "a"b" .', "syntax"),
    ("garbage", "syntax"),
    ('<http://e.org/s> <http://e.org/p> "\\q" .', "escape"),
    ('<http://e.org/s> <http://e.org/p> "\\\\\\q" .', "escape"),
    ('<http://e.org/s> <http://e.org/p> "\\u12" .', "escape"),
    ('<http://e.org/s> <http://e.org/p> "\\uD83D" .', "character"),
    ('<http://e.org/s> <http://e.org/p> "\\U00110000" .', "character"),
]


def test_lines_are_triples_or_have_a_reason(spark, tmp_path):
    path = tmp_path / "t.nt"
    path.write_text("\n".join(line for line, _ in LINES), encoding="utf-8")
    found = instances.ntriples_table(spark.read.text(str(path))).collect()
    assert sorted((tuple(r)[:7] for r in found if r["reason"] is None), key=repr) == sorted((w for _, w in LINES if isinstance(w, tuple)), key=repr)
    assert sorted((r["line"], r["reason"]) for r in found if r["reason"]) == sorted((line, w) for line, w in LINES if isinstance(w, str))
    assert instances.ntriples_rejects(spark, str(path)).count() == 10 and instances.read_ntriples(spark, str(path)).count() == 7


def day(n):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)


@pytest.fixture
def run(spark, tmp_path):
    def run(batches, **options):
        """What a stream of files gives, each a batch."""
        folder = tmp_path / "in"
        schema = "id long, k string, ts timestamp"
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
            for f in sorted(folder.glob("*.parquet"), key=lambda f: f.stat().st_mtime):
                if not f.name.startswith("batch"):
                    f.rename(folder / f"batch{i}.parquet")
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "batch*.parquet").parquet(str(folder))
        out = streaming.duplicates(stream, ["k"], ["id"], **options)
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return sorted(r["id"] for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect()), kept

    return run


def test_later_rows_of_a_key_in_any_batch(run):
    found, kept = run([[(2, "a", day(0)), (1, "a", day(0)), (3, "b", day(0)), (4, None, day(0))], [(5, "b", day(1)), (6, "c", day(1)), (0, "a", day(1))], [(7, "c", day(9)), (8, None, day(9))]])
    assert found == [0, 2, 5, 7] and kept == 3


def test_keys_are_forgotten_in_time(run):
    found, kept = run([[(1, "a", day(0)), (2, "b", day(0))], [(3, "a", day(1))], [(4, "c", day(20))], [(5, "c", day(21)), (6, "a", day(21))], [(7, "d", day(40))]], event_time="ts", late="1 hour", keep_seconds=5 * 86400)
    assert found == [3, 5] and kept < 4
