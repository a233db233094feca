"""The pipeline against a brute-force version of its stages on the same inputs."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
from typeloom.llm import classifier, compression
from typeloom.llm.common import table
from typeloom.llm.tokens import Encoder, vocabulary

from .test_pairs_pages import slow_components, slow_sets
from .test_text_operators import check_packed, slow_targets, slow_verdict

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(i)))
        kept.append((name, before.collect(), docs.collect()))
        assert i == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    classify, rules, dedup, mixing, packing = kept

    model = classifier.train(table(spark, SF, "documents"), table(spark, SF, "labels"))
    key = lambda r: (r["doc_id"], r["text"])
    assert sorted(map(key, classify[2])) == sorted(key(r) for r in classify[1] if model.score(r["text"]) >= 0.7)

    bands = compression.fitted(spark.read.parquet(str(tmp_path / "0")), table(spark, SF, "labels"))
    assert sorted(map(key, rules[2])) == sorted(key(r) for r in rules[1] if slow_verdict(r["text"], bands))
    want = slow_components(slow_sets(((r["doc_id"], r["text"]) for r in dedup[1]), 5), 80)
    assert sorted(r["doc_id"] for r in dedup[2]) == sorted(d for d, c in want.items() if d == c)

    sizes = defaultdict(int)
    for r in mixing[1]:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    targets, taken = slow_targets(dict(sizes)), Counter(r["doc_id"] for r in mixing[2])
    for r in mixing[1]:
        rate = targets[r["source"]] / sizes[r["source"]]
        assert int(rate) <= taken[r["doc_id"]] <= int(rate) + 1
    code = Encoder(vocabulary("byte_bpe_50k.json"))
    bins = check_packed(packing[2], packing[1], 2048, code)
    total = sum(r["length"] for r in packing[2])
    assert bins <= 1.05 * total / 2048 + 2 and all(isinstance(zlib.crc32(b""), int) for _ in [0])


def test_stages_on_odd_and_empty_tables(spark, odd_docs, no_docs):
    names = {"bucket": "_typeloom_score", "slot": "_typeloom_gone", "lang": "_rules", "n_chars": "_copies"}
    for docs in (odd_docs.withColumnsRenamed(names), no_docs):
        rows = {tuple(r) for r in docs.collect()}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name != "best-fit packing":
                assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= rows, name
            else:
                assert {r["doc_id"] for r in out.collect()} == {r[0] for r in rows}
    kept = {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, odd_docs, SF).collect()}
    assert kept == {0, 1, 2, 3, 4, 7, 8, 9, 10, 11}  # 5 and 6 repeat 4, which repeats its own row


def test_run_gives_the_same_columns(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
