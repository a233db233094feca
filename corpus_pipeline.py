"""The corpus pipeline: quality classifier, quality rules, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before it kept, and returns a
DataFrame that is written as Parquet and read again for the next one. All but the last return the columns
of docs, extra ones of any name too, with their values. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from typeloom.llm import classifier, compression, forest, mixing, packing
from typeloom.llm.common import drop_scratch, scratch_path, table
from typeloom.llm.tokens import vocabulary
from typeloom.session import ship_package


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of documents not held out.

    Null and empty texts are scored as texts without n-grams; each row is judged alone, repeated or not.
    """
    ship_package(spark)
    return classifier.keep_predicted(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the compression bands, fitted to those labelled good among docs.

    Null and empty texts fail; each row is judged alone, from its whole text.
    """
    ship_package(spark)
    return compression.keep_good(docs, bands=compression.fitted(docs, table(spark, sf_dir, "labels")))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    That of the smallest doc_id stays, with all rows of that id. Texts without words and null ids all stay.
    """
    ship_package(spark)
    return forest.keep_one(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; a null source is one more source, without words it takes none."""
    ship_package(spark)
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows, packed into sequences of at most 2048; null texts are empty, repeated rows packed each."""
    ship_package(spark)
    packed, _ = packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), end_id=0)
    return packed


STAGES = [
    ("quality classifier", classify),
    ("quality rules", filter_quality),
    ("near-dedup", deduplicate),
    ("mixing", mix_sources),
    ("best-fit packing", pack),
]

#: SQL can express neither the models nor the compression; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"pipeline-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            drop_scratch(before)
        before = path
    return docs
