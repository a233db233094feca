"""Filter interaction audit by incidence matrix products.

Whether a document fails each of n filters is a mask of n bits. Documents are counted by part and mask, once
for all and once for each label; what a filter does at a step of an order depends on the mask alone, so the
counts of all orders and steps are the product of these rows with integer matrices of 2^n rows and a column
for each order and step.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import WORD, n_words, skew_safe_lookup, staged, text_key

#: The filters of the audit; a text that equals an earlier document's fails the last one.
FILTERS = "ABCDE"


def matrices(filters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of each column, and the 0/1 matrices of the outcomes: a row a mask, a column an order's step."""
    masks = np.arange(1 << len(filters))
    bit = {f: 1 << i for i, f in enumerate(filters)}
    columns, held = [], {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    for order in map("".join, permutations(filters)):
        before = 0
        for step, f in enumerate(order, 1):
            fails, gone = masks & bit[f] > 0, masks & before > 0
            before |= bit[f]
            columns.append((order, step))
            held["kept"].append(masks & before == 0)
            held["removed"].append(fails & ~gone)
            held["redundant"].append(fails & gone)
            held["unique_fails"].append(masks == bit[f])
    return columns, {k: np.array(v, np.int64).T for k, v in held.items()}


def text_failures(text: Column, least_words: int = 100, distinct_percent: int = 80, capital_percent: int = 10, symbols: str = "#$%&*|") -> list[Column]:
    """Failures of the filters A to D, each from the whole text: few words, repeated words, capitals, symbols."""
    body = F.coalesce(text, F.lit(""))
    words = n_words(body)
    distinct = F.size(F.array_distinct(F.regexp_extract_all(body, F.lit(WORD), F.lit(0))))
    capitals = F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [
        words < least_words,
        distinct * 100 < words * distinct_percent,
        capitals * 100 > F.length(body) * capital_percent,
        F.length(F.translate(body, symbols, "")) < F.length(body),
    ]


def failure_masks(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang", **options) -> DataFrame:
    """doc_id, part, mask, good, toxic of each row: bit i of the mask says whether filter i fails."""
    fails = text_failures(F.col("_text"), **options)
    mask = sum((f.cast("int") * (1 << i) for i, f in enumerate(fails)), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).alias("_text"))
    judged, _ = staged(rows.select("doc_id", "part", mask.alias("mask"), *text_key(F.coalesce("_text", F.lit("")))), "masks")
    # one row a text, however often it occurs: the smallest id that has it
    firsts, _ = staged(judged.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "first-ids")
    held = skew_safe_lookup(judged, F.col("doc_id"), firsts.filter("n > 1"), ["k1", "k2"], "first", "n", judged.count())
    again = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    marked = held.withColumn("mask", F.col("mask") + F.when(again, 1 << len(fails)).otherwise(0)).select("doc_id", "part", "mask")
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = marked.join(said, F.col("doc_id") == F.col("_id"), "left")
    return known.select("doc_id", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


def _product(filters: str):
    columns, by = matrices(filters)
    orders, steps = [c[0] for c in columns], [c[1] for c in columns]
    at = {f: np.array([o[s - 1] == f for o, s in columns]) for f in filters}

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, *counts in batch.itertuples(index=False):
                every, good, toxic = (np.array(c, np.int64) for c in counts)
                out = {k: every @ m for k, m in by.items()}
                shapley = {f: int(out["removed"][mine].sum()) for f, mine in at.items()}
                yield pd.DataFrame({"part": part, "filter_order": orders, "step": np.array(steps, np.int32), **out, "good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"], "shapley": [shapley[o[s - 1]] for o, s in columns]})

    return multiply


_AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row a part, order of the filters and step: what that step's filter keeps, removes and finds already gone.

    ``masks`` (part, mask, good, toxic) has a row a document. They are counted by part and mask before anything is
    shuffled; a part is then 3 rows of 2^n counts, multiplied where it lies. An empty table gives an empty result.
    """
    cells = masks.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(name) for name, c in (("every", F.lit(1)), ("good", F.col("good")), ("toxic", F.col("toxic")))])
    places = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    # a part has a cell a mask at most
    dense = lambda name: F.transform(places, lambda i: F.coalesce(F.element_at("cells", i)[name], F.lit(0).cast("long"))).alias(name)
    rows = cells.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("every", "good", "toxic")))).alias("cells"))
    return rows.select("part", dense("every"), dense("good"), dense("toxic")).mapInPandas(_product(filters), _AUDIT)


def audit_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The audit of filters A to E over documents, by language: see ``failure_masks`` and ``audit``.

    Null texts count as empty, and equal empty ones; a null language is the part ''. A document fails E if a smaller
    doc_id has its text; rows that repeat an id fail alike, and a row without an id is later than any id. A document
    is good (toxic) if any of its label rows says 1; a row without an id has no labels. Rows are judged each, other columns ignored whatever their
    names; an empty table gives an empty result.
    """
    return audit(failure_masks(docs, labels, **options))
