"""Bands are fitted to all labelled prose."""

import math
import random

import numpy as np
import zstandard

from typeloom.llm import compression


def test_all_labelled_documents_are_counted(spark):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=60)) for _ in range(6500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int")
    learnt = [r["doc_id"] for r in docs.filter(~compression.held_out(docs["doc_id"])).select("doc_id").collect()]
    assert len(learnt) > 4500
    packer, steps = zstandard.ZstdCompressor(level=compression.DEFAULT.level), {}
    for i in learnt:
        data = texts[i].encode()
        steps.setdefault(math.floor(2 * math.log2(len(data))), []).append(round(len(data) / len(packer.compress(data)), compression.DECIMALS))
    want = {s / 2 + 0.25: np.percentile(r, [1, 99]) for s, r in steps.items() if len(r) >= compression.LEAST}
    knots = {x: (low, high) for x, low, high in compression.fitted(docs, labels).knots}
    assert want and all(np.allclose(knots[x], (low * (1 - compression.MARGIN), high * (1 + compression.MARGIN)), atol=2e-3) for x, (low, high) in want.items())
