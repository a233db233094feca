"""Quality rules: compression bands.

Zstandard ratios (raw bytes / compressed bytes) of the whole text and of fixed chunks must lie in
bands that depend on length. Above its band a text is repetitive, below it is incompressible. Bands are
fitted to a corpus's own good prose where some of it is labelled (``fitted``); DEFAULT is wider.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.classifier import held_out
from typeloom.llm.common import WORD, unused_name

_WORD = re.compile(WORD)
_SYMBOLS = "#*$%&|<>"


#: Median ratio of good prose (documents of sf0.1 labelled quality 1, and their chunks) by log2 of the bytes.
PROSE = (
    (7.25, 1.33), (7.75, 1.46), (8.25, 1.55), (8.75, 1.59), (9.25, 1.68), (9.75, 1.81), (10.25, 1.92), (10.75, 1.99),
    (11.25, 2.06), (11.75, 2.12), (12.25, 2.18), (12.75, 2.23), (13.25, 2.26), (13.75, 2.31), (14.25, 2.40), (17.25, 2.57),
)
#: What bands without a corpus's own prose allow around PROSE: other languages lie some tenths off.
WIDE = 0.25
#: What fitted bands allow beyond the 1st and 99th percentile of a corpus's good prose.
MARGIN = 0.03
#: A step of half an octave is fitted on so many ratios at least, which are counted by so many decimals.
LEAST, DECIMALS = 16, 3


@dataclass(frozen=True)
class Bands:
    """Limits of raw/compressed as functions of log length: knots (log2 bytes, lowest, highest), linear in between.

    Under the first knot a frame's own bytes decide, so only ``short`` holds; past the last one the lowest
    stays and the highest grows by ``growth`` a doubling, as a longer window finds more matches.
    """

    level: int = 3
    chunk: int = 4096
    knots: tuple[tuple[float, float, float], ...] = tuple((x, m * (1 - WIDE), m * (1 + WIDE)) for x, m in PROSE)
    short: float = 4.0
    growth: float = 0.1
    #: A text fails if over this share of its bytes lies in chunks out of their band.
    chunk_share: float = 0.34

    def limits(self, raw: int) -> tuple[float, float]:
        """Lowest and highest ratio of so many bytes."""
        at = math.log2(raw)
        (x, low, high) = self.knots[0]
        if at < x:
            return 0.0, self.short
        for nx, nlow, nhigh in self.knots[1:]:
            if at < nx:
                share = (at - x) / (nx - x)
                return low + share * (nlow - low), high + share * (nhigh - high)
            x, low, high = nx, nlow, nhigh
        return low, high + self.growth * (at - x)

    def ok(self, raw: int, packed: int) -> bool:
        low, high = self.limits(raw)
        return low <= raw / packed <= high


DEFAULT = Bands()
OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: as empty)."""
    if not text:
        return 0, 0, 0, 0, 0
    words = _WORD.findall(text)
    n = len(words)
    symbols = sum(map(text.count, _SYMBOLS))
    lines = text.split("\n")
    dup_lines = 0
    if len(set(lines)) < len(lines):
        seen: set[str] = set()
        for line in lines:
            if line in seen:
                dup_lines += _WORD.search(line) is not None
            else:
                seen.add(line)
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            covered_to = 0  # words before this index are counted already
            for i, window in enumerate(windows):
                if counts[window] > 1:
                    repeat += i + 3 - max(covered_to, i)
                    covered_to = i + 3
    return n, sum(map(len, words)), symbols, dup_lines, repeat


def base_fails(counts: tuple[int, int, int, int, int]) -> bool:
    return counts[0] < 50 or 100 * counts[4] > 50 * counts[0]


def verdict(data: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[bool, float, float]:
    """Whether a whole text passes the bands, its ratio, and the share of bytes in chunks out of band."""
    size = len(data)
    if not size:
        return True, 1.0, 0.0
    packed = len(packer.compress(data))
    bad = 0
    if size > bands.chunk:
        for at in range(0, size, bands.chunk):
            part = data[at : at + bands.chunk]
            if not bands.ok(len(part), len(packer.compress(part))):
                bad += len(part)
    share = bad / size
    return bands.ok(size, packed) and share <= bands.chunk_share, size / packed, share


def _ratios(bands: Bands):
    def ratios(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = []
            for key, text in zip(batch["doc_id"], batch["_text"]):
                if not isinstance(text, str) or base_fails(base_counts(text)):
                    continue
                data = text.encode("utf-8", "surrogatepass")
                parts = [data[at : at + bands.chunk] for at in range(0, len(data), bands.chunk)] if len(data) > bands.chunk else []
                rows += [(key, math.floor(2 * math.log2(len(x))), len(x) / len(packer.compress(x))) for x in (data, *parts)]
            yield pd.DataFrame(rows, columns=["doc_id", "step", "ratio"])

    return ratios


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", bands: Bands = DEFAULT) -> Bands:
    """bands with knots from the ratios of good prose: texts labelled 1 that pass the base rules, and their chunks.

    For each half octave of length with at least LEAST ratios the limits are their 1st and 99th percentile,
    widened by MARGIN; elsewhere the knots of ``bands`` stay. Held-out documents are not looked at; all others are,
    and their ratios, rounded to DECIMALS, are counted. A document with several labels counts by the smallest.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).filter("label IN (0, 1) AND doc_id IS NOT NULL")
    good = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label")).filter("label = 1")
    # labels are as many as the corpus makes them: ratios meet them, so that texts are never shuffled
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).filter("doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    kind = rows.schema["doc_id"].dataType.simpleString()
    ratios = rows.mapInPandas(_ratios(bands), f"doc_id {kind}, step int, ratio double").join(good, "doc_id", "left_semi")
    counts = ratios.groupBy("step", F.round("ratio", DECIMALS).alias("ratio")).agg(F.count(F.lit(1)).alias("k"))
    at = lambda share: F.percentile("ratio", F.lit(share), F.col("k"))
    found = counts.groupBy("step").agg(F.sum("k").alias("n"), at(0.01).alias("low"), at(0.99).alias("high")).collect()  # a row a step
    own = {r["step"] / 2 + 0.25: (r["low"] * (1 - MARGIN), r["high"] * (1 + MARGIN)) for r in found if r["n"] >= LEAST}
    knots = {x: (low, high) for x, low, high in bands.knots} | own
    return replace(bands, knots=tuple((x, *knots[x]) for x in sorted(knots)))


def rules_udf(bands: Bands = DEFAULT):
    """A pandas UDF from a text to the struct OUT."""

    @F.pandas_udf(OUT)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for texts in batches:
            rows = []
            for text in texts:
                text = text if isinstance(text, str) else None
                counts = base_counts(text)
                failed = base_fails(counts)
                passed, ratio, share = verdict((text or "").encode("utf-8", "surrogatepass"), bands, packer)
                rows.append((*counts, failed, passed and not failed, ratio, share))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in OUT.split(", ")])

    return rules


def quality_rules(docs: DataFrame, text: str = "text", out: str = "_rules", bands: Bands = DEFAULT) -> DataFrame:
    """docs with a struct column ``out`` of counts, ratios and the verdict ``kept``.

    Null and empty texts have no words, fail the base rule and are not kept; rows repeat and tie
    freely, as each row is judged alone; other columns pass through unchanged. An empty table stays
    empty. Whole texts are compressed, however long.
    """
    return docs.withColumn(out, rules_udf(bands)(F.col(text)))


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = DEFAULT) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    rules = unused_name(docs, "rules")
    return quality_rules(docs, text, rules, bands).filter(f"{rules}.kept").drop(rules)
