"""Mixing sources to target weights.

Tokens (here words) are summed per source, each source gets a repetition rate, and each document is
taken floor(rate) times plus once more with probability equal to the fraction, by a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeloom.llm.common import n_words, staged, unused_name

SEED = "mix-0"


def unit_hash(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the md5 of the seed and the key: 52 bits, the same in any engine."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(1 << 52))


def _ranked(by_source: DataFrame) -> DataFrame:
    """by_source with rank from 0 by code point, nulls last: sorted in ranges, whose counts give each its first rank."""
    order = F.col("source").asc_nulls_last()
    n = int(by_source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = by_source.repartitionByRange(n, order).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    dealt, _ = staged(dealt.withColumn("_part", F.shiftright("_at", 33)), "sources-ranked")
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a range
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    rank = F.col("_first") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return dealt.join(starts, "_part").select("source", "source_size", rank.alias("rank"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, target for rows (source, size): weights repeat over the sources by code point.

    All words are shared by weight; a target stops at ``cap`` times its source's size and the excess is
    reshared by weight among the rest. The level of a share is raised from totals over the source table
    until no further source reaches its cap, so no list of sources leaves the executors.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_source, _ = staged(totals, "sources")  # one row a source; each round below reads only this
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    weighed, _ = staged(_ranked(by_source).select("source", "source_size", weight.cast("long").alias("weight")), "sources-weighed")
    level = 0.0
    while True:
        capped = F.col("source_size") * cap <= F.col("weight") * F.lit(level)
        found = weighed.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(capped, F.col("source_size") * cap)).alias("held"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
        ).first()
        if not found["open"]:
            break
        raised = (found["total"] - (found["held"] or 0)) / found["open"]
        if raised <= level:
            break
        level = raised
    full = (F.col("source_size") * cap).cast("double")
    share = F.col("weight") * F.lit(level)
    return weighed.select("source", "source_size", F.when(full <= share, full).otherwise(share).alias("target"))


def _with_targets(docs: DataFrame, source: str, targets: DataFrame) -> tuple[DataFrame, str, str]:
    """docs joined with the size and target of each row's source, and the names of these two columns."""
    of, size, target = (unused_name(docs, x) for x in ("of", "source_size", "target"))
    targets = targets.select(F.col("source").alias(of), F.col("source_size").alias(size), F.col("target").alias(target))
    # one row a source: Spark broadcasts it below its threshold, and splits the skewed side of a shuffle otherwise
    return docs.join(targets, F.col(source).eqNullSafe(F.col(of)), "left").drop(of), size, target


def _copies(doc_id: str, size: str, target: str, seed: str) -> Column:
    rate = F.when(F.col(size) > 0, F.col(target) / F.col(size)).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    return (whole + F.when(unit_hash(F.col(doc_id), seed) < rate - whole, 1).otherwise(0)).cast("int")


def mixing_rates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **options) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: how often the mix takes each document.

    Null texts have size 0; null sources form one source, the last. Rows that repeat a document draw
    the same number and are each taken as often. Sources without words get target 0 and no copies. An
    empty table gives an empty result; other columns, whatever their names, are left out.
    """
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    sized, _ = staged(narrow, "mix-sizes")  # whole texts are read once
    found, source_size, target = _with_targets(sized, "source", source_targets(sized.select("source", "size"), **options))
    found = found.withColumn("copies", _copies("doc_id", source_size, target, seed))
    return found.select("doc_id", "size", F.col(source_size).alias("source_size"), F.col(target).alias("target"), "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, **options) -> DataFrame:
    """docs with each row repeated as often as the mix takes it; the columns of docs, in their order.

    Rows are treated as by mixing_rates; extra columns pass through, whatever their names.
    """
    sizes = docs.select(F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    found, source_size, target = _with_targets(docs, source, source_targets(sizes, **options))
    copy = F.explode(F.sequence(F.lit(1), F.col(source_size)))
    taken = found.withColumn(source_size, _copies(doc_id, source_size, target, seed)).filter(F.col(source_size) > 0)
    return taken.select(*[F.col(f"`{c}`") for c in docs.columns], copy.alias(unused_name(docs, "copy"))).select(*[F.col(f"`{c}`") for c in docs.columns])
