"""Helpers shared by the training-data operators: words, skew-safe lookups, numbering; scratch tables are the session's."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from typeloom.session import drop_scratch, scratch_path, staged  # noqa: F401 - the operators take them from here

#: A word is a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_CACHES: dict[str, Callable[[], None]] = {}


def hold_cache(owner: str, release: Callable[[], None]) -> None:
    """Called where a task begins whose operator keeps a cache in its Python worker: the caches that tasks of
    other operators have left there are let go, as one worker serves them all in turn."""
    for other in [o for o in _CACHES if o != owner]:
        _CACHES.pop(other)()
    _CACHES[owner] = release


def unused_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    name = f"_typeloom_{base}"
    while name.lower() in taken:
        name += "_"
    return name


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: 128 bits that stand for a text."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(0x5BD1E995), text).alias("k2")]


#: A key is heavy when it holds over 1/HEAVY of all rows, so there are at most HEAVY such keys.
HEAVY = 1024


def skew_safe_lookup(rows: DataFrame, spread: Column, found: DataFrame, keys: list[str], value: str, count: str, total: int) -> DataFrame:
    """rows left-joined with found on keys, giving value; found has one row a key and its row count.

    Keys with over total/HEAVY rows are at most HEAVY in number, so they are broadcast; the rest are
    joined by shuffle, where rows already served are spread by ``spread`` and match nothing.
    """
    heavy = found.filter(F.col(count) * HEAVY > F.lit(total)).select(*keys, F.col(value).alias("_heavy"))
    light = found.filter(F.col(count) * HEAVY <= F.lit(total)).select(F.lit(0).alias("_salt"), *keys, F.col(value).alias("_light"))
    served = rows.join(F.broadcast(heavy), keys, "left")
    served = served.withColumn("_salt", F.when(F.col("_heavy").isNull(), F.lit(0)).otherwise((F.lit(1) + F.pmod(F.xxhash64(spread), F.lit(1 << 30))).cast("int")))
    out = served.join(light, ["_salt", *keys], "left")
    return out.withColumn(value, F.coalesce("_heavy", "_light")).drop("_heavy", "_light", "_salt")


def gapless_slots(df: DataFrame, group: str, order: list[str], total: int, out: str = "slot", rows_per_chunk: int = 200_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps and without one task per group.

    Rows are dealt to chunks by a hash of ``order``; a chunk's first number comes from the counts of
    the chunks before it, and only rows of one group and chunk are sorted together.
    """
    chunks = max(16, math.ceil(total / rows_per_chunk))
    dealt = df.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    counts = dealt.groupBy(group, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(group, "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, "_chunk").orderBy(*order)
    numbered = dealt.withColumn("_rank", F.row_number().over(within))
    joined = numbered.join(base, [group, "_chunk"])
    return joined.withColumn(out, (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_chunk", "_base", "_rank")
