"""Best-fit packing with certified bounds.

Documents become token pieces of at most ``capacity``. Pieces are dealt to partitions, each packed by
best-fit decreasing; dual-feasible functions give a lower bound of each partition's bins. A partition
that meets its bound is certified and stands; the others hand the pieces of their unfilled bins over,
which are dealt anew to fewer partitions and packed again, as long as that saves bins. Last, the pieces
of all unfilled bins, those of certified partitions too, are exchanged in the same way.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import drop_scratch, staged
from typeloom.llm.tokens import encoder

CAPACITY = 2048
PART_PIECES = 100_000
#: Sequence ids: full pieces from _FULL on, else round, partition and bin.
_FULL, _ROUND, _PART = 1 << 62, 1 << 48, 1 << 28
_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def best_fit_decreasing(sizes: Iterable[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bins and offsets of the items in their order, and the gap of each bin; ties fall to the earlier item.

    Open bins are kept by gap, with one bit a gap, so the tightest bin that fits is one bit operation.
    """
    sizes = list(sizes)
    bins, offsets, gaps = [0] * len(sizes), [0] * len(sizes), []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        above = mask >> size
        if above:
            gap = size + (above & -above).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = capacity, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = b, capacity - gap
        gaps[b] = gap - size
        if gap > size:
            by_gap[gap - size].append(b)
            mask |= 1 << (gap - size)
    return bins, offsets, gaps


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest bins that any packing needs; counts[s] is the number of items of size s.

    The largest of the dual-feasible functions f_l (sizes over capacity - l count as full, sizes under l
    as nothing) and of u_k after f_l ((k + 1) s / capacity rounded down, over k).
    """
    counts = np.asarray(counts, dtype=np.int64)
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    for low in range(0, capacity // 2 + 1):
        kept = sizes.copy()
        kept[sizes > capacity - low] = capacity
        kept[sizes < low] = 0
        best = max(best, -(-int(counts @ kept) // capacity))
        if low % 64 == 0:
            for k in range(1, 12):
                scaled = (k + 1) * kept
                # in units of capacity / k: whole multiples keep their size
                units = np.where(scaled % capacity == 0, kept * k / capacity, scaled // capacity)
                best = max(best, math.ceil(float(counts @ units) / k - 1e-9))
    return best


def _pieces_of(vocabulary: str, end_id: int, capacity: int):
    """Batches of (doc_id, text) to rows of pieces: a document's first piece takes the remainder."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        end = np.uint32(end_id).tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text) + end
                total = len(ids) // 4
                at, piece, take = 0, 0, (total - 1) % capacity + 1
                while at < total:
                    out.append((doc_id, piece, at, take, zlib.crc32(ids[4 * at : 4 * (at + take)])))
                    at, piece, take = at + take, piece + 1, capacity
            columns = list(zip(*out)) or [[]] * len(_PIECE)
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _PIECE)], schema=_PIECE)

    return cut


_PACKED = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long, part long, bin long, offset long, gap long"


def _pack_part(capacity: int):
    def pack(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["length", "uid"], ascending=[False, True], ignore_index=True)
        bins, offsets, gaps = best_fit_decreasing(pieces["length"].tolist(), capacity)
        gap = np.asarray(gaps, dtype=np.int64)[bins]
        return pieces.assign(bin=bins, offset=offsets, gap=gap)[[x.split()[0] for x in _PACKED.split(", ")]]

    return pack


def _part_bounds(capacity: int):
    """Per partition: its bins, its bound, and how many bins have gaps."""

    def bound(rows: pd.DataFrame) -> pd.DataFrame:
        sizes = np.zeros(capacity + 1, dtype=np.int64)
        sizes[rows["length"].to_numpy()] = rows["n"].to_numpy()
        return pd.DataFrame({"part": [rows["part"].iat[0]], "bound": [lower_bound(sizes, capacity)]})

    return bound


def certificates(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """part, bins, gap_bins, gap_pieces, bound, certified: a partition is certified when it has as few bins as its bound."""
    unfilled = F.col("gap") > 0
    bins = packed.groupBy("part").agg(F.count_distinct("bin").alias("bins"), F.count_distinct(F.when(unfilled, F.col("bin"))).alias("gap_bins"), F.count_if(unfilled).alias("gap_pieces"))
    by_size = packed.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    bounds = by_size.groupBy("part").applyInPandas(_part_bounds(capacity), "part long, bound long")
    return bins.join(bounds, "part").withColumn("certified", F.col("bins") == F.col("bound"))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> tuple[DataFrame, dict]:
    """pieces (uid, doc_id, piece, start, length, ids_crc32; uid unique) with sequence_id and offset.

    First only partitions without a certificate exchange, then all that have unfilled bins: the leftovers of
    two certified partitions can still save a bin together. Each goes on until a round saves nothing, the
    bound is met or one partition saw all. Returns the packed pieces and a report: bins, the bound of all
    pieces, and of each round its partitions, how many are certified, and the bins after it.
    """
    full = pieces.filter(F.col("length") == capacity)
    open_ = pieces.filter(F.col("length") < capacity)
    by_size = open_.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in by_size:
        counts[row["length"]] = row["n"]
    bound = lower_bound(counts, capacity)
    report = {"full": full.count(), "bound": bound, "rounds": [], "bins": 0}
    done: list[DataFrame] = []  # filled bins
    closed, step = 0, itertools.count()
    standing: DataFrame | None = None  # the unfilled bins of partitions that may exchange, as packed last
    certified: list[DataFrame] = []  # those of certified partitions
    pool, pool_bins, left = open_, None, int(counts.sum())
    certified_bins = certified_pieces = 0
    for all_exchange in (False, True):
        if all_exchange:
            if not certified or report["bins"] <= bound:
                break
            for more in certified:
                standing = more if standing is None else standing.unionByName(more)
            certified, left, pool_bins = [], left + certified_pieces, pool_bins + certified_bins
            pool, certified_bins, certified_pieces = standing.select(pieces.columns), 0, 0
        while left:
            parts, i = max(1, math.ceil(left / part_pieces)), next(step)
            dealt = pool.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(i)), F.lit(parts)).cast("long"))
            packed, path = staged(dealt.groupBy("part").applyInPandas(_pack_part(capacity), _PACKED), f"pack-{i}")
            judged, _ = staged(certificates(packed, capacity), f"certificates-{i}")  # a row a partition
            sure = F.col("certified")
            total = judged.agg(
                *[F.sum(c).alias(c) for c in ("bins", "gap_bins", "gap_pieces")],
                F.count_if(sure).alias("n"),
                *[F.coalesce(F.sum(F.when(sure, F.col(c))), F.lit(0)).alias(f"sure_{c}") for c in ("gap_bins", "gap_pieces")],
            ).first()
            report["rounds"].append({"parts": parts, "certified": total["n"], "bins": closed + certified_bins + total["bins"]})
            if pool_bins is not None and total["bins"] >= pool_bins:
                drop_scratch(path)  # nothing gained: the packing before stands
                break
            numbered = packed.join(judged.select("part", "certified"), "part")
            numbered = numbered.withColumn("sequence_id", (F.lit(i * _ROUND) + F.col("part") * _PART + F.col("bin")).cast("long"))
            done.append(numbered.filter("gap = 0"))
            closed += total["bins"] - total["gap_bins"]
            standing, pool_bins, left = numbered.filter("gap > 0"), total["gap_bins"], total["gap_pieces"]
            alone = parts == 1 and not certified  # this partition has all unfilled bins
            if not all_exchange and total["n"] and not alone:
                certified.append(standing.filter("certified"))
                standing = standing.filter("NOT certified")
                certified_bins, certified_pieces = certified_bins + total["sure_gap_bins"], certified_pieces + total["sure_gap_pieces"]
                pool_bins, left = pool_bins - total["sure_gap_bins"], left - total["sure_gap_pieces"]
            pool = standing.select(pieces.columns)
            report["bins"] = closed + certified_bins + pool_bins
            if report["bins"] <= bound or parts == 1:
                break  # certified as a whole, or one partition saw all that had gaps
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    out = full.select("doc_id", "piece", "start", "length", "ids_crc32", (F.lit(_FULL) + F.col("uid")).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for part in [*done, *certified, *([standing] if standing is not None else [])]:
        out = out.unionByName(part.select(columns))
    return out, report


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 0, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, part_pieces: int = PART_PIECES) -> tuple[DataFrame, dict]:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; and the report.

    A document is its ids and then end_id; null texts are empty, so every row of docs has a piece.
    Repeated rows are packed as often as they occur. Only documents of over ``capacity`` ids are cut,
    into full pieces after a first one that takes the remainder. Other columns are left out.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    cut = rows.mapInArrow(_pieces_of(vocabulary, end_id, capacity), schema)
    # the staged table fixes which row has which uid
    pieces, _ = staged(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces.select("uid", "doc_id", "piece", "start", "length", "ids_crc32"), capacity, part_pieces)
