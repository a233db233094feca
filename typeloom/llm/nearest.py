"""Approximate nearest neighbours by collision counting.

Each block of vectors keeps one sorted array a projection. A query opens a window around its own place
in every array; virtual rehashing widens the windows by a factor until enough good vectors are found. A
vector that lies in at least a threshold number of windows is verified by its exact inner product.
Largest inner products are nearest distances once every vector gets one more coordinate that fills its
norm up to the largest one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from typeloom.llm.common import staged, text_key
from typeloom.llm.tokenfiles import open_store

#: Vectors a block; a task holds one block and its sorted arrays, 1.6 KB a vector of 64 dimensions.
BLOCK_ROWS = 131_072


class CollisionIndex:
    """Sorted projection arrays of a block of vectors, for largest inner product.

    ``spread`` is half a window's width in units of the search radius; ``slack`` is by how many standard
    deviations a vector at the radius may miss its expected number of collisions. A count tells distances
    apart best if windows are some 1.5 deviations wide; most vectors lie inside, so those outside are counted.
    """

    def __init__(self, vectors: np.ndarray, top_norm: float, projections: int = 65, spread: float = 1.5, slack: float = 1.0, growth: float = 1.03, start: float = 1.0, seed: int = 5):
        self.vectors = vectors
        n, d = vectors.shape
        self.norm = top_norm or 1.0
        placed = vectors / self.norm
        fill = np.sqrt(np.maximum(0.0, 1.0 - (placed * placed).sum(1)))
        rng = np.random.default_rng(seed)
        bases = [np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0] * math.sqrt(d + 1) for _ in range(-(-projections // (d + 1)))]
        self.axes = np.concatenate(bases, axis=1)[:, :projections]
        self.m = self.axes.shape[1]
        sampled = rng.permutation(n)[: max(32, n // 32)]
        self.sample = np.concatenate([placed[sampled], fill[sampled, None]], axis=1)
        # all sorted arrays in a row, each moved away from the others, so that one search places a query in all of them
        self.places = np.arange(self.m) * 4 * math.sqrt(self.m * (d + 1))
        self.order, self.sorted = np.empty(self.m * n, np.int64), np.empty(self.m * n)
        for j in range(self.m):
            shadow = placed @ self.axes[:-1, j] + fill * self.axes[-1, j]
            order = np.argsort(shadow, kind="stable")
            self.order[j * n : (j + 1) * n] = order
            self.sorted[j * n : (j + 1) * n] = shadow[order] + self.places[j]
        self.begin = np.arange(self.m) * n
        density = math.exp(-spread * spread / 2) / math.sqrt(2 * math.pi)
        p = math.erf(spread / math.sqrt(2))
        # the axes of a basis are orthogonal, which takes away a part of the count's variance
        deviation = math.sqrt(self.m * max(p * (1 - p) - 2 * (spread * density) ** 2 * min(1.0, self.m / (d + 1)), 1e-3))
        self.threshold = min(self.m, max(1, math.floor(self.m * p - slack * deviation)))
        self.spread, self.growth, self.start = spread, growth, start
        self.verified = 0

    def _window(self, at: np.ndarray, half: float) -> tuple[list[int], list[int]]:
        """Of each sorted array, the first place inside the window and the first one after it."""
        n = len(self.vectors)
        low, high = self.sorted.searchsorted(at - half), self.sorted.searchsorted(at + half, "right")
        return np.clip(low, self.begin, self.begin + n).tolist(), np.clip(high, self.begin, self.begin + n).tolist()

    def _tally(self, *bounds: list[int]) -> np.ndarray:
        """How often each vector lies between bounds, given as pairs of lists of begins and ends."""
        pieces = [self.order[a:b] for begins, ends in zip(bounds[::2], bounds[1::2]) for a, b in zip(begins, ends) if a < b]
        return np.bincount(np.concatenate(pieces), minlength=len(self.vectors)) if pieces else np.zeros(len(self.vectors), np.int64)

    def search(self, query: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the k best found and maybe more, without the rows in ``skip``."""
        n = len(self.vectors)
        length = math.sqrt(float((query * query).sum()))
        place = np.append(query / length, 0.0)
        at = place @ self.axes + self.places
        begin, end = self.begin.tolist(), (self.begin + n).tolist()
        # a first radius near that of the wanted neighbours: a sample's nearest stands for some 32 of the block
        radius = max(1e-6, self.start * math.sqrt(max(0.0, float(((self.sample - place) ** 2).sum(1).min()))))
        checked = np.zeros(n, bool)
        if skip is not None:
            checked[skip] = True
        rows, scores, best = [], [], np.empty(0)
        missed = lo = hi = None
        while True:
            left, right = self._window(at, radius * self.spread)
            if lo is None:
                missed = self._tally(begin, left, right, end)
            else:
                missed -= self._tally(left, lo, hi, right)
            lo, hi = left, right
            fresh = np.flatnonzero((missed <= self.m - self.threshold) & ~checked)
            if len(fresh):
                checked[fresh] = True
                self.verified += len(fresh)
                # one order of additions for every row, so that equal vectors have equal scores
                found = (self.vectors[fresh] * query).sum(1)
                rows.append(fresh)
                scores.append(found)
                best = np.concatenate([best, found])
                if len(best) > k:
                    best = np.partition(best, len(best) - k)[len(best) - k :]
            # squared distance of the placed points: 2 - 2 <x, q> / (norm |q|)
            if len(best) >= k and math.sqrt(max(0.0, 2 - 2 * best.min() / (self.norm * length))) <= radius:
                break
            if lo == begin and hi == end:
                break
            # few found so far: the radius is far too small, and grows faster
            radius *= self.growth if len(best) >= k // 2 else self.growth**3
        return (np.concatenate(rows), np.concatenate(scores)) if rows else (np.empty(0, np.int64), np.empty(0))


def _usable(vector: F.Column) -> F.Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    return column.flatten().to_numpy().astype(np.float64).reshape(len(column), -1)


def _search(k: int, top_norm: float, query_files: list[str], parts: int, options: dict):
    """For a partition that holds one block (rows part, dims, vec_id, vector): its answers to its part of the queries."""
    names = ["query_id", "vec_id", "score"]

    def answers(ids: np.ndarray, vectors: np.ndarray, dims: int, part: int) -> Iterator[pa.RecordBatch]:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
        index, seen = CollisionIndex(vectors, top_norm, **options), 0
        for path in query_files:
            fs, inner = open_store(path)
            with fs.open_input_file(inner) as file:
                for batch in pq.ParquetFile(file).iter_batches(4096, columns=["query_id", "dims", "vector"]):
                    own = np.flatnonzero((batch.column(1).to_numpy() == dims) & ((np.arange(batch.num_rows) + seen) % parts == part))
                    seen += batch.num_rows
                    batch = batch.take(pa.array(own))
                    out: list[tuple] = []
                    for query_id, query in zip(batch.column(0).to_numpy(), _matrix(batch.column(2)) if len(own) else ()):
                        lo, hi = np.searchsorted(ids, [query_id, query_id + 1])
                        rows, scores = index.search(query, k, np.arange(lo, hi))
                        best = np.lexsort((ids[rows], -scores))[:k]
                        out.append((np.full(len(best), query_id), ids[rows[best]], scores[best]))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}
        for batch in batches:
            part, dims, ids = (batch.column(c).to_numpy() for c in range(3))
            for key in set(zip(part.tolist(), dims.tolist())):
                own = np.flatnonzero((part == key[0]) & (dims == key[1]))
                held.setdefault(key, []).append((ids[own], _matrix(batch.column(3).take(pa.array(own)))))
        for key in sorted(held):  # one, but for vectors of several lengths
            found = held.pop(key)
            yield from answers(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), key[1], key[0])

    return search


def block_answers(k: int, blocks: int, risk: float = 1e-7) -> int:
    """How many of a query's k nearest one of several blocks can hold, but for a chance of ``risk``.

    Vectors are dealt by a hash of their ids, so the number is binomial.
    """
    p, at_most, n = 1 / blocks, 0.0, -1
    while n < k and 1 - at_most > risk:
        n += 1
        at_most += math.comb(k, n) * p**n * (1 - p) ** (k - n)
    return max(1, n)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS, risk: float = 1e-7, **options) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries the k rows of vectors of largest inner product.

    A query's own id is no candidate of its own. Ties go to the smaller vec_id. Vectors that are null,
    empty, zero or hold null or non-finite components take no part, nor do null ids; a query meets
    vectors of its own length only, and gets fewer than k rows where there are fewer. Of equal vectors the
    k + 1 smallest ids take part, which is all that any answer can hold. Rows with one id count once, as the
    first of their vectors in the order of arrays. Empty tables give an empty result; other columns are left out, whatever their names.

    Vectors are dealt to blocks once; each block's task reads the queries from the shared folder, so no
    vector is shuffled a second time however many queries there are. With fewer blocks than cores, a
    block is held by several tasks, which share the queries. A block searches for as many neighbours as it can
    hold of a query's k but for a chance of ``risk`` (``block_answers``), so its radius, its work and its answers shrink as
    blocks grow in number; queries of which a block gave all its answers to the result are searched again for k.
    """
    spark = vectors.sparkSession

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
        return rows.filter(F.col("vec_id").isNotNull() & _usable(F.col("vector")))

    equal = Window.partitionBy("k1", "k2").orderBy("vec_id")
    once = lambda df: df.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    kept = once(clean(vectors)).withColumns(dict(zip(("k1", "k2"), text_key(F.col("vector")))))
    kept = kept.withColumn("_place", F.row_number().over(equal)).filter(F.col("_place") <= k + 1)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    kept, _ = staged(kept.select("vec_id", "vector", F.size("vector").alias("dims"), norm.alias("norm")), "vectors")
    asked = once(clean(queries)).select(F.col("vec_id").alias("query_id"), F.size("vector").cast("int").alias("dims"), "vector")
    asked, _ = staged(asked, "queries")
    rows, top_norm = kept.agg(F.count(F.lit(1)), F.max("norm")).first()
    blocks = max(1, math.ceil(rows / block_rows))
    parts = max(1, math.ceil(spark.sparkContext.defaultParallelism / blocks))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    held = kept.select(part.alias("part"), block.alias("block"), F.col("dims").cast("int").alias("dims"), "vec_id", "vector")
    held = held.repartitionById(blocks * parts, F.col("block") * parts + F.col("part")).drop("block")

    def answers(queries: DataFrame, n: int) -> DataFrame:
        search = _search(n, float(top_norm or 1.0), sorted(queries.inputFiles()), parts, options)
        return staged(held.mapInArrow(search, "query_id long, vec_id long, score double"), "answers")[0]

    def ranked(found: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    n = block_answers(k, blocks, risk)
    found = answers(asked, n)
    if n < k:
        cut = ranked(found).groupBy("query_id", block.alias("block")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n)
        again, _ = staged(asked.join(cut.select("query_id").distinct(), "query_id", "left_semi"), "queries-again")
        if not again.isEmpty():
            found = found.join(again.select("query_id"), "query_id", "left_anti").unionByName(answers(again, k))
    return ranked(found).select("query_id", "rank", "vec_id", "score")
