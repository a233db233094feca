"""Centroid clustering by annulus search.

Centroids are sorted by norm. A vector's distance to the centroid of nearest norm bounds its distance to the
nearest one, and by the triangle inequality no centroid can be as near unless its norm differs from the
vector's by at most that bound: two binary searches give those of the annulus, edges included, and only they
are compared, from the vector's norm outwards, while the bound narrows. Everything is counted in integers, so rounds, ties and results are the same on any cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import staged

#: Components are counted in steps of 1/SCALE.
SCALE = 256

#: Vectors that are searched together; a task holds some KB for each.
SLICE = 16_384


def steps_of(components: np.ndarray, wide: bool) -> np.ndarray:
    """floor(SCALE * x) of each component; as Python integers, of any size, where ``wide``."""
    if not wide:
        return np.floor(components.astype(np.float64) * SCALE).astype(np.int64)
    exact = [math.floor(x * SCALE) if abs(x) < 1 << 53 else int(x) * SCALE for x in components.astype(np.float64).ravel().tolist()]
    return np.array(exact, dtype=object).reshape(components.shape)


def _squares(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows) if rows.dtype != object else (rows * rows).sum(1)


def _roots(squares: np.ndarray) -> np.ndarray:
    """Integer square roots, at most one away from the true ones."""
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64)).astype(np.int64)
    return np.array([math.isqrt(x) for x in squares], dtype=object)


class Annuli:
    """Centroids in the order of their norms, and the search for the nearest one."""

    def __init__(self, centroids: np.ndarray):
        norms = _roots(_squares(centroids))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.centroids = norms[self.order], centroids
        self.compared = 0

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid of each vector, the smaller number among ties, and its squared distance."""
        norms, k = _roots(_squares(vectors)), len(self.order)
        at = np.minimum(np.searchsorted(self.norms, norms), k - 1)
        below = np.maximum(at - 1, 0)
        at = np.where(norms - self.norms[below] < np.abs(self.norms[at] - norms), below, at)
        found = self.order[at]
        bound = _squares(vectors - self.centroids[found])
        # roots are off by one at most, on either side: what lies on the edge stays in
        reach = _roots(bound) + 3
        first, after = np.searchsorted(self.norms, norms - reach, "left"), np.searchsorted(self.norms, norms + reach, "right")
        # outwards from the vector's own norm: each nearer centroid narrows the annulus for those still to come
        rows, low, high = np.arange(len(vectors)), at - 1, at + 1
        while True:
            down, up = low[rows] >= first[rows], high[rows] < after[rows]
            rows, down, up = rows[down | up], down[down | up], up[down | up]
            if not len(rows):
                break
            under, over = norms[rows] - self.norms[np.maximum(low[rows], 0)], self.norms[np.minimum(high[rows], k - 1)] - norms[rows]
            lower = down & (~up | (under < over).astype(bool))
            inside = (np.where(lower, under, over) <= reach[rows]).astype(bool)
            rows, lower = rows[inside], lower[inside]
            number = self.order[np.where(lower, low[rows], high[rows])]
            low[rows[lower]] -= 1
            high[rows[~lower]] += 1
            far = _squares(vectors[rows] - self.centroids[number])
            self.compared += len(rows)
            better = ((far < bound[rows]) | ((far == bound[rows]) & (number < found[rows]))).astype(bool)
            nearer = rows[better]
            bound[nearer], found[nearer] = far[better], number[better]
            reach[nearer] = _roots(bound[nearer]) + 3
        return found, bound


def usable(vector: Column, dims: int) -> Column:
    """Whether a vector has ``dims`` components, none of them null or non-finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & fine, F.lit(False))


def _slices(batches: Iterator[pa.RecordBatch], column: int, dims: int, wide: bool) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, SLICE):
            part = batch.slice(i, SLICE)
            yield part, steps_of(part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), wide)


def _sums(centroids: np.ndarray, dims: int, wide: bool):
    """A task's vectors by their nearest centroid: how many, and the sum of each component."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, k = Annuli(centroids), len(centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), object if wide else np.int64)
        for _, vectors in _slices(batches, 0, dims, wide):
            found, _ = annuli.nearest(vectors)
            counts += np.bincount(found, minlength=k)
            for number in np.unique(found):
                sums[number] += vectors[found == number].sum(0)
        met = np.flatnonzero(counts)
        values = [[str(x) for x in row] if wide else row.tolist() for row in sums[met]]
        kind = pa.list_(pa.string() if wide else pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(counts[met]), pa.array(values, kind)], names=["cluster", "n", "sums"])

    return add


def _total(parts: pd.DataFrame) -> pd.DataFrame:
    sums = [sum(int(x) for x in column) for column in zip(*parts["sums"])]
    return pd.DataFrame({"cluster": [parts["cluster"].iat[0]], "n": [parts["n"].sum()], "sums": [[str(x) for x in sums]]})


def moved(vectors: DataFrame, centroids: np.ndarray, wide: bool) -> np.ndarray:
    """The centroids after a round: floor(sum/count) of each component over a centroid's vectors; those without any stay."""
    dims = centroids.shape[1]
    parts = vectors.select("vector").mapInArrow(_sums(centroids, dims, wide), f"cluster int, n long, sums array<{'string' if wide else 'long'}>")
    if wide:  # a row a task and centroid
        added = parts.groupBy("cluster").applyInPandas(_total, "cluster int, n long, sums array<string>")
    else:
        cells = parts.select("cluster", "n", F.posexplode("sums").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        added = cells.groupBy("cluster", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("sums"))
    out = centroids.copy()
    for row in added.collect():  # at most one a centroid
        out[row["cluster"]] = [int(x) // row["n"] for x in row["sums"]]
    return out


def _assigned(centroids: np.ndarray, dims: int, wide: bool):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for part, vectors in _slices(batches, 1, dims, wide):
            found, far = annuli.nearest(vectors)
            far = pa.array([x if x < 1 << 63 else None for x in far], pa.int64()) if wide else pa.array(far)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.astype(np.int32)), far], names=["vec_id", "cluster", "distance"])

    return assign


def cluster(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", dims: int = 64, clusters: int = 40, rounds: int = 5, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of ``dims`` finite components.

    Components count as floor(256 * x). The first centroids are the vectors whose ids have the smallest sha256 of
    ``seed:vec_id``, in that order; each round assigns all vectors and moves each centroid that has some to the
    floor of their mean. Vectors of another length, null ones and those with null or non-finite components take
    no part. Rows that repeat an id count each, equal hashes going by the vector; a null id hashes as the text
    ``null``. With fewer vectors than centroids each begins as one; an empty table gives an empty result. Other
    columns are left out, whatever their names. Components so large that squared distances leave 64 bits (2^19 in 64
    dimensions) are counted exactly too, by slower integers; a distance or a sum that no long can hold is null.

    What goes through the driver are the centroids, some ``clusters`` times ``dims`` integers a round.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    kept, _ = staged(rows.filter(usable(F.col("vector"), dims)), "vectors")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))), 256)
    first = kept.orderBy(digest, "vec_id", "vector").limit(clusters).collect()
    largest = kept.agg(F.max(F.array_max(F.transform("vector", F.abs)))).first()[0]
    out = "vec_id {}, cluster int, distance long".format(kept.schema["vec_id"].dataType.simpleString())
    if not first:
        return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
    wide = dims * (2 * math.ceil(largest) * SCALE + 2) ** 2 >= 1 << 63  # squared distances leave 64 bits
    centroids = steps_of(np.array([r["vector"] for r in first], np.float64), wide)
    for _ in range(rounds):
        centroids = moved(kept, centroids, wide)
    placed, _ = staged(kept.mapInArrow(_assigned(centroids, dims, wide), out), "assigned")
    # a null distance leaves a null sum; so does a sum beyond a long
    known = F.count("distance") == F.count(F.lit(1))
    totals = placed.groupBy("cluster").agg(F.when(known, F.sum(F.col("distance").cast("decimal(38,0)"))).alias("sum")).collect()
    fits = lambda x: int(x) if x is not None and x < 1 << 63 else None
    inertia = fits(None if any(r["sum"] is None for r in totals) else sum(r["sum"] for r in totals))
    hashes = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    named = spark.createDataFrame([(r["cluster"], fits(r["sum"]), inertia, hashes[r["cluster"]]) for r in totals], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most a row a centroid
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
