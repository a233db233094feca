"""MinHash near-duplicates by an LSH forest.

Each distinct shingle set gets a label a tree: the minima of a few hash functions. A tree is the order of
all labels. Neighbours in an order that share a prefix of at least ``LEAST`` minima are candidates. Regions
(runs that share a prefix) which still hold several components after that are completed: a region is
taken at the smallest depth where it has at most ``REGION`` members and all its pairs across components
are candidates; members of regions too large at the first depth are joined exactly by their rarest
shingles. Every candidate is confirmed on the full sets.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import drop_scratch, skew_safe_lookup, staged, unused_name

TREES, DEPTH, LEAST = 20, 6, 4
#: Trees whose neighbours are confirmed first; the others then add pairs across components only.
FIRST = 4
REGION = 64
#: Rows a partition of the tree orders.
PART_ROWS = 1_000_000
PERCENT = 80
#: So many contracted links, at most, are united in one task (16 MB of ids); more take star steps.
UNITED_LINKS = 1 << 20
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_STEP = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct ``size``-word shingles of a whole text, A-Z as a-z.

    A text of fewer words is one shingle; null texts and texts without words have none.
    """
    words = _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total = (total ^ (total >> np.uint64(31))) * _STEP[i % len(_STEP)] + hashed[i : i + n]
    total ^= total >> np.uint64(29)
    total *= _STEP[1]
    total ^= total >> np.uint64(32)
    return np.unique(total)


@functools.cache
def _family(n: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def labels(found: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> bytes:
    """The labels of all trees in a row: ``depth`` minima each, big-endian."""
    a, b = _family(trees * depth)
    low = np.full(trees * depth, 0xFFFFFFFF, np.uint32)
    short = (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(short), 1024):
        part = short[at : at + 1024, None] * a + b
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(low, part.min(axis=0), out=low)
    return low.astype(">u4").tobytes()


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("labels", pa.binary())])
_SIGNED_SQL = "doc_id long, n_shingles long, k1 long, k2 long, labels binary"


def _sign(size: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = shingles(text, size)
                    k1, k2 = np.frombuffer(hashlib.blake2b(found.tobytes(), digest_size=16).digest(), "<i8").tolist()
                    rows.append((doc_id, len(found), k1, k2, labels(found) if len(found) else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SIGNED)], schema=_SIGNED)

    return sign


def _sets(size: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [shingles(t, size).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return sets


_TREE = "tree int, l1 long, l2 long, l3 long, rep long, n long"


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a tree for each (rep, n, labels); a label is three longs, two minima each, that sort as it does."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            minima = np.frombuffer(b"".join(part.column(2).to_pylist()), ">u4").astype(np.uint64).reshape(-1, 3, 2)
            longs = ((minima[:, :, 0] << np.uint64(32) | minima[:, :, 1]) ^ np.uint64(1 << 63)).view(np.int64)
            each = [np.repeat(part.column(c).to_numpy(), TREES) for c in (0, 1)]
            trees = np.tile(np.arange(TREES, dtype=np.int32), part.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (trees, *longs.T, *each)], names=[x.split()[0] for x in _TREE.split(", ")])


_ORDERED = f"{_TREE}, prev long, prev_n long, first boolean, last boolean, part int"


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the tree orders that share LEAST minima with a neighbour, with the row before them where it does.

    A partition's first and last row are always given, marked as such.
    """
    part, names = TaskContext.get().partitionId(), [x.split()[0] for x in _ORDERED.split(", ")]

    def given(columns: list[np.ndarray], same: np.ndarray, shown: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        n, ends = int(shown.sum()), [np.zeros(len(same), bool), np.zeros(len(same), bool)]
        ends[0][:1], ends[1][-1:] = first, last
        kept = [pa.array(c[shown]) for c in columns[:6]] + [pa.array(c[shown], mask=~same[shown]) for c in columns[6:]]
        return pa.RecordBatch.from_arrays([*kept, *(pa.array(e[shown]) for e in ends), pa.array(np.full(n, part, np.int32))], names=names)

    held, held_same, begun = None, None, False  # the last row so far waits for the one after it
    for batch in batches:
        if not batch.num_rows:
            continue
        fresh = [c.to_numpy() for c in batch.columns]
        fresh += [np.zeros(batch.num_rows, np.int64)] * 2
        columns = fresh if held is None else [np.concatenate(c) for c in zip(held, fresh)]
        same = np.zeros(len(columns[0]), bool)
        same[1:] = (columns[0][1:] == columns[0][:-1]) & (columns[1][1:] == columns[1][:-1]) & (columns[2][1:] == columns[2][:-1])
        for to, of in ((6, 4), (7, 5)):
            columns[to] = np.concatenate([columns[to][:1], columns[of][:-1]])
        if held is not None:
            same[0] = held_same[0]
        shown = same[:-1] | same[1:]
        shown[:1] |= not begun
        if len(shown):
            yield given([c[:-1] for c in columns], same[:-1], shown, not begun, False)
            begun = True
        held, held_same = [c[-1:] for c in columns], same[-1:]
    if held is not None:
        yield given(held, held_same, np.ones(1, bool), not begun, True)


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as stars: each node with the smallest node it reaches in the partition."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(u), root(v)
            if a != b:
                up[max(a, b)] = min(a, b)
    stars = [(x, r) for x in list(up) if (r := root(x)) != x]
    for at in range(0, len(stars), 1 << 16):
        part = stars[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.int64()), pa.array([r for _, r in part], pa.int64())], names=["u", "v"])


def components(links: DataFrame, united_links: int = UNITED_LINKS) -> DataFrame:
    """node, comp: the smallest node that each node of links (u, v) reaches, itself included.

    Links are contracted to stars inside partitions. If at most ``united_links`` are left, one task unites
    them; otherwise alternating large-star and small-star steps run until nothing changes, each written to
    the shared folder.
    """
    spark = links.sparkSession
    both = links.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).filter("u <> v")
    edges, path = staged(both.repartition("u").mapInArrow(_united, "u long, v long"), "links")
    left = edges.count()
    if not left:
        return spark.createDataFrame([], "node long, comp long")
    if left <= united_links:
        after, _ = staged(edges.coalesce(1).mapInArrow(_united, "u long, v long"), "stars")
        drop_scratch(path)
        return _named(after)
    edges, seen = edges.distinct(), None
    while True:
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after, after_path = staged(small, "stars")
        drop_scratch(path)
        edges, path = after, after_path
        mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return _named(edges)
        seen = mark


def _named(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _alike(a: str, b: str, percent: int) -> F.Column:
    """Two set sizes that a similarity of percent allows."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union, as links (u, v)."""
    one = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    held = pairs.join(one, "a").join(two, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - shared
    return held.filter(shared * 100 >= union * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a <> b").distinct()


def _region(depth: int) -> F.Column:
    return F.xxhash64("tree", "l1", "l2", *([F.shiftright("l3", 32)] if depth == 5 else [F.col("l3")] if depth == 6 else []))


def _with_comp(df: DataFrame, comp: DataFrame, node: str, out: str) -> DataFrame:
    named = comp.select(F.col("node").alias(node), F.col("comp").alias(out))
    return df.join(named, node, "left").withColumn(out, F.coalesce(out, node))


def _completions(members: DataFrame, percent: int, region: int) -> tuple[DataFrame, DataFrame]:
    """Pairs across components inside regions of at most ``region`` members, at the first depth where they
    are so small, and the members of mixed regions that are larger at the first depth."""
    found = large = None
    left, total = members, members.count()
    for depth in range(LEAST, DEPTH + 1):
        keyed = left.withColumn("key", _region(depth))
        about = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("g"), F.min("comp").alias("low"), F.max("comp").alias("high"))
        mixed, _ = staged(about.filter("low <> high").select("key", "g", F.col("g").alias("size")), "mixed-regions")
        held = skew_safe_lookup(keyed, F.col("rep"), mixed, ["key"], "g", "size", total).filter("g IS NOT NULL")
        listed = held.filter(F.col("g") <= region).groupBy("key").agg(F.collect_list(F.struct("rep", "n", "comp")).alias("all"))
        two = listed.select(F.col("all"), F.explode("all").alias("x")).select("x", F.explode("all").alias("y"))
        two = two.filter("x.rep < y.rep AND x.comp <> y.comp").select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        two = two.filter(_alike("na", "nb", percent)).select("a", "b")
        found = two if found is None else found.unionByName(two)
        left = held.filter(F.col("g") > region).drop("key", "g")
        if depth == LEAST:
            left, _ = staged(left, "large-regions")
            large = left.select("rep", "comp").distinct()
            if left.isEmpty():
                break
    return found.distinct(), large


def _cells(found: np.ndarray, bits: int) -> np.ndarray:
    return ((found.view(np.uint64) * _STEP[0]) >> np.uint64(64 - bits)).astype(np.int64)


def _tallied(bits: int):
    """A partition's sets as one table of counts: in each of 2^bits cells, how many shingles fall there."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint32)
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy()
            for at in range(0, len(flat), 1 << 20):
                np.add.at(counts, _cells(flat[at : at + (1 << 20)], bits), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(counts, 65535).astype(np.uint16).tobytes()], pa.binary())], names=["counts"])

    return tally


def _tally(sets: DataFrame, bits: int) -> np.ndarray:
    """Counts of all shingles by cell, up to 65535: at most 8 MB, added up in the executors level by level."""

    def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.minimum(a.astype(np.uint32) + b, 65535).astype(np.uint16)

    parts = sets.mapInArrow(_tallied(bits), "counts binary").rdd.map(lambda r: np.frombuffer(bytes(r[0]), np.uint16))
    return parts.treeReduce(added, depth=3)


_PREFIX = "rep long, comp long, csize long, n long, cap long, short boolean, s long"


def _prefixes(counts: np.ndarray, bits: int, percent: int):
    """Of each set (rep, shingles, comp, csize) the shingles that a partner must meet.

    Shingles are ordered by their cell's count, then by themselves, the same way in all sets. Of n, the first
    n - ceil(percent n / 100) + 1 must meet those of any partner; the smaller set of a pair, and both if they
    are equal in size, must meet the other in a shorter prefix yet (``short``). A count of one means that no
    other set has the shingle, so such shingles are left out; ``cap`` is how many others there are.
    """
    names = [x.split()[0] for x in _PREFIX.split(", ")]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list[np.ndarray]] = []
            for rep, found, comp, csize in zip(*(batch.column(c) if c == 1 else batch.column(c).to_pylist() for c in range(4))):
                own = found.values.to_numpy()
                n, often = len(own), counts[_cells(own, bits)]
                cap = int((often > 1).sum())
                if cap * 100 < n * percent:
                    continue
                order = np.lexsort((own, often))[: n - -(-n * percent // 100) + 1]
                at = np.flatnonzero(often[order] > 1)
                short = at <= n - -(-2 * n * percent // (100 + percent))
                rows.append([np.full(len(at), x) for x in (rep, comp, csize, n, cap)] + [short, own[order[at]]])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=names)

    return prefixes


def _reach(cap, n, least_n, percent: int) -> F.Column:
    """Whether an intersection of at most ``cap`` can reach the percentage for sizes n and least_n or more."""
    return cap * 100 >= (n + least_n - cap) * percent


def _verify(percent: int):
    """Links between the members of a component's chunk and the outsiders that may link to it."""

    def verify(key: tuple, members: pd.DataFrame, outsiders: pd.DataFrame) -> pd.DataFrame:
        links: list[tuple[int, int]] = []
        if len(members) and len(outsiders):
            sets = [np.asarray(s) for s in members["shingles"]]
            sizes = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            reps = members["rep"].to_numpy()
            for rep, own in zip(outsiders["rep"].tolist(), outsiders["shingles"]):
                own = np.asarray(own)
                lo, hi = np.searchsorted(flat, own), np.searchsorted(flat, own, side="right")
                hit = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
                shared = np.bincount(owner[hit], minlength=len(sets))
                near = np.flatnonzero(shared * 100 >= (sizes + len(own) - shared) * percent)
                links += [(rep, int(reps[k])) for k in near[:1]]  # one link joins the two components
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return verify


#: Members of a component that a task holds at once, and outsiders that it compares with them.
CHUNK, ASKING = 256, 1024


def _rarest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) that join members' components, found exactly.

    Members of the smaller component ask the chunks of the larger one whose prefixes their own prefix meets,
    if the counts allow the percentage at all; question and chunk come together as whole sets, and never all pairs.
    """
    sizes = members.groupBy("comp").agg(F.count_distinct("rep").alias("csize"))
    held, path = staged(sets.join(members.join(sizes, "comp"), "rep").select("rep", "shingles", "comp", "csize"), "large-sets")
    again = held.sparkSession.read.schema(held.schema).parquet(path)  # the other side of the cogroup
    listed = held.agg(F.sum(F.size("shingles"))).first()[0] or 0
    bits = min(22, max(16, math.ceil(math.log2(4 * listed + 1))))
    counts = _tally(held.select("shingles"), bits)
    first, _ = staged(held.mapInArrow(_prefixes(counts, bits, percent), _PREFIX), "rare-shingles")
    chunk = F.pmod(F.xxhash64("rep"), F.ceil(F.col("csize") / CHUNK)).cast("int")
    asked = first.withColumn("chunk", chunk).groupBy("s", F.col("comp").alias("to"), "chunk", F.col("csize").alias("tsize"))
    asked = asked.agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max("cap").alias("tcap"), F.bool_or("short").alias("tshort"))
    cap = F.least("cap", "tcap")
    smaller = (F.col("csize") < F.col("tsize")) | ((F.col("csize") == F.col("tsize")) & (F.col("comp") < F.col("to")))
    fits = (F.col("least") * percent <= F.col("n") * 100) & (F.col("most") * 100 >= F.col("n") * percent) & _reach(cap, F.col("n"), F.greatest(F.col("least"), F.ceil(F.col("n") * percent / 100)), percent)
    fits = fits & ((F.col("n") > F.col("least")) | F.col("short")) & ((F.col("n") < F.col("most")) | F.col("tshort"))
    questions, _ = staged(first.join(asked, "s").filter(smaller & fits).select("rep", "to", "chunk").distinct(), "questions")
    per, _ = staged(questions.groupBy("to", "chunk").agg(F.ceil(F.count(F.lit(1)) / ASKING).cast("int").alias("parts")), "asked")
    inside = held.withColumn("chunk", chunk).withColumnRenamed("comp", "to").join(per, ["to", "chunk"])
    inside = inside.select("to", "chunk", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "shingles")
    outside = questions.join(per, ["to", "chunk"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    outside = outside.select("to", "chunk", "part", "rep").join(again.select("rep", "shingles"), "rep")
    keys = ("to", "chunk", "part")
    return inside.groupBy(*keys).cogroup(outside.groupBy(*keys)).applyInPandas(_verify(percent), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", region: int = REGION, first: int = FIRST) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: groups of documents linked by shingle-set similarity.

    Sets are distinct ``size``-word shingles of whole texts with A-Z lower-cased. A component is named by
    its smallest doc_id, whose document is kept. Null texts and texts without words have no set and stand
    alone. Equal sets are one class from the start, so copies are never paired with each other. Rows that
    repeat a doc_id are one document, which links with whatever any of its texts links with (a row of it
    without words names its own id). A row with a null id links nothing and is always kept; it names the
    component of its text. An empty table gives an empty result; other columns are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signed, _ = staged(rows.mapInArrow(_sign(size), _SIGNED_SQL), "signatures")
    known = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("labels").alias("labels"))
    classes, _ = staged(classes, "classes")
    found = known.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high"))
    several = found.filter("low <> high").select("doc_id")
    links, _ = staged(known.join(several, "doc_id").join(classes, ["k1", "k2"]).select(F.col("doc_id").alias("u"), F.col("rep").alias("v")), "repeated-ids")

    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(TREES * classes.count() / PART_ROWS))
    # a set links to a different one only if it reaches the percentage with one shingle more: at 80 percent, from 4 on
    forest = classes.filter(F.col("n") * (100 - percent) >= percent).select("rep", "n", "labels").mapInArrow(_planted, _TREE)
    order = ("tree", "l1", "l2", "l3", "rep")
    walked, walked_path = staged(forest.repartitionByRange(n_parts, *order).sortWithinPartitions(*order).mapInArrow(_neighbours, _ORDERED), "orders")
    # the rows at the edges of partitions, two a partition, meet here
    ends = walked.filter("first OR last").collect()
    firsts, lasts = ({r["part"]: r for r in ends if r[mark]} for mark in ("first", "last"))
    parts = sorted(firsts)
    edges = [(lasts[p], firsts[q]) for p, q in zip(parts, parts[1:])]
    met = [(y["rep"], y["n"], x["rep"], x["n"], x["tree"]) for x, y in edges if (x["tree"], x["l1"], x["l2"]) == (y["tree"], y["l1"], y["l2"])]
    across = spark.createDataFrame(met, "rep long, n long, prev long, prev_n long, tree int")
    chained = walked.filter("prev IS NOT NULL").select("rep", "n", "prev", "prev_n", "tree").unionByName(across)
    chained = chained.filter(_alike("n", "prev_n", percent))

    near = walked.select("rep").distinct()
    texts = rows.join(near.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets, sets_path = staged(texts.mapInArrow(_sets(size), "rep long, shingles array<long>"), "sets")

    one, _ = staged(confirmed(_pairs(chained.filter(F.col("tree") < first), "rep", "prev"), sets, percent), "links-1")
    links = links.unionByName(one)
    comp, _ = staged(components(links), "comp-1")
    rest = _pairs(chained.filter(F.col("tree") >= first), "rep", "prev")
    rest = _with_comp(_with_comp(rest, comp, "a", "ca"), comp, "b", "cb").filter("ca <> cb").select("a", "b")
    more, _ = staged(confirmed(rest, sets, percent), "links-2")
    if not more.isEmpty():
        links = links.unionByName(more)
        comp, _ = staged(components(links), "comp-2")

    members, members_path = staged(_with_comp(walked.select(*order, "n"), comp, "rep", "comp"), "members")
    pairs, large = _completions(members, percent, region)
    last = confirmed(pairs, sets, percent)
    if not large.isEmpty():
        last = last.unionByName(_rarest(large, sets, percent))
    last, _ = staged(last, "links-3")
    if not last.isEmpty():
        comp, _ = staged(components(links.unionByName(last)), "comp-3")

    for path in (walked_path, sets_path, members_path):  # all links are written by now
        drop_scratch(path)
    named = _with_comp(classes.select("k1", "k2", "rep", "copies"), comp, "rep", "component_id")
    total = signed.count()
    with_set, without = (signed.filter(c).select("doc_id", "n_shingles", "k1", "k2") for c in ("n_shingles > 0", "n_shingles = 0"))
    out = skew_safe_lookup(with_set, F.col("doc_id"), named.select("k1", "k2", "component_id", "copies"), ["k1", "k2"], "component_id", "copies", total)
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(without.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the documents that are near-duplicates of an earlier id, with the columns of docs."""
    found, gone = near_duplicates(docs, size, percent, doc_id, text), unused_name(docs, "gone")
    dropped = found.filter(~F.col("kept")).select(F.col("doc_id").alias(gone)).distinct()
    return docs.join(dropped, F.col(doc_id) == F.col(gone), "left_anti")
