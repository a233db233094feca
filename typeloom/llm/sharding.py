"""Sharding by Karmarkar-Karp differencing.

Groups of equal texts are indivisible. Groups are dealt to buckets by hash; inside a bucket, partial
partitions (one load a shard) are combined, those of largest spread first and oppositely ordered. The
buckets' partial partitions are then combined in the same way, level by level.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import gapless_slots, skew_safe_lookup, staged, text_key

BUCKET_GROUPS = 20_000
NODE_PARTS = 256


def difference(partials: Sequence[Sequence[int]]) -> list[list[int]]:
    """For partial partitions of k loads each: for each of them, the final bin of each of its loads.

    The two of largest spread are combined, the largest load of one with the smallest of the other,
    until one is left. Ties fall to the earlier one, so the result depends on the order given only.
    """
    k = len(partials[0])
    heap = []
    members: list[object] = []
    for i, loads in enumerate(partials):
        order = sorted(range(k), key=lambda b: (-loads[b], b))
        top = tuple(loads[b] for b in order)
        heap.append((top[-1] - top[0], i, top, tuple((i, b) for b in order)))
    heapq.heapify(heap)
    after = len(partials)
    while len(heap) > 1:
        _, _, loads, bins = heapq.heappop(heap)
        _, _, more, others = heapq.heappop(heap)
        joined = [(x + y, j) for j, (x, y) in enumerate(zip(loads, reversed(more)))]
        joined.sort(key=lambda p: (-p[0], p[1]))
        top = tuple(p[0] for p in joined)
        node = tuple((-1, bins[j], others[k - 1 - j]) for _, j in joined)
        heapq.heappush(heap, (top[-1] - top[0], after, top, node))
        after += 1
    members = list(heap[0][3])
    out = [[0] * k for _ in partials]
    for final, root in enumerate(members):
        stack = [root]
        while stack:
            node = stack.pop()
            if node[0] == -1:
                stack.append(node[1])
                stack.append(node[2])
            else:
                out[node[0]][node[1]] = final
    return out


def _bucket(k: int):
    def pack(groups: pd.DataFrame) -> pd.DataFrame:
        groups = groups.sort_values(["bytes", "k1", "k2"], ascending=[False, True, True], ignore_index=True)
        sizes = groups["bytes"].tolist()
        found = difference([[s] + [0] * (k - 1) for s in sizes])
        return groups.assign(bin=[bins[0] for bins in found])

    return pack


def _combine(k: int):
    def pack(parts: pd.DataFrame) -> pd.DataFrame:
        loads: dict[int, list[int]] = {}
        for node, b, size in sorted(zip(parts["node"].tolist(), parts["bin"].tolist(), parts["bytes"].tolist())):
            loads.setdefault(node, [0] * k)[b] = size
        nodes = list(loads)
        found = difference(list(loads.values()))
        rows = [(n, b, int(parts["parent"].iat[0]), to[b], loads[n][b]) for n, to in zip(nodes, found) for b in range(k)]
        return pd.DataFrame(rows, columns=["node", "bin", "parent", "to", "bytes"])

    return pack


def shard_groups(groups: DataFrame, shards: int = 16, bucket_groups: int = BUCKET_GROUPS, node_parts: int = NODE_PARTS) -> DataFrame:
    """groups (k1, k2, bytes, n), one row a group, with its shard."""
    total = groups.count()
    buckets = max(1, math.ceil(total / bucket_groups))
    dealt = groups.withColumn("bucket", F.pmod(F.col("k1"), F.lit(buckets)).cast("long"))
    schema = "k1 long, k2 long, bytes long, n long, bucket long, bin int"
    placed, _ = staged(dealt.select("k1", "k2", "bytes", "n", "bucket").groupBy("bucket").applyInPandas(_bucket(shards), schema), "kk-groups")
    parts = placed.groupBy(F.col("bucket").alias("node"), "bin").agg(F.sum("bytes").alias("bytes"))
    final = None  # of a bucket's bin: the node and bin it has come to
    left = buckets
    while True:
        left = math.ceil(left / node_parts)
        up = parts.withColumn("parent", F.floor(F.col("node") / node_parts).cast("long"))
        step, _ = staged(up.groupBy("parent").applyInPandas(_combine(shards), "node long, bin int, parent long, to int, bytes long"), "kk-level")
        links = step.select(F.col("node"), F.col("bin"), "parent", "to")
        if final is None:
            final = links.select(F.col("node").alias("bucket"), F.col("bin"), F.col("parent").alias("at"), F.col("to").alias("shard"))
        else:
            links = links.select(F.col("node").alias("at"), F.col("bin").alias("shard"), "parent", "to")
            final = final.join(links, ["at", "shard"]).select("bucket", "bin", F.col("parent").alias("at"), F.col("to").alias("shard"))
        if left <= 1:
            break
        parts = step.groupBy(F.col("parent").alias("node"), F.col("to").alias("bin")).agg(F.sum("bytes").alias("bytes"))
    return placed.join(final.select("bucket", "bin", "shard"), ["bucket", "bin"]).select("k1", "k2", "bytes", "n", "shard")


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: documents in shards of near-equal bytes.

    A document's size is the UTF-8 bytes of its text plus 1; null texts count as empty and form one
    group with the empty ones. Equal texts, repeated rows included, share a shard; slots number a
    shard's rows from 0, in the order of chunks by hash. A group larger than a fair share fills one shard. An empty table
    gives an empty result; other columns are left out, whatever their names.
    """
    body: Column = F.coalesce(F.col("_text"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    keyed, _ = staged(rows.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *text_key(body), F.monotonically_increasing_id().alias("row")), "kk-docs")
    groups, _ = staged(keyed.groupBy("k1", "k2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")), "kk-sizes")
    total = keyed.count()
    found = shard_groups(groups, shards)
    placed = skew_safe_lookup(keyed, F.col("doc_id"), found, ["k1", "k2"], "shard", "n", total)
    # the staged table fixes each row's number, which parts the chunks of repeated rows
    return gapless_slots(placed.select("doc_id", "size", "text_crc32", "shard", "row"), "shard", ["doc_id", "text_crc32", "row"], total).drop("row")
