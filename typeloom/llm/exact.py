"""Exact deduplication by Grace hash partitioning.

Records are dealt to buckets by a hash of their text; a bucket goes through an open-addressing table that
compares complete texts. A table takes new texts until its bytes are used up; the records of the others are
written to spill files in the shared folder and dealt again by another hash, level by level, until every
bucket fits. Before anything is dealt, each task folds the copies among its own rows in such a table, so a
text costs a record a task at most however many copies it has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import drop_scratch, skew_safe_lookup, staged

#: Bytes of texts that a table holds; a bucket is meant to fill half of that.
TABLE_BYTES = 64 << 20

#: Bytes of texts in one batch that a task hands on.
BATCH_BYTES = 8 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_RECORD = "digest binary, content string, last {}, n long"


class ContentTable:
    """Texts with their largest id and number of rows: open addressing, linear probing, at most half full."""

    def __init__(self, limit: int):
        self.limit, self.held = limit, 0
        self.slots: list[int] = [-1] * 1024
        self.digests: list[bytes] = []
        self.contents: list[str] = []
        self.last: list = []
        self.n: list[int] = []

    def _place(self, digest: bytes) -> int:
        return int.from_bytes(digest[-8:], "little") & (len(self.slots) - 1)

    def add(self, digest: bytes, content: str, last, n: int) -> bool:
        """Count a record in; False if its text is new and the table is full. An empty table takes any text."""
        at = self._place(digest)
        while (entry := self.slots[at]) >= 0:
            if self.digests[entry] == digest:
                if self.contents[entry] != content:
                    raise ValueError(f"two different texts have the SHA-256 {digest.hex()}")
                self.n[entry] += n
                if last is not None and (self.last[entry] is None or last > self.last[entry]):
                    self.last[entry] = last
                return True
            at = (at + 1) & (len(self.slots) - 1)
        size = 4 * len(content) + 200  # with its objects, at the widest characters
        if self.contents and self.held + size > self.limit:
            return False
        self.held += size
        self.slots[at] = len(self.contents)
        for column, value in ((self.digests, digest), (self.contents, content), (self.last, last), (self.n, n)):
            column.append(value)
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        for entry, digest in enumerate(self.digests):
            at = self._place(digest)
            while self.slots[at] >= 0:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at] = entry


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(digest, content, last, n) of each row, a few at a time as Python objects."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(i, 256).columns))


class _Out:
    """Rows gathered into batches of bounded bytes."""

    def __init__(self, kind: pa.DataType):
        self.schema = pa.schema([("digest", pa.binary()), ("content", pa.string()), ("last", kind), ("n", pa.int64())])
        self.rows: list[tuple] = []
        self.held = 0

    def put(self, digest: bytes, content: str | None, last, n: int) -> Iterator[pa.RecordBatch]:
        self.rows.append((digest, content, last, n))
        self.held += len(content or "") + 64
        if self.held > BATCH_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.held = [], 0


def _folded(limit: int, kind: pa.DataType):
    """A task's own copies as one record a text; a full table is handed on and begun anew."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, table = _Out(kind), ContentTable(limit)
        for record in _records(batches):
            if not table.add(*record):
                for row in zip(table.digests, table.contents, table.last, table.n):
                    yield from out.put(*row)
                table = ContentTable(limit)
                table.add(*record)
        for row in zip(table.digests, table.contents, table.last, table.n):
            yield from out.put(*row)
        yield from out.flush()

    return fold


def _matched(limit: int, kind: pa.DataType):
    """A bucket's texts, each as one row without its text; the records of texts that found no room keep theirs."""

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, table = _Out(kind), ContentTable(limit)
        for record in _records(batches):
            if not table.add(*record):
                yield from out.put(*record)
        for digest, last, n in zip(table.digests, table.last, table.n):
            yield from out.put(digest, None, last, n)
        yield from out.flush()

    return match


def distinct_texts(records: DataFrame, total_bytes: int, table_bytes: int = TABLE_BYTES) -> DataFrame:
    """digest, last, n: one row a text of records (digest, content, last, n), compared in full.

    Every level settles at least one text a bucket, and deals the rest to as many buckets as their bytes ask for.
    """
    kind = records.schema["last"].dataType.simpleString()
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[kind]
    schema = _RECORD.format(kind)
    left, found, level = records.mapInArrow(_folded(table_bytes // 2, arrow), schema), None, 0
    while True:
        buckets = max(1, math.ceil(2 * total_bytes / table_bytes))
        bucket = F.pmod(F.xxhash64(F.lit(level), "digest"), F.lit(buckets)).cast("int")
        spill, _ = staged(left.repartitionById(buckets, bucket).mapInArrow(_matched(table_bytes, arrow), schema), f"spill-{level}")
        done = spill.filter("content IS NULL").select("digest", "last", "n")
        found = done if found is None else found.unionByName(done)
        left = spill.filter("content IS NOT NULL")
        total_bytes = left.agg(F.sum(F.octet_length("content"))).first()[0]
        if not total_bytes:
            return found
        level += 1


def normalised(text: Column) -> Column:
    """A text with A-Z lower-cased and nothing else changed; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of each row: groups of texts equal but for the case of A-Z.

    The row of the largest doc_id stays, with all rows that repeat that id. Null texts count as empty, and are
    copies of the empty ones. A row without an id never stays beside one that has it; a group of such rows only has
    no keep_id, and they all stay. Ids are integers or strings. An empty table gives an empty result; other
    columns are left out, whatever their names.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.col(text)).alias("content"))
    digest = F.unhex(F.sha2(F.col("content").cast("binary"), 256))
    keyed, _ = staged(rows.select("doc_id", digest.alias("digest"), F.octet_length("content").cast("long").alias("bytes")), "digests")
    total, total_bytes = keyed.agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    records = rows.select(digest.alias("digest"), "content", F.col("doc_id").alias("last"), F.lit(1).cast("long").alias("n"))
    groups = distinct_texts(records, total_bytes, table_bytes).filter("n > 1")
    groups = groups.select("digest", "n", F.struct("last", "n").alias("group"))
    found = skew_safe_lookup(keyed, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), groups, ["digest"], "group", "n", total)
    keep = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("group.last"))
    sized = found.select("doc_id", keep.alias("keep_id"), F.coalesce("group.n", F.lit(1).cast("long")).alias("group_size"), "digest")
    return sized.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """docs without the copies: the rows that ``exact_groups`` keeps, with all their columns."""
    groups = exact_groups(docs, doc_id, text, **options).filter("kept").select(F.col("doc_id").alias("_typeloom_id"), "text_sha256").distinct()
    same = F.col(doc_id).eqNullSafe(F.col("_typeloom_id")) & (F.sha2(normalised(F.col(text)).cast("binary"), 256) == F.col("text_sha256"))
    return docs.join(groups, same, "left_semi")
