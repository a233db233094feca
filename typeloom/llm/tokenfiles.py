"""Token output in Arrow files.

A corpus is written as parts in document order. Each part is an Arrow IPC file whose record batches
hold two fixed-size-list columns, ids and mask, of equal-length sequences: the ids of the part's documents
in a row, the last sequence padded and masked. Fixed sizes make the place of any sequence
plain arithmetic, so a memory-mapped part is read at random without a copy. Beside each part lies an
index of its documents.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import scratch_path
from typeloom.llm.tokens import encoder

LENGTH = 2048
BATCH_SEQUENCES = 64
END_ID = 2
#: Text bytes a part, at most on average.
PART_BYTES = 256 << 20
_INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def open_store(path: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pa.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pa.fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pa.fs.FileSystem.from_uri(path)


def id_type(vocab_size: int) -> pa.DataType:
    return pa.uint16() if vocab_size <= 1 << 16 else pa.uint32()


def file_schema(ids: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(ids, length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"sequence_length": str(length), "batch_sequences": str(BATCH_SEQUENCES)})


class PartWriter:
    """Writes one part; sequences are flushed as they fill, so memory does not grow with the part."""

    def __init__(self, folder: str, part: int, ids: pa.DataType, length: int = LENGTH):
        self.fs, base = open_store(folder)
        self.fs.create_dir(base, recursive=True)
        self.name, self.length, self.ids = f"{base}/part-{part:06d}", length, ids
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.temp = f"{base}/.part-{part:06d}-{attempt}"
        self.schema = file_schema(ids, length)
        self.dtype = np.dtype(ids.to_pandas_dtype())
        self.files = [self.fs.open_output_stream(self.temp + x) for x in (".arrow", ".docs.arrow")]
        self.writer = pa.ipc.new_file(self.files[0], self.schema)
        self.index = pa.ipc.new_file(self.files[1], _INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.total = 0

    def add(self, docs: list[tuple[int | None, np.ndarray]]) -> None:
        rows = []
        for doc_id, ids in docs:
            rows.append((doc_id, self.total, len(ids)))
            self.total += len(ids)
            self.held.append(ids.astype(self.dtype))
            self.n_held += len(ids)
        self.index.write_batch(pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=_INDEX))
        if self.n_held >= BATCH_SEQUENCES * self.length:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, self.dtype)
        step = BATCH_SEQUENCES * self.length
        end = len(flat) if last else len(flat) - len(flat) % step
        for at in range(0, end, step):
            ids = flat[at : min(at + step, end)]
            n = -(-len(ids) // self.length)
            mask = np.arange(n * self.length) < len(ids)
            padded = np.zeros(n * self.length, self.dtype)
            padded[: len(ids)] = ids
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (padded, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(arrays, schema=self.schema))
        self.held = [flat[end:]] if end < len(flat) else []
        self.n_held = len(flat) - end

    def close(self) -> tuple[str, int]:
        """The part's name without suffix and its number of ids; a rerun of the task replaces the same files."""
        self._flush(True)
        for writer, file in zip((self.writer, self.index), self.files):
            writer.close()
            file.close()
        for suffix in (".docs.arrow", ".arrow"):
            self.fs.move(self.temp + suffix, self.name + suffix)
        return self.name, self.total


def kept(mask: pa.BooleanArray) -> int:
    """How many places a stored mask keeps; they come first, or the file is not what this module writes."""
    n = mask.true_count
    if mask.slice(0, n).true_count != n:
        raise ValueError("a mask keeps places after its padding")
    return n


class PartReader:
    """Random access to a part: local files are memory-mapped, so a sequence is a view of the file."""

    def __init__(self, folder: str, name: str):
        fs, _ = open_store(folder)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        source = (lambda s: pa.memory_map(name + s)) if local else (lambda s: fs.open_input_file(name + s))
        self.file = pa.ipc.open_file(source(".arrow"))
        self.index = pa.ipc.open_file(source(".docs.arrow"))
        meta = self.file.schema.metadata
        self.length, self.per_batch = int(meta[b"sequence_length"]), int(meta[b"batch_sequences"])
        self.step = self.length * self.per_batch
        n_docs = self.index.num_record_batches
        last = self.index.get_batch(n_docs - 1) if n_docs else None
        self.total = last.column(1)[-1].as_py() + last.column(2)[-1].as_py() if n_docs else 0
        #: A mask of n places is a window of this: so many true ones, then false ones.
        self._masks = np.arange(2 * self.length) < self.length
        self._at, self._flat = -1, np.empty(0)

    def arrays(self, i: int) -> tuple[pa.Array, pa.Array]:
        """ids and mask of the part's i-th sequence as they lie in the file."""
        batch, lo = self.file.get_batch(i // self.per_batch), i % self.per_batch
        ids, mask = (batch.column(c).slice(lo, 1).flatten() for c in (0, 1))
        return ids, mask

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """The same as numpy arrays, without a copy.

        The file holds a mask as bits, which numpy has no view of: they are counted and checked, and the mask is a window
        over a template with as many places as the file's has.
        """
        ids, mask = self.arrays(i)
        n = kept(mask)
        return ids.to_numpy(), self._masks[self.length - n : 2 * self.length - n]

    def _batch_ids(self, b: int) -> np.ndarray:
        if b != self._at:
            ids, mask = (c.flatten() for c in self.file.get_batch(b).columns)
            self._at, self._flat = b, ids.to_numpy()[: kept(mask)]
        return self._flat

    def ids(self, start: int, n: int) -> np.ndarray:
        """n ids from the part's place start on."""
        found = []
        while n > 0:
            b, lo = divmod(start, self.step)
            take = self._batch_ids(b)[lo : lo + n]
            if not len(take):
                raise ValueError("the part ends before the document does")
            found.append(take)
            start, n = start + len(take), n - len(take)
        return np.concatenate(found) if len(found) != 1 else found[0]


def _write(folder: str, vocabulary: str, end_id: int, length: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            code = encoder(vocabulary)
            if writer is None:
                writer = PartWriter(folder, TaskContext.get().partitionId(), id_type(code.vocab_size), length)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs = [(d, np.append(np.frombuffer(code.encode(t), dtype="<u4"), np.uint32(end_id))) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                writer.add(docs)
        if writer is not None:
            name, total = writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "total": pa.array([total], pa.int64())})

    return write


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, length: int = LENGTH, parts: int | None = None, doc_id: str = "doc_id", text: str = "text") -> list[tuple[str, int, int]]:
    """Write docs in ascending doc_id order to parts; returns (name, first id's place, ids) of each part.

    Null texts are empty: such documents are their end id. Null ids come first. Every row is written,
    repeated ones too, rows of one id by the hash of their text; an empty table writes no part. Without
    ``parts`` there are as many as shuffle partitions, or more, so that each has some PART_BYTES of text.
    The list has a row a part, not a row a document.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    if parts is None:
        held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(held / PART_BYTES))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = ordered.mapInArrow(_write(folder, vocabulary, end_id, length), "part int, name string, total long").collect()
    out, at = [], 0
    for row in sorted(found, key=lambda r: r["part"]):
        out.append((row["name"], at, row["total"]))
        at += row["total"]
    return out


def _digest(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = PartReader(folder, name)
                for b in range(part.index.num_record_batches):
                    docs = part.index.get_batch(b)
                    starts, sizes = docs.column(1).to_numpy(), docs.column(2).to_numpy()
                    crcs = [zlib.crc32(part.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts.tolist(), sizes.tolist())]
                    yield pa.RecordBatch.from_arrays([docs.column(0), pa.array(starts + first), docs.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_digests(spark, folder: str, parts: list[tuple[str, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the parts alone."""
    rows = spark.createDataFrame([(n, s) for n, s, _ in parts] or [], "name string, first long")
    if parts:
        rows = rows.repartition(len(parts))
    return rows.mapInArrow(_digest(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = END_ID, **options) -> DataFrame:
    """Write docs to a fresh folder in the shared one and digest what the files hold."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read_digests(docs.sparkSession, folder, write_tokens(docs, folder, vocabulary, end_id, **options))
