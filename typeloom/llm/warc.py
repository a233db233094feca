"""WARC archives with a salvage reader.

The writer makes one gzip member a record; of equal payloads the one of smallest id is a response and
the others revisit it. The reader checks every record (member checksum, version line, length, block
digest). After a failed check it searches for the next valid member or version line, goes on there, and
reports the bytes between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.common import scratch_path, skew_safe_lookup, staged
from typeloom.llm.tokenfiles import open_store

DATE = "2020-01-01T00:00:00Z"
SPLIT_BYTES = 64 << 20
_ID = "urn:page:"
#: What stands for a null page_id.
_NO_ID = "null"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HEAD_STOP = re.compile(rb"\r\n[^:]*?\r\n")  # the empty line, or a line that is none of a header
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head only, whose Content-Length is the payload's."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_ID}{_NO_ID if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_REVISIT}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


@dataclass
class Record:
    offset: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


@dataclass
class Gap:
    offset: int
    end: int
    reason: str


class _Damaged(Exception):
    pass


@dataclass
class _Content:
    """A member's content as a source."""

    data: bytes

    def size(self) -> int:
        return len(self.data)

    def read_at(self, n: int, pos: int) -> bytes:
        return self.data[pos : pos + n]


class SalvageReader:
    """Records and gaps of an archive, of those that begin in [first, last); plain or gzip by member.

    ``source`` has read_at(n, offset) and size(). Only a window of the archive is held in memory.
    """

    WINDOW = 1 << 20

    def __init__(self, source, first: int = 0, last: int | None = None):
        self.source, self.size = source, source.size()
        self.first, self.last = first, min(self.size, self.size if last is None else last)
        self.at, self.window = 0, b""

    def _bytes(self, pos: int, n: int) -> bytes:
        lo = pos - self.at
        if lo < 0 or lo + n > len(self.window):
            self.at, self.window = pos, self.source.read_at(min(max(n, self.WINDOW), max(0, self.size - pos)), pos)
            lo = 0
        return self.window[lo : lo + n]

    def __iter__(self) -> Iterator[Record | Gap]:
        pos = self.first
        if pos:
            pos = self._search(pos)
        while pos < self.last:
            try:
                record = self._record(pos)
            except (_Damaged, zlib.error) as error:
                found, end = self._inside(pos) if self._bytes(pos, 3) == _MAGIC else ([], None)
                yield from found
                if end is None:
                    end = self._search(pos + 1)
                    yield Gap(pos, end, str(error))
                pos = end
            else:
                yield record
                pos = record.end

    def _record(self, pos: int) -> Record:
        if self._bytes(pos, 3) == _MAGIC:
            data, end = self._member(pos)
            record = self._parsed(lambda at, n: data[at : at + n], 0, len(data))
            if record.end != len(data):
                raise _Damaged("bytes follow the record in its member")
            return Record(pos, end, record.headers, record.block)
        return self._parsed(self._bytes, pos, self.size)

    def _inside(self, pos: int) -> tuple[list[Record | Gap], int | None]:
        """Records and gaps in a member of more than one record, and its end; all have the member's place.

        The end is None for a member that is broken or holds no record. Of a broken one come the records
        whose digest holds and that further content follows: its checksum cannot speak for the last one.
        """
        unpacker, content, at, broken = zlib.decompressobj(31), bytearray(), pos, False
        try:
            while not unpacker.eof and not broken:
                part = self._bytes(at, min(64, self.size - at))
                broken = not part
                at += len(part)
                content += unpacker.decompress(part)
        except zlib.error:
            broken = True
        end = at - len(unpacker.unused_data)
        events = list(SalvageReader(_Content(bytes(content))))
        records = [x for x in events if isinstance(x, Record) and (not broken or x.end < len(content) and "warc-block-digest" in x.headers)]
        if broken or not records:
            return [Record(pos, end, x.headers, x.block) for x in records], None
        return [Record(pos, end, x.headers, x.block) if isinstance(x, Record) else Gap(pos, end, f"bytes {x.offset} to {x.end} of the member's content: {x.reason}") for x in events], end

    def _member(self, pos: int, most: int | None = None) -> tuple[bytes, int]:
        """A gzip member's content and end; with ``most``, only so many bytes and no checksum."""
        unpacker, out, got, at = zlib.decompressobj(31), [], 0, pos
        while not unpacker.eof:
            part = self._bytes(at, min(1 << 16, self.size - at))
            if not part:
                raise _Damaged("the member is cut off")
            at += len(part)
            out.append(unpacker.decompress(part, most or 0))
            got += len(out[-1])
            if most and got >= most:
                break
        return b"".join(out), at - len(unpacker.unused_data)

    def _parsed(self, read, pos: int, limit: int) -> Record:
        if not _VERSION.match(read(pos, 10)):
            raise _Damaged("no version line")
        stop = self._head_end(read, pos, limit) - pos
        headers = {}
        for line in read(pos, stop).decode("utf-8", "replace").split("\r\n")[1:]:
            name, colon, value = line.partition(":")
            if not colon:
                raise _Damaged("a header line without a colon")
            headers[name.strip().lower()] = value.strip()
        length = headers.get("content-length", "")
        if not re.fullmatch("[0-9]+", length):
            raise _Damaged("no content length")
        begin, size = pos + stop + 4, int(length)
        if begin + size + 4 > limit:
            raise _Damaged("the block is cut off")
        block = read(begin, size + 4)
        if block[size:] != b"\r\n\r\n":
            raise _Damaged("the record does not end where its length says")
        block = block[:size]
        named = headers.get("warc-block-digest", "")
        if named.startswith("sha1:") and named[5:].upper() != digest32(block):
            raise _Damaged("the block digest differs")
        return Record(pos, begin + size + 4, headers, block)

    def _head_end(self, read, pos: int, limit: int) -> int:
        """Where the empty line after a header begins, however long its lines are; read by pieces."""
        at, n = pos, 4096
        while True:
            part = read(at, min(n, limit - at))
            if stop := _HEAD_STOP.search(part):
                if stop[0] != b"\r\n\r\n":
                    raise _Damaged("a header line without a colon")
                return at + stop.start()
            if not part or at + len(part) >= limit:
                raise _Damaged("the header does not end")
            at, n = at + len(part) - 3, min(n * 4, self.WINDOW)

    def _whole(self, pos: int) -> bool:
        """Whether a whole record is at pos, for version lines that follow a cut and not a line's end."""
        try:
            self._parsed(self._bytes, pos, self.size)
        except _Damaged:
            return False
        return True

    def _search(self, pos: int) -> int:
        """The next place of a member that opens a record or of a version line at a line's start; else the end."""
        while pos < self.size:
            part = self._bytes(pos, min(1 << 16, self.size - pos))
            found = [m.start() for m in re.finditer(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n", part)]
            for lo in found:
                at = pos + lo
                if part[lo : lo + 3] == _MAGIC:
                    try:
                        content, _ = self._member(at, 10)
                    except (_Damaged, zlib.error):
                        continue
                    if _VERSION.match(content):
                        return at
                elif at == 0 or self._bytes(at - 1, 1) == b"\n" or self._whole(at):
                    return at
            if len(part) < 1 << 16:
                break
            pos += len(part) - 16
        return self.size


def page_of(record: Record) -> tuple[int | None, int, str, str, int | None]:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record this module wrote."""
    kind = record.headers["warc-type"]

    def number(name: str) -> int | None:
        value = record.headers[name].strip("<>").removeprefix(_ID)
        return None if value == _NO_ID else int(value)

    head, _, payload = record.block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", head)[1])
    if kind == "revisit":
        return number("warc-record-id"), size, record.headers["warc-payload-digest"].removeprefix("sha1:"), kind, number("warc-refers-to")
    if len(payload) != size:
        raise ValueError(f"record at {record.offset}: the payload has {len(payload)} bytes, its head says {size}")
    return number("warc-record-id"), size, digest32(payload), kind, None


def _write(folder: str, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_store(folder)
        task = TaskContext.get()
        name, temp = f"{base}/part-{task.partitionId():06d}.warc.gz", f"{base}/.part-{task.partitionId():06d}-{task.taskAttemptId()}"
        stream, size, counts = None, 0, []
        for batch in batches:
            for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    fs.create_dir(base, recursive=True)
                    stream = fs.open_output_stream(temp)
                payload = (html or "").encode("utf-8", "surrogatepass")
                member = gzip_member(record_bytes(page_id, url, payload, None if first == page_id else first, date))
                stream.write(member)
                counts += [0] * (size // SPLIT_BYTES + 1 - len(counts))
                counts[-1] += 1
                size += len(member)
        if stream is not None:
            stream.close()
            fs.move(temp, name)
            yield pa.RecordBatch.from_pydict({"path": [name], "size": pa.array([size], pa.int64()), "counts": pa.array([counts], pa.list_(pa.int64()))})

    return write


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = DATE, page_id: str = "page_id", url: str = "url", html: str = "html") -> list[tuple[str, int, list[int]]]:
    """Write pages to archives in folder, one a partition; returns their paths, sizes and how many records
    begin in each SPLIT_BYTES of them.

    Null payloads are empty. Of payloads of at least ``least_bytes`` that are equal, the one of the
    smallest page_id is the response. A null page_id is written as such: it refers to the smallest page_id
    with its payload, and is a response if there is none. A repeated row is written again. An empty table
    writes nothing.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(body.cast("binary"))))
    # a small payload is its own group
    rows = rows.withColumn("own", F.when(F.octet_length(body) < least_bytes, F.col("page_id")).otherwise(F.lit(-1)))
    firsts, _ = staged(rows.groupBy("digest", "own").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # a payload that occurs once needs no lookup
    shared = firsts.filter("n > 1")
    found = skew_safe_lookup(rows, F.coalesce("page_id", F.xxhash64("url")), shared, ["digest", "own"], "first", "n", total)
    found = found.select("page_id", "url", "html", F.coalesce("first", "page_id").alias("first"))
    return [(r["path"], r["size"], r["counts"]) for r in found.mapInArrow(_write(folder, date), "path string, size long, counts array<long>").collect()]


_PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_EVENT = f"path string, offset long, end long, reason string, {_PAGE}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _EVENT.split(", ")]
    kinds = [pa.string() if x.split()[1] == "string" else pa.int64() for x in _EVENT.split(", ")]
    for batch in batches:
        for path, first, last, written in zip(*(c.to_pylist() for c in batch.columns)):
            fs, inner = open_store(path)
            rows: list[tuple] = []
            n_pages = 0
            with fs.open_input_file(inner) as file:
                for event in SalvageReader(file, first, last):
                    if isinstance(event, Gap):
                        rows.append((path, event.offset, event.end, event.reason, *[None] * 5))
                    else:
                        try:
                            page = page_of(event)
                        except (KeyError, ValueError, TypeError) as error:
                            rows.append((path, event.offset, event.end, f"not a page: {error}", *[None] * 5))
                        else:
                            rows.append((path, event.offset, event.end, None, *page))
                            n_pages += 1
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows = []
            if written is not None and n_pages != written:
                raise ValueError(f"{path}, bytes {first} to {last}: {written} rows were written, {n_pages} were read back")
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_archives(spark, archives: list[tuple], split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Events of archives (path, size): page rows, and rows with a reason for each quarantined gap.

    Archives packed by member (.gz) are cut into ranges; a range's task reads the records that begin in it. A
    plain archive is one range, read by windows: a payload may hold what looks like a record, and only who comes
    from the record before knows. Where an archive comes with the counts of write_archives and the ranges are theirs, a task fails if it reads another
    number of pages.
    """
    counted = lambda counts, i: counts[i] if i < len(counts) else 0
    step = lambda path, size: split_bytes if path.endswith(".gz") else max(1, size)
    ranges = [(path, at, min(size, at + step(path, size)), counted(counts[0], at // split_bytes) if counts and split_bytes == SPLIT_BYTES else None) for path, size, *counts in archives for at in range(0, size, step(path, size))]
    rows = spark.createDataFrame(ranges, "path string, first long, last long, written long")
    if ranges:
        rows = rows.repartition(len(ranges))
    return rows.mapInArrow(_read, _EVENT)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Pages as the archives hold them: written to the shared folder and read back, each row or an error."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    events = read_archives(spark, write_archives(pages, folder, **options))
    return events.filter("reason IS NULL").select(*[x.split()[0] for x in _PAGE.split(", ")])
