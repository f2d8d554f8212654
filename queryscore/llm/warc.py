"""WARC archives: a writer that Spark commits, and a splittable reader.

Archives are sequences of gzip members, one record each. The writer hands the members to Spark's
text sink, so files appear by Spark's own commit on any file system. That sink ends every row with
a separator; each member is written without its last byte, which is zero because a member's size
field is below 2^24, and the separator is that zero byte. Larger records are followed by an empty
member, which ends in zeros too.

The reader deals out byte ranges. A task looks for gzip magic in its range, tests each place by
inflating the head of a member there, and reads every record that starts inside the range to its
end, beyond the range where needed. Nothing is assumed about where records start.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queryscore.llm.scratch import kept

MIN_REVISIT_BYTES = 100
RANGE_BYTES = 4 << 20
#: Tasks of a reader; with more ranges than that a task reads several.
MOST_TASKS = 100_000
MAGIC = b"\x1f\x8b\x08"
DATE = "2020-01-01T00:00:00Z"
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_READ = 1 << 18
_HEAD, _PIECE = 1 << 12, 1 << 16

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def with_first(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, payload_digest, payload_bytes, first_id) of every page.

    first_id is the smallest id among pages with the same payload, for payloads of at least
    ``MIN_REVISIT_BYTES``, else null. Digests are grouped with partial sums; only digests that
    occur more than once are joined back, and a hot one is on one side only.
    """
    payload = F.encode(F.coalesce(pages["html"], F.lit("")), "UTF-8")
    rows = pages.select(
        pages["page_id"], pages["url"], pages["html"], F.sha2(payload, 256).alias("payload_digest"),
        F.length(payload).cast("bigint").alias("payload_bytes"),
    )
    groups = kept(
        rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES).groupBy("payload_digest")
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"),
        "payloads",
    )
    return rows.join(groups, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_digest", "payload_bytes", "first_id"
    )


def _record(page_id, url, html, digest, size, first) -> bytes:
    revisit = first is not None and page_id != first
    payload = b"" if revisit else (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    fields = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if url is not None:
        fields.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{first}>",
        ]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _member(record: bytes) -> bytes:
    """A gzip member without its last byte, which is a zero."""
    member = gzip.compress(record, 6, mtime=0)
    if len(record) % (1 << 32) >= 1 << 24:
        member += _EMPTY_MEMBER
    return member[:-1]


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("member", pa.binary())])
    for batch in batches:
        out, held = [], 0
        for row in zip(*[column.to_pylist() for column in batch.columns]):
            out.append(_member(_record(*row)))
            held += len(out[-1])
            if held > _READ:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)
                out, held = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], schema=schema)


def write_archives(pages: DataFrame, path: str) -> None:
    """One record per page; of equal payloads the smallest page_id is a response, the others revisit it.

    A null html is an empty payload. Rows that share the smallest id are responses all; a null id
    is larger than any other. A page id of null is written as an empty name.
    """
    members = with_first(pages).mapInArrow(_members, "member binary")
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").text(path)


class _Source:
    """Reads of a file that mostly go on where the last one ended, from one moving buffer."""

    def __init__(self, file, size: int):
        self.file, self.size = file, size
        self.start, self.data, self.bytes_read = 0, b"", 0

    def at(self, start: int, n: int) -> memoryview:
        """At most ``n`` bytes from ``start`` on; fewer only at the end of the file."""
        n = max(min(n, self.size - start), 0)
        have = self.start + len(self.data)
        if not self.start <= start or start + n > have:
            # what is held is not read again
            self.data = self.data[start - self.start :] if self.start <= start < have else b""
            self.start = start
            self.file.seek(start + len(self.data))
            more = self.file.read(min(max(n - len(self.data), _READ), self.size - start - len(self.data)))
            self.bytes_read += len(more)
            self.data += more
        offset = start - self.start
        return memoryview(self.data)[offset : offset + n]

    def find(self, what: bytes, first: int, behind: int) -> int:
        """The first place of ``what`` in ``[first, behind)``, or -1."""
        while first < behind:
            n = min(_HEAD * 16, behind - first)
            found = bytes(self.at(first, n + len(what) - 1)).find(what)
            if found >= 0:
                return first + found
            first += n
        return -1


def _opened(path: str) -> tuple[pa.NativeFile, int]:
    store, name = pyarrow.fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return store.open_input_file(name), store.get_file_info(name).size


def _is_record(source: _Source, at: int) -> bool:
    """Whether a gzip member that holds a WARC record starts here, judged by inflating its head."""
    try:
        return zlib.decompressobj(31).decompress(source.at(at, _HEAD), 16).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _inflated(source: _Source, at: int) -> tuple[bytes, int]:
    """The member that starts here and the place behind it; an error if it is cut off or does not match its checksum."""
    member, out = zlib.decompressobj(31), []
    while not member.eof:
        piece = source.at(at, _PIECE)
        if not piece:
            raise EOFError("an archive ends inside a record")
        out.append(member.decompress(piece))
        at += len(piece)
    return b"".join(out), at - len(member.unused_data)


def records(source: _Source, first: int, behind: int) -> Iterator[bytes]:
    """The records that start in ``[first, behind)``.

    Behind a record the next one is expected; magic is only searched where none starts.
    """
    at = first
    while (at := source.find(MAGIC, at, behind)) >= 0:
        if _is_record(source, at):
            record, at = _inflated(source, at)
            yield record
        else:
            at += 1


def _parsed(record: bytes) -> tuple:
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    http = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in http.decode().split("\r\n")[1:])}
    number = lambda name: int(x) if (x := fields.get(name, "").strip("<>").rpartition(":")[2]) else None
    kind, digest = fields["warc-type"], fields["warc-payload-digest"].rpartition(":")[2]
    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
    return (
        number("warc-record-id"), fields.get("warc-target-uri"), kind, number("warc-refers-to"), digest,
        int(http["content-length"]), payload if kind == "response" else None,
    )


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
        ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()),
    ])
    for batch in batches:
        for path, first, behind in zip(*[column.to_pylist() for column in batch.columns]):
            file, size = _opened(path)
            with file:
                source, rows, held = _Source(file, size), [], 0
                for record in records(source, first, behind):
                    rows.append(_parsed(record))
                    held += len(rows[-1][-1] or b"")
                    if held > _READ:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def read_archives(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of all archives below ``path`` (columns ``RECORDS``), on a file system that pyarrow knows.

    Each response is checked against its digest. A revisit has the size and digest of the payload
    it refers to and no payload. Every range has a task of its own, up to ``MOST_TASKS``; a task reads
    its ranges and the ends of records that go on behind them, once.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    cut = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(range_bytes).cast("bigint")))
    ranges = files.select("path", "length", cut.alias("first"))
    ranges = ranges.select("path", "first", F.least(F.col("first") + range_bytes, "length").alias("behind"))
    # a given number of tasks is kept: adaptive execution would put a few bytes of ranges into one
    tasks = max(1, min(ranges.count(), MOST_TASKS))
    return ranges.repartition(tasks).mapInArrow(_records, RECORDS)
