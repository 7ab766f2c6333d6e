"""WARC archives as a chunked record table: written and read in chunks, with running digests."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from itertools import groupby

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch_path

#: Bytes of payload in one chunk row; also what writer and reader hold of a payload at a time.
CHUNK_BYTES = 1 << 20
#: Bytes read from an archive at a time.
READ_BYTES = 1 << 18
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNKS = "record_id string, page_id long, record_type string, refers_to long, url string, chunk_no long, is_last boolean, payload_bytes long, payload_digest string, data binary"


def _base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def _number(value) -> str:
    return "" if value is None else str(value)


def _header(fields: list[tuple[str, str]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def _clean(url: str | None) -> str:
    return re.sub(r"[\r\n]+", " ", url or "").strip()


def with_references(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload binary, digest, refers_to): which record each page is a revisit of.

    Of equal payloads of at least ``least_bytes`` bytes the smallest page_id is the response. Only the
    digest decides, so the smallest id is pre-aggregated before the shuffle and payloads meet it
    through a join that adaptive execution can split where one payload is very common. Rows that
    repeat that smallest id are all responses.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    first = rows.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")) & (F.length("payload") >= least_bytes)
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def _members(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[Iterator[bytes]]:
    """For each record the pieces of its gzip member; payloads pass through in chunks."""
    count = 0
    for batch in batches:
        for page, url, payload, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
            count += 1

            def pieces(page=page, url=url, payload=payload, digest=digest, refers=refers, count=count) -> Iterator[bytes]:
                data = memoryview(payload.as_buffer())
                label = _base32(bytes.fromhex(digest.as_py()))
                refers = refers.as_py()
                size = 0 if refers is not None else len(data)
                fields = [
                    ("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{part}:{count}:{page.as_py()}')}>"),
                    ("WARC-Date", DATE), ("WARC-Target-URI", _clean(url.as_py())), ("WARC-Payload-Digest", f"sha1:{label}"), ("WARC-Page-ID", _number(page.as_py())),
                    ("WARC-Payload-Length", str(len(data))), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(size)),
                ]
                if refers is not None:
                    fields[1:1] = [("WARC-Profile", PROFILE), ("WARC-Refers-To-Page", str(refers))]
                press = zlib.compressobj(1, zlib.DEFLATED, 31)
                yield press.compress(_header(fields))
                for at in range(0, size, CHUNK_BYTES):
                    yield press.compress(data[at : min(size, at + CHUNK_BYTES)])
                yield press.compress(b"\r\n\r\n") + press.flush()

            yield pieces()


def arrow_opens(uri: str) -> bool:
    """Whether Arrow's file systems reach a folder; else only Spark does."""
    try:
        _open(uri)
    except (pa.ArrowException, OSError):
        return False
    return True


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` of :func:`with_references` as .warc.gz files, one member per record.

    Returns the written (archive, records) table. A task writes under a name of its own attempt, and
    only archives named in the table count, so a repeated task leaves no duplicate records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        sink, count = None, 0
        for member in _members(batches, part):
            if sink is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{base}/{name}", compression=None)
            for piece in member:
                sink.write(piece)
            count += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64())], names=["archive", "records"])

    return cut(records.mapInArrow(run, "archive string, records long"), "archives")


def write_archive_table(records: DataFrame) -> DataFrame:
    """The same archives as a written table (archive, seq, data): their bytes in order of seq.

    For shared folders that only Spark's writers reach; each archive is one task's records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seq, held = 0, bytearray()

        def row(data: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([data], pa.binary())], names=["archive", "seq", "data"])

        for member in _members(batches, part):
            for piece in member:
                held += piece
                if len(held) >= CHUNK_BYTES:
                    yield row(bytes(held))
                    seq, held = seq + 1, bytearray()
        if held:
            yield row(bytes(held))

    return cut(records.mapInArrow(run, "archive long, seq long, data binary"), "archives")


class _Stream:
    """Bytes of a gzip archive of many members, unpacked as they are asked for."""

    def __init__(self, source):
        self.source, self.unpack, self.ready, self.raw = source, zlib.decompressobj(31), b"", b""

    def fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.source.read(READ_BYTES)
                if not self.raw:
                    return False
            out = self.unpack.decompress(self.raw, READ_BYTES)
            self.raw = self.unpack.unconsumed_tail
            if self.unpack.eof:
                self.raw = self.unpack.unused_data
                self.unpack = zlib.decompressobj(31)
            if out:
                self.ready += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.ready.find(mark)) < 0:
            if not self.fill():
                return None
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        if not self.ready and not self.fill():
            raise EOFError("an archive ends inside a record")
        out, self.ready = self.ready[:most], self.ready[most:]
        return out


def records_of(source) -> Iterator[tuple[dict[str, str], Iterator[bytes]]]:
    """(header fields, payload pieces) of each record; the pieces must be read before the next."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        lines = head.decode().split("\r\n")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        left = int(fields["Content-Length"])

        def pieces(left: int = left) -> Iterator[bytes]:
            while left:
                got = stream.take(left)
                left -= len(got)
                yield got

        yield fields, pieces()
        while len(stream.ready) < 4 and stream.fill():
            pass
        stream.ready = stream.ready[4:]


def read_archives(archives: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunk table of all records in ``archives`` (archive): one row per chunk of a payload.

    payload_bytes and payload_digest run along: they cover the chunks so far, so the row marked
    is_last has those of the whole payload. A record without a payload of its own (empty, or a
    revisit) has one row; for a revisit the figures are those its header gives for the full payload.
    ``with_data=False`` leaves the bytes out of the rows.
    """

    def rows_of(source) -> Iterator[tuple]:
        for fields, pieces in records_of(source):
            page = int(fields["WARC-Page-ID"]) if fields["WARC-Page-ID"] else None
            head = (fields["WARC-Record-ID"].strip("<>"), page, fields["WARC-Type"])
            url = fields["WARC-Target-URI"]
            if fields["WARC-Type"] == "revisit":
                yield (*head, int(fields["WARC-Refers-To-Page"]), url, 0, True, int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), b"")
                continue
            digest, total, left, number = hashlib.sha1(), 0, int(fields["Content-Length"]), 0
            held = bytearray()
            for piece in pieces:
                while piece:
                    room = chunk_bytes - len(held)
                    held += piece[:room]
                    piece = piece[room:]
                    if len(held) == chunk_bytes and total + len(held) < left:
                        digest.update(held)
                        total += len(held)
                        yield (*head, None, url, number, False, total, _base32(digest.digest()), bytes(held))
                        number, held = number + 1, bytearray()
            digest.update(held)
            yield (*head, None, url, number, True, total + len(held), _base32(digest.digest()), bytes(held))

    names = [f.name for f in archives.sparkSession.createDataFrame([], CHUNKS).schema]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        if not with_data:
            columns[-1] = [None] * len(rows)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    def batches_of(source) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for row in rows_of(source):
            rows.append(row)
            size += 200 + (len(row[-1]) if with_data else 0)
            if size >= 4 * chunk_bytes or len(rows) >= 5000:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _open(uri)
                with fs.open_input_stream(path, compression=None) as source:
                    yield from batches_of(source)

    def run_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = ((b.column(0)[i].as_py(), b.column(2)[i].as_py()) for b in batches for i in range(b.num_rows))
        for _, own in groupby(pieces, key=lambda p: p[0]):
            yield from batches_of(_Pieces(data for _, data in own))

    if "data" in archives.columns:
        ordered = archives.repartition("archive").sortWithinPartitions("archive", "seq")
        return ordered.select("archive", "seq", "data").mapInArrow(run_table, CHUNKS)
    return archives.select("archive").repartition(max(1, archives.count())).mapInArrow(run, CHUNKS)


class _Pieces:
    """A source whose reads are pieces, one at a time."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces = pieces

    def read(self, _: int) -> bytes:
        return next(self.pieces, b"")


def round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, **columns) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url): pages written and read back.

    Null payloads are empty; null ids keep null; repeated rows are records of their own; an empty
    table writes nothing. Archives go to ``folder``, by default one of the shared folder.
    """
    spark: SparkSession = pages.sparkSession
    folder = folder or scratch_path(spark, "warc")
    records = with_references(pages, least_bytes, **columns).select("page_id", "url", "payload", "digest", "refers_to")
    archives = write_archives(records, folder) if arrow_opens(folder) else write_archive_table(records)
    chunks = read_archives(archives, with_data=False)
    return chunks.where("is_last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
