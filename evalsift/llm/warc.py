"""WARC archives: written as one gzip stream a file, normalised to one gzip member a record with an offset index, read back.

Files lie in a folder that the driver and all executors share and pyarrow's file systems reach (file, hdfs, s3, gs, abfs).
Every task writes files under names of its own and returns those names in rows, so that what a lost or repeated task has
left is never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, ship, written

#: Payloads below so many bytes are always written out; equal ones from there on are written once.
LEAST_REVISIT = 1000
#: Bytes of a read or of a piece of an inflated stream, and inflated bytes after which a writer begins another file.
PIECE, FILE_BYTES = 1 << 18, 1 << 30
#: Bytes of records that one task reads back.
SLICE = 64 << 20
#: Rows of ids and digests that are broadcast at most (about 100 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
PAGE = "urn:page:"


def file_system(uri: str):
    """(pyarrow file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def head(fields: dict[str, str | int | None], first: str) -> bytes:
    return (first + "".join(f"\r\n{k}: {v}" for k, v in fields.items() if v is not None) + "\r\n\r\n").encode()


def fields_of(data: bytes) -> dict[str, str]:
    """Fields of a head by lower-case name; the first line is ''."""
    lines = data.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def record(page_id: int | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or, with ``refers_to``, a revisit that tells the payload's size and digest alone."""
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = head({"Content-Type": "text/html; charset=utf-8", "Content-Length": len(payload)}, "HTTP/1.1 200 OK")
    revisit = refers_to is not None
    block += b"" if revisit else payload
    said = "" if page_id is None else page_id
    fields = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{PAGE}{said}').urn}>", "WARC-Target-URI": f"{PAGE}{said}", "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None, "WARC-Refers-To-Target-URI": f"{PAGE}{refers_to}" if revisit else None,
        "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response", "Content-Length": len(block),
    }
    return head(fields, "WARC/1.1") + block + b"\r\n\r\n"


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """Pieces of a gzip file of one or many members, inflated in one pass; neither side is held whole."""
    z, data = zlib.decompressobj(31), source.read(PIECE)
    while data:
        piece = z.decompress(data, PIECE)
        if piece:
            yield piece
        data = z.unconsumed_tail
        if z.eof:
            data = z.unused_data.lstrip(b"\0")  # some writers pad with zeros
            z = zlib.decompressobj(31)
        if not data:
            data = source.read(PIECE)
    while piece := z.decompress(b"", PIECE):
        yield piece


class Records:
    """Cuts a stream of pieces into records: heads are read whole, bodies piece by piece."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.rest = pieces, b""

    def head(self) -> bytes | None:
        """The next head with its blank line, or none at the end. Line ends before it are skipped."""
        self.rest = self.rest.lstrip(b"\r\n")
        while (at := self.rest.find(b"\r\n\r\n")) < 0:
            more = next(self.pieces, None)
            if more is None:
                if self.rest.strip(b"\r\n"):
                    raise ValueError("the archive ends within a record's head")
                return None
            self.rest = (self.rest + more).lstrip(b"\r\n")
        found, self.rest = self.rest[: at + 4], self.rest[at + 4 :]
        return found

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.rest:
                self.rest = next(self.pieces, b"")
                if not self.rest:
                    raise ValueError("the archive ends within a record")
            part, self.rest = self.rest[:n], self.rest[n:]
            n -= len(part)
            yield part


def normalise(source: BinaryIO, out: BinaryIO) -> Iterator[tuple[int, int, str, str]]:
    """Rewrites each record of ``source`` as a gzip member of its own; yields (offset, length, type, target) of each."""
    records, offset = Records(inflated(source)), 0
    while (first := records.head()) is not None:
        f = fields_of(first)
        z, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0
        length += out.write(z.compress(first))
        for part in records.body(int(f.get("content-length", 0))):
            length += out.write(z.compress(part))
        length += out.write(z.compress(b"\r\n\r\n") + z.flush())
        yield offset, length, f.get("warc-type", ""), f.get("warc-target-uri", "")
        offset += length


def parse(member: bytes) -> dict:
    """One record from its gzip member: its fields, and size and SHA-1 of its payload (of a revisit: as it tells them)."""
    records = Records(inflated(pa.BufferReader(member)))
    f = fields_of(records.head() or b"")
    http, size, sha = b"", 0, hashlib.sha1()
    for part in records.body(int(f.get("content-length", 0))):
        if http is not None:
            http += part
            at = http.find(b"\r\n\r\n")
            if at < 0:
                continue
            told, part, http = fields_of(http[:at]), http[at + 4 :], None
        size += len(part)
        sha.update(part)
    digest = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
    if f["warc-type"] == "revisit":
        size = int(told["content-length"])
    elif sha.hexdigest() != digest:
        raise ValueError(f"payload of {f['warc-target-uri']} differs from its digest")
    page = lambda uri: int(uri.removeprefix(PAGE)) if uri and uri != PAGE else None
    return {"page_id": page(f["warc-target-uri"]), "payload_bytes": size, "payload_digest": digest, "record_type": f["warc-type"], "refers_to": page(f.get("warc-refers-to-target-uri", ""))}


def first_copies(pages: DataFrame) -> DataFrame:
    """(digest, first): of payloads of LEAST_REVISIT bytes or more that several ids hold, the largest id. Counts come
    before the shuffle, so a payload of a third of all pages is a row a task."""
    data = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    keyed = pages.select("page_id", F.sha1(data).alias("digest"), F.length(data).alias("n")).where(F.col("n") >= LEAST_REVISIT)
    return keyed.groupBy("digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("digest", "first")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """(file): archives of all pages, each file one gzip stream; a row for each file.

    A page whose payload a page with a larger id holds too is written as a revisit of that page. Pages that share the
    largest id are all responses. A null id is less than any other and has an empty target.
    """
    first = written(first_copies(pages))
    few = first.count() <= BROADCAST_ROWS
    digest = F.sha1(F.encode(F.coalesce("html", F.lit("")), "utf-8"))
    rows = pages.select("page_id", "html").join(F.broadcast(first) if few else first, digest == F.col("digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        fs.create_dir(path, recursive=True)
        out = None
        for batch in it:
            for page_id, html, to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if out is None:
                    name, size, z = f"{uuid.uuid4().hex}.warc.gz", 0, zlib.compressobj(1, zlib.DEFLATED, 31)
                    out = fs.open_output_stream(f"{path}/{name}", compression=None)
                data = record(page_id, (html or "").encode(), to)
                out.write(z.compress(data))
                size += len(data)
                if size >= FILE_BYTES:
                    out.write(z.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])
        if out is not None:
            out.write(z.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return written(rows.select("page_id", "html", refers.alias("to")).mapInArrow(write, "file string"))


def normalise_archives(files: DataFrame, source: str, folder: str, discard: bool = False) -> DataFrame:
    """(file, position, offset, length, type, target): every record of the archives ``file`` of the folder ``source``, which
    are written anew to ``folder`` with a gzip member a record and a sidecar ``<file>.idx`` of the same columns as lines.

    A file is one task's work, which streams it; ``discard`` deletes a source once its copy is whole.
    """
    parts = max(1, files.count())

    def rewrite(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (old, here), (new, there) = file_system(source), file_system(folder)
        new.create_dir(there, recursive=True)
        for batch in it:
            for name in batch.column(0).to_pylist():
                copy = f"{uuid.uuid4().hex}.warc.gz"
                with old.open_input_stream(f"{here}/{name}", compression=None) as src, new.open_output_stream(f"{there}/{copy}", compression=None) as dst, new.open_output_stream(f"{there}/{copy}.idx") as idx:
                    rows = []
                    for i, (offset, length, kind, target) in enumerate(normalise(src, dst)):
                        idx.write(f"{i} {offset} {length} {kind} {target}\n".encode())
                        rows.append((copy, i, offset, length, kind, target))
                        if len(rows) == 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], INDEX)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], INDEX)

    schema = "file string, position long, offset long, length long, type string, target string"
    index = written(files.select("file").repartition(parts).mapInArrow(rewrite, schema))
    if discard:  # the index is whole, so that no task reads the sources again
        fs, path = file_system(source)
        fs.delete_dir(path)
    return index


INDEX = ["file", "position", "offset", "length", "type", "target"]


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the records that an index points at: each is
    read from its offset alone, so any part of the index can be read anywhere: slices of SLICE bytes or less."""
    spark = index.sparkSession
    slices = max(spark.sparkContext.defaultParallelism, (index.agg(F.sum("length")).first()[0] or 0) // SLICE + 1)

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        name, src = None, None
        for batch in it:
            rows = []
            for file, offset, length in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if file != name:
                    if src is not None:
                        src.close()
                    name, src = file, fs.open_input_file(f"{path}/{file}")
                rows.append(parse(src.read_at(length, offset)))
            yield pa.RecordBatch.from_pylist(rows, READ)

    return index.select("file", "offset", "length").repartitionByRange(slices, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


READ = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def archive_pages(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from the archives.

    Pages are written as one gzip stream a file, normalised, and read back by offset. A null html is an empty payload.
    """
    spark = pages.sparkSession
    ship(spark)
    root = f"{shared_dir(spark).rstrip('/')}/evalsift-{uuid.uuid4().hex}"
    root = root if "://" in root or root.startswith("file:") else f"file://{root}"
    root = root.replace("file:/", "file:///", 1) if root.startswith("file:/") and not root.startswith("file://") else root
    files = write_archives(pages, f"{root}/streams")
    index = normalise_archives(files, f"{root}/streams", f"{root}/records", discard=True)
    return read_records(index, f"{root}/records")
