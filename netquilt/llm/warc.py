"""WARC archives: a writer that drops repeated payloads, and a sequential reader.

Each record is a gzip member of its own. Of the pages with equal payloads, the
one with the smallest page_id is stored as a response, the others as revisits
that refer to it. Tasks write archives of bounded size to the shared folder,
under a name of their own that is moved into place when the archive is whole,
so a task that runs again replaces its files. The reader inflates an archive
piece by piece, frames each record by its content length, and checks digests;
it holds one record at a time.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, materialise, shared_dir

#: Compressed size at which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/")[0] else (fs.LocalFileSystem(), uri)


def digest(data: bytes) -> str:
    """Bare SHA-1 in base32."""
    return b32encode(hashlib.sha1(data).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member; a revisit holds the HTTP head only."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block += b"" if revisit else payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _id(refers_to)}
    head |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode("utf-8", "surrogatepass")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    head: dict[str, str]
    block: bytes

    @property
    def http(self) -> dict[str, str]:
        return _fields(self.block.partition(b"\r\n\r\n")[0])

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return {k.lower(): v.strip() for k, _, v in pairs}


def _parse(data: bytes) -> Record:
    """A whole member as a record; raises if its framing or a digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    record = Record(fields, rest[:size])
    if len(record.block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is not its content length")
    if fields["warc-block-digest"] != f"sha1:{digest(record.block)}":
        raise ValueError("a block does not have its digest")
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{digest(record.payload)}":
        raise ValueError("a payload does not have its digest")
    return record


def read_records(chunks: Iterator[bytes]) -> Iterator[Record]:
    """The records of an archive, from its bytes in order; raises if the last is cut off anywhere.

    No more than ``CHUNK`` bytes are inflated at once.
    """
    inflate, held, begun = zlib.decompressobj(31), bytearray(), False
    for chunk in chunks:
        while chunk:
            begun = True
            held += inflate.decompress(chunk, CHUNK)
            if inflate.eof:
                yield _parse(bytes(held))
                chunk = inflate.unused_data
                inflate, held, begun = zlib.decompressobj(31), bytearray(), False
            else:
                chunk = inflate.unconsumed_tail
    while begun and not inflate.eof and (more := inflate.decompress(b"", CHUNK)):
        held += more
    if inflate.eof:
        yield _parse(bytes(held))
    elif begun:
        raise ValueError("the last record is cut off")


def with_responses(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to, revisit``: which pages repeat the payload of which.

    Only payloads that occur more than once are joined back. Their table is
    written first, so Spark knows its size when it plans the join: the pages
    themselves move only where it is too large to send round.
    """
    text = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", text.alias("html"), F.sha1(text.cast("binary")).alias("sum"))
    again = rows.where(F.octet_length("html") >= least_bytes).groupBy("sum").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = materialise(again.select("sum", "first"), "repeats")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(again, "sum", "left").select("page_id", "url", "html", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives under ``folder``; returns ``path, records, bytes`` of each."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = store(folder)
        where.create_dir(base, recursive=True)
        task = TaskContext.get()
        done: list[tuple[str, int, int]] = []
        out, records, size = None, 0, 0

        def close() -> None:
            nonlocal out
            out.close()
            final = f"{base}/part-{task.partitionId():06d}-{len(done):04d}.warc.gz"
            where.move(temp, final)
            done.append((final, records, size))
            out = None

        try:
            for batch in batches:
                step = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
                for at in range(0, batch.num_rows, step):
                    for page_id, url, html, refers_to, revisit in zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True):
                        if out is None:
                            temp, records, size = f"{base}/.{uuid.uuid4().hex}", 0, 0
                            out = where.open_output_stream(temp, compression=None)
                        member = encode_record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit)
                        out.write(member)
                        records, size = records + 1, size + len(member)
                        if size >= ARCHIVE_BYTES:
                            close()
            if out is not None:
                close()
        finally:
            if out is not None:  # the task failed: what it began goes
                out.close()
                where.delete_file(temp)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)

    return materialise(with_responses(pages, least_bytes).mapInArrow(run, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame, folder: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of each record of ``archives(path)``."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
    schema = pa.schema(fields)

    def rows(path: str, where: fs.FileSystem) -> Iterator[tuple]:
        with where.open_input_stream(path, compression=None) as stream:
            for r in read_records(iter(lambda: stream.read(CHUNK), b"")):
                h = r.head
                yield _page(h["warc-record-id"]), h["warc-target-uri"], int(r.http["content-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], _page(h.get("warc-refers-to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                held = []
                for row in rows(path, where):
                    held.append(row)
                    if len(held) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], schema=schema)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], schema=schema)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("path").repartition(max(1, archives.count())).mapInArrow(run, ddl)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each page, from archives written and read back.

    A null html counts as empty. Rows with the smallest page_id of their payload
    are responses, so repeats of that very row are, too; rows with a null
    page_id are revisits if their payload has a response with an id, else
    responses. Payloads of fewer than ``least_bytes`` bytes are all responses.
    Extra columns are ignored; an empty table gives an empty result.
    """
    folder = f"{shared_dir(pages.sparkSession)}/netquilt/warc-{uuid.uuid4().hex}"
    return read(write(pages, folder, least_bytes), folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: What the round trip gives, in SQL: base32 is spelt out of the hexadecimal SHA-1, four letters for five digits.
ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1) for i in range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (x)
"""
