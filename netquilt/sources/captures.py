"""Packet captures: records, an index of where they begin, and reading from there by many tasks."""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from .stored import stored

COLUMNS = {
    "path": "string", "seq": "long", "ts": "timestamp", "link_type": "string", "ethertype": "int", "vlan": "boolean", "ip_version": "int",
    "src": "long", "dst": "long", "protocol": "int", "src_port": "int", "dst_port": "int", "length": "long",
}
PACKETS = ", ".join(f"{name} {kind}" for name, kind in COLUMNS.items())
_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "timestamp": pa.timestamp("us", "UTC")}
#: Rows that a reader hands on at once, and bytes read at once.
ROWS, BUFFER = 20_000, 1 << 20
#: Bytes of a capture that one task reads, about.
PART = 64 << 20

# Fixed values of the capture format and of the protocols in it.
_MAGIC = {0xA1B2C3D4: 1_000_000, 0xA1B23C4D: 1_000_000_000}
HEAD, RECORD = 24, 16
_ETHERNET, _RAW = 1, (12, 14, 101)
_IPV4, _IPV6, _TAGGED = 0x0800, 0x86DD, 0x8100
_WITH_PORTS = (6, 17, 132)


@dataclass(frozen=True)
class Head:
    """What the head of a capture says of its records."""

    order: str
    unit: int
    link: int


def head_of(data: bytes) -> Head | None:
    """The head of a capture; None if it is cut off, an error if this is no capture."""
    if len(data) < HEAD:
        return None
    order = "<" if struct.unpack("<I", data[:4])[0] in _MAGIC else ">"
    magic = struct.unpack(order + "I", data[:4])[0]
    if magic not in _MAGIC:
        raise ValueError("not a packet capture")
    return Head(order, _MAGIC[magic], struct.unpack(order + "I", data[20:24])[0] & 0x0FFFFFFF)


def fields(data: bytes, link: int) -> tuple:
    """Link type, ethertype, vlan, ip version, source, destination, protocol and ports of a frame.

    A frame that is no Ethernet or raw IP has no ethertype; one that is no IPv4
    has no addresses and no protocol; a later fragment has no ports.
    """
    size, kind, at, vlan, name = len(data), None, None, False, "other"
    if link == _ETHERNET and size >= 14:
        name, at = "ethernet", 14
        kind = int.from_bytes(data[12:14], "big")
        if kind == _TAGGED and size >= 18:
            kind, at, vlan = int.from_bytes(data[16:18], "big"), 18, True
    elif link in _RAW and size:
        name, at = "raw", 0
        kind = _IPV4 if data[0] >> 4 == 4 else _IPV6
    version = data[at] >> 4 if at is not None and size > at else None
    if not (kind == _IPV4 and version == 4 and size >= at + 20):
        return name, kind, vlan, version, None, None, None, None, None
    src, dst = struct.unpack_from(">II", data, at + 12)
    protocol, body = data[at + 9], at + 4 * (data[at] & 15)
    first = not int.from_bytes(data[at + 6 : at + 8], "big") & 0x1FFF
    ports = struct.unpack_from(">HH", data, body) if protocol in _WITH_PORTS and first and size >= body + 4 else (None, None)
    return name, kind, vlan, version, src, dst, protocol, *ports


def read_packets(stream: io.RawIOBase, head: Head | None = None, seq: int = 0, end: int | None = None) -> Iterator[tuple]:
    """``PACKETS`` without the path, the time in microseconds, of each record of a capture in order.

    Without ``head`` the stream stands at the beginning of the capture; with it,
    at the record of number ``seq``, and reading stops after ``end`` bytes. A
    record cut off at the end of the capture is left out.
    """
    head = head or head_of(stream.read(HEAD))
    if head is None:
        return
    record, done = struct.Struct(head.order + "IIII"), 0
    while (end is None or done < end) and len(h := stream.read(RECORD)) == RECORD:
        sec, part, size, whole = record.unpack(h)
        data = stream.read(size)
        if len(data) < size:
            return
        yield seq, sec * 1_000_000 + part * 1_000_000 // head.unit, *fields(data, head.link), whole
        seq += 1
        done += RECORD + size


def parts(stream: io.RawIOBase, size: int) -> Iterator[tuple[int, int, int]]:
    """``offset, bytes, seq``: a capture cut at records into parts of ``size`` bytes or a little more.

    Only the heads of records are looked at; what is held is one buffer, or one
    record that is longer.
    """
    head = head_of(stream.read(HEAD))
    if head is None:
        return
    length = struct.Struct(head.order + "8xI4x")
    held, begun, at, seq, first = b"", HEAD, HEAD, 0, 0
    base = HEAD  # where held begins
    while data := stream.read(BUFFER):
        held += data
        while at + RECORD - base <= len(held):
            upto = at + RECORD + length.unpack_from(held, at - base)[0]
            if upto - base > len(held):
                break
            at, seq = upto, seq + 1
            if at - begun >= size:
                yield begun, at - begun, first
                begun, first = at, seq
        held, base = held[at - base :], at
    if at > begun:
        yield begun, at - begun, first


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the name in it of a path as Spark gives it."""
    path = re.sub(r"^file:/(?!/)", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def index(files: DataFrame, size: int = PART) -> DataFrame:
    """``path, offset, bytes, seq`` of the parts of the captures of ``files(path)``; one light pass, a task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = opened(path)
                with where.open_input_stream(name, buffer_size=BUFFER) as stream:
                    for offset, n, seq in parts(stream, size):
                        yield pa.RecordBatch.from_pydict({"path": [path], "offset": [offset], "bytes": [n], "seq": [seq]})

    return files.select("path").mapInArrow(run, "path string, offset long, bytes long, seq long")


def in_batches(path: str, rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``read_packets`` as record batches of ``PACKETS``."""
    schema = pa.schema([(name, _ARROW[kind]) for name, kind in COLUMNS.items()])

    def batch(held: list[tuple]) -> pa.RecordBatch:
        cols = [[path] * len(held), *zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == ROWS:
            yield batch(held)
            held = []
    if held:
        yield batch(held)


def packets_of_files(files: DataFrame) -> DataFrame:
    """Packets of the capture files of a column ``path``, batch or stream, each file read by one task in flat memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = opened(path)
                with where.open_input_stream(name, buffer_size=BUFFER) as stream:
                    yield from in_batches(path, read_packets(stream))

    return files.select("path").mapInArrow(run, PACKETS)


def packets_of_parts(found: DataFrame) -> DataFrame:
    """Packets of the parts of an ``index``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offset, n, seq in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield from in_batches(path, part_of(path, offset, n, seq))

    return found.select("path", "offset", "bytes", "seq").mapInArrow(run, PACKETS)


def part_of(path: str, offset: int, n: int, seq: int) -> Iterator[tuple]:
    """The rows of one part."""
    where, name = opened(path)
    with where.open_input_file(name) as whole:
        head = head_of(whole.read(HEAD))
        whole.seek(offset)
        yield from read_packets(io.BufferedReader(whole, BUFFER), head, seq, n)


def read_pcap(files: DataFrame, size: int = PART) -> DataFrame:
    """Packets of ``files(path)``, about ``size`` bytes a task: a long capture is indexed first and then read by many."""
    found = stored(index(files.repartition(max(1, files.count())), size), "capture-index")
    return packets_of_parts(found.repartition(max(1, found.count())))
