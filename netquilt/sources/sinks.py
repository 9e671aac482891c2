"""Writers: windows, binary dumps, statistics tables, text and packet captures."""

from __future__ import annotations

import csv
import io
import struct
import tarfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquilt.functions import ip, naming
from netquilt.operators import windows

from .stored import stored


def write_windows(edges: DataFrame, path: str) -> None:
    """One folder for each window; files are ordered by source, compressed with zstd, and never overwritten."""
    edges.repartition("window_id").sortWithinPartitions("window_id", "src", "dst").write.mode("errorifexists").partitionBy("window_id").option("compression", "zstd").parquet(path)


def write_zone_pairs(labelled: DataFrame, path: str) -> None:
    """One folder for each pair of zones; a second run replaces the first."""
    labelled.write.mode("overwrite").partitionBy("zone_src", "zone_dst").option("compression", "zstd").parquet(path)


def dump_coo(edges: DataFrame) -> DataFrame:
    """``content``: blobs of the rows, the columns and then the values, one for each batch of links.

    The format has 32 bits for a value: a greater one, or one below zero, is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r, c, v = (b.column(i).to_numpy() for i in range(3))
            if len(v) and (v.max() >= 1 << 32 or v.min() < 0):
                raise ValueError("a packet count doesn't fit 32 bits")
            blob = r.astype("<u8").tobytes() + c.astype("<u8").tobytes() + v.astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=["content"])

    return edges.select("src", "dst", "packets").mapInArrow(run, "content binary")


def write_tar(members: DataFrame, folder: str) -> DataFrame:
    """Write ``members(member, content)`` as tar archives, one a partition, moved into place when whole; returns their ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(base, recursive=True)
        temp, final, some = f"{base}/.{uuid.uuid4().hex}", f"{base}/part-{TaskContext.get().partitionId():05d}.tar", False
        try:
            with where.open_output_stream(temp, compression=None) as out, tarfile.open(fileobj=out, mode="w|") as tar:
                for b in batches:
                    for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                        info, some = tarfile.TarInfo(name), True
                        info.size = len(content)
                        tar.addfile(info, io.BytesIO(content))
            if some:
                where.move(temp, final)
                yield pa.RecordBatch.from_arrays([pa.array([final])], names=["path"])
        finally:
            if where.get_file_info(temp).type != fs.FileType.NotFound:
                where.delete_file(temp)

    return stored(members.select("member", "content").mapInArrow(run, "path string"), "tars")


def write_stats(stats: DataFrame, path: str, delimiter: str = "_", order: str | None = None) -> None:
    """The wide statistics table as TSV: a row for each window; of several values of a cell the last by ``order`` counts, or else the greatest.

    It has as many rows as there are windows, so it fits one file. Lines are
    made from the cells, so the columns, nine for each pair of zones, are not
    limited; only their names pass the driver.
    """
    name = F.when(F.col("zone_src").isNull(), F.col("metric")).otherwise(naming.zone_column(F.col("metric"), F.col("zone_src"), F.col("zone_dst"), delimiter))
    one = F.max_by("value", order) if order else F.max("value")
    cells = stats.groupBy("window", name.alias("name")).agg(one.cast("string").alias("value"))
    names = [r[0] for r in cells.select("name").distinct().orderBy("name").collect()]
    place = stats.sparkSession.sparkContext.broadcast({n: i for i, n in enumerate(names)})

    def line(fields: list[str | None]) -> str:
        out = io.StringIO()
        csv.writer(out, delimiter="\t", lineterminator="").writerow(fields)
        return out.getvalue()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = place.value
        for b in batches:
            for window, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row: list[str | None] = [None] * len(at)
                for c in found:
                    row[at[c["name"]]] = c["value"]
                yield pa.RecordBatch.from_pydict({"at": [window], "value": [line([window, *row])]})

    windows_ = cells.groupBy("window").agg(F.collect_list(F.struct("name", "value")).alias("cells")).select(F.col("window").cast("string").alias("window"), "cells", F.col("window").alias("at"))
    kind = windows_.schema["at"].dataType
    made = windows_.select("window", "cells").mapInArrow(lines, "at string, value string").withColumn("at", F.col("at").cast(kind))
    head = stats.sparkSession.createDataFrame([(None, line(["window", *names]))], "at string, value string").withColumn("at", F.col("at").cast(kind))
    head.unionAll(made).repartition(1).sortWithinPartitions(F.asc_nulls_first("at")).select("value").write.mode("overwrite").text(path)


def dump_text(edges: DataFrame) -> DataFrame:
    """``value``: source, destination and packets of each link, in matrix order."""
    line = F.concat_ws(" ", ip.int_to_ip(F.col("src")), ip.int_to_ip(F.col("dst")), F.col("packets").cast("string"))
    return edges.orderBy("src", "dst").select(line.alias("value"))


def describe(edges: DataFrame) -> DataFrame:
    """Structure of a matrix in one row."""
    return edges.agg(F.count("*").alias("links"), F.count_distinct("src").alias("rows"), F.count_distinct("dst").alias("columns"), F.coalesce(F.sum("packets"), F.lit(0)).alias("packets"))


def expand_packets(edges: DataFrame, start: int, end: int) -> DataFrame:
    """``src, dst, seq, ts``: each link as that many packets, in matrix order, spread evenly over the time.

    Source and destination make one number that sorts like the pair, so the
    running total is taken in bins however many links a source has.
    """
    total = edges.agg(F.sum("packets")).first()[0] or 0
    keyed = edges.withColumn("__o", (F.col("src") - (1 << 31)) * (1 << 32) + F.col("dst"))
    placed = windows.running_total(keyed, "__o", F.col("packets"), "upto", bits=64)
    one = placed.select("src", "dst", F.explode(F.expr("sequence(upto - packets, upto - 1)")).alias("seq"))
    return one.withColumn("ts", naming.time_at(F.lit(start).cast("long"), F.lit(end).cast("long"), F.col("seq"), F.lit(total).cast("long")))


def checksum(data: bytes) -> int:
    """Ones-complement sum of 16-bit words."""
    data += b"\0" * (len(data) % 2)
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def syn_packet(src: int, dst: int, ip_id: int = 0, sport: int = 0, dport: int = 0, window: int = 0, seq: int = 0) -> bytes:
    """A TCP SYN of 40 bytes without payload."""
    head = struct.pack(">BBHHHBBHII", 0x45, 0, 40, ip_id, 0, 64, 6, 0, src, dst)
    head = head[:10] + struct.pack(">H", checksum(head)) + head[12:]
    tcp = struct.pack(">HHIIBBHHH", sport, dport, seq, 0, 5 << 4, 2, window, 0, 0)
    pseudo = struct.pack(">IIBBH", src, dst, 0, 6, len(tcp))
    return head + tcp[:16] + struct.pack(">H", checksum(pseudo + tcp)) + tcp[18:]


def pcap_records(packets: DataFrame, **fields: int) -> DataFrame:
    """``seq, content``: each packet of ``packets(src, dst, seq, ts)`` as a capture record; ``ts`` in microseconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, dst, seq, ts = (b.column(i).to_pylist() for i in range(4))
            out = []
            for s, d, t in zip(src, dst, ts, strict=True):
                body = syn_packet(s, d, **fields)
                out.append(struct.pack("<IIII", t // 1_000_000, t % 1_000_000, len(body), len(body)) + body)
            yield pa.RecordBatch.from_arrays([pa.array(seq, pa.int64()), pa.array(out, pa.binary())], names=["seq", "content"])

    return packets.select("src", "dst", "seq", "ts").mapInArrow(run, "seq long, content binary")


#: Head of a capture file of raw IP packets.
PCAP_HEAD = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 101)


def write_pcap(packets: DataFrame, folder: str, files: int = 1, prefix: str = "capture", **fields: int) -> int:
    """Write capture files of consecutive packets, each by a task of its own; returns how many.

    A file is moved into place when it is whole, so a task that runs again
    replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        where.create_dir(base, recursive=True)
        part = TaskContext.get().partitionId()
        temp, final, some = f"{base}/.{uuid.uuid4().hex}", f"{base}/{prefix}-{part:05d}.pcap", False
        with where.open_output_stream(temp) as out:
            out.write(PCAP_HEAD)
            for b in batches:
                for record in b.column(1).to_pylist():
                    out.write(record)
                    some = True
        if some:
            where.move(temp, final)
            yield pa.RecordBatch.from_arrays([pa.array([final])], names=["path"])
        else:
            where.delete_file(temp)

    records = pcap_records(packets, **fields)
    return records.repartitionByRange(files, "seq").sortWithinPartitions("seq").mapInArrow(run, "path string").count()
