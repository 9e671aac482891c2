"""Readers: captures, flow records, binary and text dumps, address lists, archives, statistics."""

from __future__ import annotations

import csv
import io
import json
import re
import tarfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netquilt.functions import ip, naming

from . import captures

FLOW = "src_ip string, dest_ip string, flow struct<pkts_toserver: bigint, pkts_toclient: bigint>"


def paths(spark: SparkSession, where: str | list[str], glob: str | None = None, recursive: bool = False) -> DataFrame:
    """``path`` of each file; contents aren't read. A list may come from a file-list file (``file_list``)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(where).select("path")


def file_list(spark: SparkSession, path: str) -> list[str]:
    """The paths in a text file, one a line, sorted, each once."""
    return sorted({r[0].strip() for r in spark.read.text(path).toLocalIterator() if r[0].strip()})


def read_pcap(spark: SparkSession, where: str | list[str], glob: str | None = None, part: int = captures.PART) -> DataFrame:
    """Packets of capture files; a long one is cut at records and read by many tasks."""
    return captures.read_pcap(paths(spark, where, glob), part)


def read_flows(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """``src, dst, to_server, to_client`` of flow records, one JSON object a line.

    Lines that are no JSON, have no ``flow`` or a bad address are dropped;
    counts that are missing or no whole number are null.
    """
    return flow_columns(spark.read.text(where))


def flow_columns(lines: DataFrame) -> DataFrame:
    """The same from any DataFrame or stream with a ``value`` column."""
    rows = lines.select(F.from_json("value", FLOW).alias("r")).where("r.flow is not null")
    flows = rows.select(ip.ip_to_int(F.col("r.src_ip")).alias("src"), ip.ip_to_int(F.col("r.dest_ip")).alias("dst"), F.col("r.flow.pkts_toserver").alias("to_server"), F.col("r.flow.pkts_toclient").alias("to_client"))
    return flows.where("src is not null and dst is not null")


def read_tsv_links(spark: SparkSession, where: str | list[str], with_value: bool = False) -> DataFrame:
    """Links of tab-separated flows: a header, then columns 2 and 3 as addresses.

    Each row weighs 1, or the value of column 4. A bad address is an error.
    """
    rows = spark.read.schema("a string, b string, src string, dst string, value string").option("sep", "\t").option("header", True).option("enforceSchema", True).csv(where)
    weight = F.coalesce(F.col("value").try_cast("long"), F.lit(0)) if with_value else F.lit(1).cast("long")
    return rows.select(ip.ip_to_int(F.col("src"), strict=True).alias("src"), ip.ip_to_int(F.col("dst"), strict=True).alias("dst"), weight.alias("packets"))


def coo_arrays(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and values of one binary dump: two blocks of 64-bit and one of 32-bit numbers."""
    n = len(blob) // 20
    if n * 20 != len(blob):
        raise ValueError("not a whole number of entries")
    return np.frombuffer(blob, "<u8", n), np.frombuffer(blob, "<u8", n, 8 * n), np.frombuffer(blob, "<u4", n, 16 * n)


def links_of_coo(blobs: DataFrame) -> DataFrame:
    """Links of a column ``content`` of binary dumps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blob in b.column(0).to_pylist():
                cols = [pa.array(c.astype(np.int64)) for c in coo_arrays(blob)]
                yield pa.RecordBatch.from_arrays(cols, names=["src", "dst", "packets"])

    return blobs.select("content").mapInArrow(run, "src long, dst long, packets long")


def read_coo(spark: SparkSession, where: str | list[str]) -> DataFrame:
    return links_of_coo(spark.read.format("binaryFile").load(where))


def read_tar(spark: SparkSession, where: str | list[str], suffix: str = ".coo", ignored: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """``archive, member, src, dst, packets`` of the members of tar archives that hold binary dumps.

    Members with another suffix, or named in ``ignored``, are skipped. Reading
    of an archive ends at the first bad member, and what came before it stays;
    if ``strict``, a bad member is an error.
    """
    schema = "archive string, member string, src long, dst long, packets long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                where, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
                with where.open_input_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
                    try:
                        for m in tar:
                            if m.isfile() and m.name.endswith(suffix) and m.name not in ignored:
                                cols = coo_arrays(tar.extractfile(m).read())
                                n = len(cols[0])
                                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array([m.name] * n, pa.string()), *(pa.array(c.astype(np.int64)) for c in cols)], names=["archive", "member", "src", "dst", "packets"])
                    except (ValueError, tarfile.TarError, EOFError) as bad:
                        if strict:
                            raise ValueError(f"{path}: a member can't be read: {bad}") from bad

    files = paths(spark, where)
    return files.repartition(max(1, files.count())).mapInArrow(run, schema)


def read_address_lists(spark: SparkSession, where: list[str], strict: bool = True) -> DataFrame:
    """``zone, lo, hi`` of address lists, a zone a file in the order given.

    Lines are ``a.b.c.d/n`` or ``first:last``; a malformed or reversed one is an
    error, or is dropped unless ``strict``.
    """
    out = None
    for i, path in enumerate(where, 1):
        line = F.trim("value")
        lines = spark.read.text(path).where(line != "").select(line.alias("line"))
        lo, hi = ip.bounds(F.col("line"))
        bad = F.raise_error(F.concat(F.lit("bad address range: "), F.col("line"))).cast("long")
        rows = lines.select(F.lit(i).alias("zone"), F.coalesce(lo, bad if strict else F.lit(None).cast("long")).alias("lo"), hi.alias("hi")).where("lo is not null").distinct()
        out = rows if out is None else out.unionAll(rows)
    return out


def read_zone_archive(spark: SparkSession, where: str, with_sum: bool = False) -> DataFrame:
    """``zone, lo, hi`` of a tar archive of address lists: its members in the order of their names are zones 1, 2 and so on.

    Lines are those of ``read_address_lists``; ``with_sum`` adds all ranges once
    more as the zone after the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))
                with store.open_input_stream(name, compression=None) as raw, tarfile.open(fileobj=raw, mode="r|") as tar:
                    for m in tar:
                        if m.isfile():
                            lines = [x.strip() for x in tar.extractfile(m).read().decode().splitlines() if x.strip()]
                            yield pa.RecordBatch.from_arrays([pa.array([m.name] * len(lines), pa.string()), pa.array(lines, pa.string())], names=["member", "line"])

    lines = paths(spark, where).mapInArrow(run, "member string, line string")
    names = [r[0] for r in lines.select("member").distinct().orderBy("member").collect()]  # one a zone
    lo, hi = ip.bounds(F.col("line"))
    bad = F.raise_error(F.concat(F.lit("bad address range: "), F.col("line"))).cast("long")
    zone = F.array_position(F.array(*map(F.lit, names)) if names else F.array().cast("array<string>"), F.col("member")).cast("int")
    zones = lines.select(zone.alias("zone"), F.coalesce(lo, bad).alias("lo"), hi.alias("hi")).distinct()
    return zones.unionAll(zones.select(F.lit(len(names) + 1).alias("zone"), "lo", "hi").distinct()) if with_sum else zones


def read_stats(spark: SparkSession, where: str, suffix: str = "") -> DataFrame:
    """The long statistics table of wide TSV files: a row for each window, a column for each metric and pair of zones.

    Files are read as they are wide, cell by cell, so columns are not limited.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                store, name = captures.opened(path)
                with store.open_input_stream(name) as raw:
                    rows = csv.reader(io.TextIOWrapper(raw, "utf-8", newline=""), delimiter="\t")
                    _, *names = next(rows, [""])
                    for window, *values in rows:
                        cells = [(n, v) for n, v in zip(names, values, strict=False) if v not in ("", '""')]
                        if cells:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([window] * len(cells), *zip(*cells, strict=True))], names=["key", "name", "value"])

    long = paths(spark, where).mapInArrow(run, "key string, name string, value string")
    metric, i, j = naming.parse_zone_column(F.col("name"))
    window = naming.clean_window_name(F.col("key"), suffix) if suffix else F.col("key")
    return long.select(window.alias("window"), i.alias("zone_src"), j.alias("zone_dst"), metric.alias("metric"), F.col("value").cast("double").alias("value"))


def read_export_config(spark: SparkSession, where: str) -> DataFrame:
    """Export settings: eight tab-separated fields; lines that begin with ``#`` or a space are skipped."""
    lines = spark.read.text(where).where(~F.col("value").rlike(r"^(#| |$)"))
    f = F.split("value", "\t")
    names = ["path", "start", "end", "ip_id", "tcp_sport", "tcp_dport", "tcp_window", "tcp_seq"]
    return lines.where(F.size(f) >= len(names)).select(*((f[i] if i == 0 else f[i].cast("long")).alias(n) for i, n in enumerate(names)))


#: A string, which stays, or a comma before a closing bracket.
_LOOSE_COMMA = r'("(?:[^"\\]|\\.)*")|,(?=\s*[\]}])'


def loads_lenient(text: str) -> dict:
    """JSON that may have commas before a closing bracket, outside strings."""
    return json.loads(re.sub(_LOOSE_COMMA, lambda m: m.group(1) or "", text))


def read_modules(spark: SparkSession, where: str | list[str]) -> DataFrame:
    """``path, name, src, dst, packets, color`` of teaching matrices: dense JSON matrices with an axis label each."""
    strict = F.regexp_replace("value", _LOOSE_COMMA, "$1")
    schema = "name string, axis_labels array<string>, traffic_matrix array<array<int>>, traffic_matrix_colors array<array<int>>"
    rows = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(where).select(F.input_file_name().alias("path"), F.from_json(strict, schema).alias("m"))
    cells = rows.select("path", "m", F.posexplode("m.traffic_matrix").alias("i", "row")).select("path", "m", "i", F.posexplode("row").alias("j", "packets"))
    return cells.where("packets <> 0").select(
        "path", F.col("m.name").alias("name"), F.col("m.axis_labels")[F.col("i")].alias("src"), F.col("m.axis_labels")[F.col("j")].alias("dst"), F.col("packets").cast("long").alias("packets"), F.get(F.get("m.traffic_matrix_colors", F.col("i")), F.col("j")).alias("color"),
        F.col("i").cast("long").alias("src_id"), F.col("j").cast("long").alias("dst_id"),
    )
