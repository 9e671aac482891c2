"""Anonymization tables as binary files: four bytes an address, at four times its distance from the first."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netquilt.operators import anonymize

from .captures import opened

#: Addresses in a block, which is what a task writes or reads at once.
BLOCK = 1 << 20
_ENTRY = np.dtype("<u4")


def _name(folder: str, first: int) -> str:
    return f"{folder.rstrip('/')}/{first:010d}.bin"


def write_table(spark: SparkSession, folder: str, key: str, first: int = 0, last: int = 2**32 - 3, keep: int = anonymize.KEEP, block: int = BLOCK) -> int:
    """Write the mapping of a range of addresses as files of ``block`` entries, named after their first address; returns how many.

    A task maps and writes a block; a file is moved into place when it is
    whole, so a task that runs again replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, have = None, [], 0

        def written() -> pa.RecordBatch:
            where, base = opened(folder)
            where.create_dir(base, recursive=True)
            temp = f"{base}/.{uuid.uuid4().hex}"
            with where.open_output_stream(temp, compression=None) as out:
                out.write(np.concatenate(held).astype(_ENTRY).tobytes())
            where.move(temp, _name(base, at))
            return pa.RecordBatch.from_pydict({"first": [at], "n": [have]})

        for b in batches:
            ip, anon = (c.to_numpy() for c in b.columns)
            for lo in range(0, len(ip), block):
                part, begin = anon[lo : lo + block], int(ip[lo])
                cut = (-(begin - first)) % block or block  # up to the next block
                for piece, start in ((part[:cut], begin), (part[cut:], begin + cut)):
                    if not len(piece):
                        continue
                    if (start - first) % block == 0:
                        if held:
                            yield written()
                        at, held, have = start, [], 0
                    held.append(piece)
                    have += len(piece)
        if held:
            yield written()

    blocks = (last - first) // block + 1
    starts = spark.range(0, blocks, 1, min(blocks, 4096)).select(F.explode(F.sequence(F.col("id") * block + first, F.least(F.col("id") * block + (first + block - 1), F.lit(last)))).alias("ip"))
    mapped = starts.withColumn("anon_ip", anonymize.scramble(F.col("ip"), key, keep))
    return mapped.mapInArrow(run, "first long, n long").count()


def look_up(ids: DataFrame, path: str, first: int = 0, block: int = BLOCK) -> DataFrame:
    """``ip, anon_ip`` of the addresses ``ids(ip)``, each once; those that the table lacks are left out.

    ``path`` is a folder of ``write_table`` with the same ``first`` and
    ``block``, or one file of the same layout. Addresses are sorted by block, so
    each block that is asked for is read once, and only from the first to the
    last address asked for in a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(path)
        single = store.get_file_info(base).type == fs.FileType.File
        for b in batches:
            ip, at = b.column(0).to_numpy(), b.column(1).to_numpy()
            for mine in np.split(np.arange(len(ip)), np.flatnonzero(np.diff(at)) + 1):
                if not len(mine):
                    continue
                begin = first if single else first + int(at[mine[0]]) * block
                name = base if single else _name(base, begin)
                if store.get_file_info(name).type != fs.FileType.File:
                    continue
                lo, hi = int(ip[mine].min()) - begin, int(ip[mine].max()) - begin + 1
                with store.open_input_file(name) as f:
                    f.seek(min(4 * lo, f.size()))
                    found = np.frombuffer(f.read(4 * (hi - lo)), _ENTRY)
                there = mine[ip[mine] - begin - lo < len(found)]
                yield pa.RecordBatch.from_pydict({"ip": pa.array(ip[there], pa.int64()), "anon_ip": pa.array(found[ip[there] - begin - lo].astype(np.int64))})

    asked = ids.select("ip").where(F.col("ip") >= first).distinct().withColumn("at", F.expr(f"(ip - {first}) div {block}"))
    return asked.repartition("at").sortWithinPartitions("at", "ip").mapInArrow(run, "ip long, anon_ip long")
