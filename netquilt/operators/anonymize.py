"""Keyed, prefix-preserving anonymization of addresses.

Each bit below the kept ones is flipped or not by a keyed hash of the bits
above it, so two addresses share as long a prefix afterwards as before, and
no two become one. The upper ``keep`` bits pass through.
"""

from __future__ import annotations

import secrets

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .zones import merge

KEEP = 16


def scramble(ip: Column, key: str, keep: int = KEEP) -> Column:
    """The anonymized id, in built-in functions only."""
    out = ip
    for bit in range(keep, 32):
        prefix = F.shiftright(ip, 32 - bit)  # the bits above this one
        digest = F.sha2(F.concat(F.lit(f"{key}:{bit}:"), prefix.cast("string")), 256)
        flip = F.conv(F.substring(digest, 1, 1), 16, 10).cast("long").bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseXOR(F.shiftleft(flip, 31 - bit))
    return out


def table_for(edges: DataFrame, key: str, keep: int = KEEP) -> DataFrame:
    """``(ip, anon_ip)`` for the addresses that occur; each is hashed once."""
    ids = edges.select(F.explode(F.array("src", "dst")).alias("ip")).distinct()
    return ids.withColumn("anon_ip", scramble(F.col("ip"), key, keep))


def apply_table(edges: DataFrame, table: DataFrame) -> DataFrame:
    """``edges`` with both ends mapped; ends that the table lacks drop their link."""
    side = lambda end: table.select(F.col("ip").alias(end), F.col("anon_ip").alias(f"anon_{end}"))
    out = edges.join(side("src"), "src").join(side("dst"), "dst")
    return out.select(F.col("anon_src").alias("src"), F.col("anon_dst").alias("dst"), *(c for c in edges.columns if c not in ("src", "dst")))


def full_table(spark, key: str, first: int = 0, last: int = 2**32 - 3, keep: int = KEEP) -> DataFrame:
    """The mapping of a whole range of addresses."""
    ids = spark.range(first, last + 1).withColumnRenamed("id", "ip")
    return ids.withColumn("anon_ip", scramble(F.col("ip"), key, keep))


def prefixes(zones: DataFrame) -> DataFrame:
    """``zone, base, bits``: the intervals of ``zones(zone, lo, hi)`` as aligned blocks of ``2**bits`` addresses, at most 62 an interval.

    Where the two ends of an interval part, a multiple of a power of two lies
    between them; the set bits of what is missing below it are the blocks on its
    left, those of what goes beyond it the blocks on its right.
    """
    lo, end = F.col("lo"), F.col("hi") + 1
    split = F.length(F.bin(lo.bitwiseXOR(end))) - 1  # the highest bit in which the ends differ
    pivot = F.call_function("shiftleft", F.call_function("shiftright", end, split), split)
    left, right = F.col("mid") - lo, end - F.col("mid")
    up = lambda v, k: F.call_function("shiftleft", v, k)
    down = lambda v, k: F.call_function("shiftright", v, k)
    bits = F.sequence(F.lit(0), F.lit(32))
    on = lambda v, k: down(v, k).bitwiseAND(F.lit(1).cast("long")) == 1
    block = lambda base, k: F.struct(base.alias("base"), k.alias("bits"))
    below = F.transform(F.filter(bits, lambda k: on(left, k)), lambda k: block(F.col("mid") - up(down(left, k), k), k))
    above = F.transform(F.filter(bits, lambda k: on(right, k)), lambda k: block(F.col("mid") + up(down(right, k + 1), k + 1), k))
    parted = zones.select("zone", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).where("lo <= hi").withColumn("mid", pivot)
    return parted.select("zone", F.explode(F.concat(below, above)).alias("p")).select("zone", "p.base", "p.bits").distinct()


def zone_table(zones: DataFrame, key: str, keep: int = KEEP) -> DataFrame:
    """``zones`` as they lie after mapping, so that they fit an anonymized matrix.

    Addresses that share a prefix share one afterwards, so a block of addresses
    becomes a block of the same size: one hash chain maps all of it, and no
    address is ever spelt out.
    """
    size = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits"))
    mapped = scramble(F.col("base"), key, keep)
    lo = mapped - F.pmod(mapped, size)
    return merge(prefixes(zones).select("zone", lo.alias("lo"), (lo + size - 1).alias("hi")))


def stored_key(spark: SparkSession, path: str) -> str:
    """The key in the first line of a file; if there is no file, a new key is drawn and written there."""
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if where.get_file_info(name).type == fs.FileType.NotFound:
        with where.open_output_stream(name) as out:
            out.write(secrets.token_hex(32).encode() + b"\n")
    with where.open_input_stream(name) as found:
        return found.read().split(b"\n")[0].decode().strip()
