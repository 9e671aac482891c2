"""Predicates that a capture passes before it becomes a matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquilt.functions.capture_filter import capture_filter
from netquilt.functions.naming import micros

from . import scans

BROADCAST = 0xFFFFFFFF


def ipv4_only(packets: DataFrame) -> DataFrame:
    return packets.where("ethertype = 2048 AND ip_version = 4")


def no_broadcast(links: DataFrame) -> DataFrame:
    return links.where((F.col("src") < BROADCAST) & (F.col("dst") < BROADCAST))


def matching(packets: DataFrame, predicate: str) -> DataFrame:
    """Rows that pass a SQL predicate of the user."""
    return packets.where(predicate)


def captured(packets: DataFrame, text: str) -> DataFrame:
    """Packets that pass a capture filter, such as ``tcp and dst port 80 and not net 10.0.0.0/8``."""
    return packets.where(capture_filter(text)) if text.strip() else packets


def counters(packets: DataFrame) -> DataFrame:
    """Packets in all, and those that are no IPv4."""
    valid = (F.col("ethertype") == 2048) & (F.col("ip_version") == 4)
    return packets.agg(F.count("*").alias("total"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))


def rates(packets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``second, total, invalid``: packets in each second of ``ts``, for each group of ``by``, and those that are no IPv4."""
    valid = (F.col("ethertype") == 2048) & (F.col("ip_version") == 4)
    return packets.groupBy(*by, F.date_trunc("second", "ts").alias("second")).agg(F.count("*").alias("total"), F.count_if(~F.coalesce(valid, F.lit(False))).alias("invalid"))


def drops(counters: DataFrame) -> DataFrame:
    """``ring, second, dropped``: how far each ring's counter of lost packets rose in a second.

    ``counters(ring, ts, dropped)`` are running counts; one that falls began anew
    and counts from 0. The count before each is carried along the ring in bins
    of time, so a ring of any length is spread over many tasks; readings of a
    ring have different times.
    """
    timed = counters.withColumn("__at", micros("ts"))
    with_last = scans.running(timed, "__at", {"__b": scans.Run("last", F.col("dropped"))}, ("ring",), before=True)
    before = F.col("__b")
    rise = F.when(before.isNull(), F.lit(0).cast("long")).when(F.col("dropped") < before, F.col("dropped")).otherwise(F.col("dropped") - before)
    return with_last.withColumn("rise", rise).groupBy("ring", F.date_trunc("second", "ts").alias("second")).agg(F.sum("rise").alias("dropped"))


def not_processed(files: DataFrame, manifest: DataFrame, suffix: str = ".grb") -> DataFrame:
    """File names with the suffix that the manifest lacks, each once."""
    return files.where(F.col("path").endswith(suffix)).distinct().join(manifest, "path", "left_anti")


def task_slice(rows: DataFrame, position: str, task: int, tasks: int) -> DataFrame:
    """The rows that a round-robin scheduler gives to one task."""
    return rows.where(F.pmod(F.col(position), F.lit(tasks)) == task)


def flows_to_links(flows: DataFrame) -> DataFrame:
    """Both directions of each flow as links; counts that are missing are 0, and links without packets go."""
    both = F.array(
        F.struct(F.col("src"), F.col("dst"), F.coalesce("to_server", F.lit(0)).cast("long").alias("packets")),
        F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), F.coalesce("to_client", F.lit(0)).cast("long").alias("packets")),
    )
    return flows.select(F.explode(both).alias("l")).select("l.src", "l.dst", "l.packets").where("packets > 0 and src is not null and dst is not null")
