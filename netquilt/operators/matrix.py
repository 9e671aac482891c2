"""Sparse traffic matrices as tables ``(src, dst, packets)`` with unique pairs and no zero."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDGES = ("src", "dst", "packets")


def build(links: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Combine repeated pairs by adding; sums of zero vanish. ``by`` keeps windows apart."""
    return links.groupBy(*by, "src", "dst").agg(F.sum("packets").cast("long").alias("packets")).where("packets <> 0")


def from_packets(packets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Each packet weighs 1; partial counts are combined before the shuffle."""
    return packets.groupBy(*by, "src", "dst").agg(F.count("*").alias("packets"))


def add(*matrices: DataFrame) -> DataFrame:
    """Sum of matrices, over the union of their links."""
    return build(fold(DataFrame.unionByName, (m.select(*EDGES) for m in matrices)))


def subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a - b``; links that cancel out are pruned."""
    return build(a.select(*EDGES).unionByName(b.select("src", "dst", (-F.col("packets")).alias("packets"))))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Links of ``a`` that ``b`` lacks, whatever their weight."""
    return a.join(b, ["src", "dst"], "left_anti")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Links of both, with both weights."""
    return a.join(b.withColumnRenamed("packets", "other_packets"), ["src", "dst"])


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``equal``: whether the two hold the same links and weights."""
    signed = a.select(*EDGES, F.lit(1).alias("side")).unionByName(b.select(*EDGES, F.lit(-1).alias("side")))
    apart = signed.groupBy(*EDGES).agg(F.sum("side").alias("n")).where("n <> 0")
    return apart.agg((F.count("*") == 0).alias("equal"))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "packets")


def pattern(a: DataFrame) -> DataFrame:
    """1 for each link."""
    return a.select("src", "dst", F.signum("packets").cast("long").alias("packets"))


_OPS = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def reduce(a: DataFrame, axis: str, op: str) -> DataFrame:
    """Reduce rows (``axis`` src) or columns (dst) to ``(axis, v)``."""
    return a.groupBy(axis).agg(_OPS[op]("packets").cast("long").alias("v"))


def select_value(a: DataFrame, value: Column | int, op: str = "=") -> DataFrame:
    """Entries equal to (or, with ``<>``, other than) a value."""
    hit = F.col("packets") == value
    return a.where(hit if op == "=" else ~hit)


def labels(a: DataFrame, axis: str) -> DataFrame:
    """The distinct ids of an axis, in order."""
    return a.select(axis).distinct().orderBy(axis)
