"""The nine network quantities, and how many entities attain each maximum."""

from __future__ import annotations

from functools import reduce as fold

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTITIES = ("n_packets", "n_links", "n_sources", "n_destinations", "max_packets", "max_source_packets", "max_destination_packets", "max_fan_out", "max_fan_in")
MULTIPLICITIES = ("max_packets_links", "max_source_packets_sources", "max_destination_packets_destinations", "max_fan_out_sources", "max_fan_in_destinations")


def _side(edges: DataFrame, axis: str, by: tuple[str, ...], names: tuple[str, str, str]) -> DataFrame:
    """Entities of one axis, the greatest sum and the greatest number of links."""
    each = edges.groupBy(*by, axis).agg(F.sum("packets").alias("v"), F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.count("*").alias(names[0]), F.max("v").alias(names[1]), F.max("n").alias(names[2]))


def quantities(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """All nine for the whole matrix (one row, zeros if it is empty) or for each group of ``by``.

    ``edges`` has unique pairs within a group. The three aggregates meet as a
    union of one-row groups, so nothing is joined, and identical exchanges are
    planned once.
    """
    parts = [
        edges.groupBy(*by).agg(F.sum("packets").alias("n_packets"), F.count("*").alias("n_links"), F.max("packets").alias("max_packets")),
        _side(edges, "src", by, ("n_sources", "max_source_packets", "max_fan_out")),
        _side(edges, "dst", by, ("n_destinations", "max_destination_packets", "max_fan_in")),
    ]
    wide = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return wide.groupBy(*by).agg(*(F.coalesce(F.max(q), F.lit(0)).cast("long").alias(q) for q in QUANTITIES))


def multiplicities(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """How many links, sources or destinations attain each of the five maxima; 0 if there is none.

    Each maximum is taken over a histogram of values, which is far smaller than
    the entities themselves.
    """

    def attained(values: DataFrame, name: str) -> DataFrame:
        counts = values.groupBy(*by, "v").agg(F.count("*").alias("c"))
        return counts.groupBy(*by).agg(F.max_by("c", "v").alias(name))

    per = lambda axis, agg: edges.groupBy(*by, axis).agg(agg.alias("v"))
    values = [edges.select(*by, F.col("packets").alias("v")), per("src", F.sum("packets")), per("dst", F.sum("packets")), per("src", F.count("*")), per("dst", F.count("*"))]
    wide = fold(lambda a, b: a.unionByName(b, allowMissingColumns=True), (attained(v, n) for v, n in zip(values, MULTIPLICITIES, strict=True)))
    return wide.groupBy(*by).agg(*(F.coalesce(F.max(m), F.lit(0)).cast("long").alias(m) for m in MULTIPLICITIES))


def unpivot(wide: DataFrame, ids: tuple[str, ...], metrics: tuple[str, ...] = QUANTITIES) -> DataFrame:
    """Long form ``(ids..., metric, value)``."""
    return wide.unpivot(list(ids), list(metrics), "metric", "value")
