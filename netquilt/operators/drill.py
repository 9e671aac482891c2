"""From an extreme value back to the links behind it, weights unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: metric -> (entity, aggregate)
SOURCES = {
    "max_source_packets": ("src", "sum"),
    "max_fan_out": ("src", "count"),
    "max_destination_packets": ("dst", "sum"),
    "max_fan_in": ("dst", "count"),
}
#: More links than this are not drawn.
SHOWN = 1_000_000


def behind(edges: DataFrame, metric: str, value: int | None = None) -> DataFrame:
    """Links of the entities whose ``metric`` is ``value`` (default: its maximum).

    The few entities that attain it are found first; the links then meet only
    those.
    """
    if metric == "max_packets":
        top = edges.agg(F.max("packets").alias("v"))
        wanted = top.withColumn("v", F.lit(value).cast("long")) if value is not None else top
        return edges.join(wanted, edges["packets"] == wanted["v"], "left_semi")
    axis, op = SOURCES[metric]
    each = edges.groupBy(axis).agg((F.sum("packets") if op == "sum" else F.count("*")).alias("v"))
    wanted = each.agg(F.max("v").alias("v")) if value is None else each.agg(F.lit(value).cast("long").alias("v"))
    hit = each.join(wanted, "v", "left_semi").select(axis)
    return edges.join(hit, axis, "left_semi")


def shown(edges: DataFrame, most: int = SHOWN) -> DataFrame:
    """``edges``, or an error if there are too many to draw."""
    if edges.limit(most + 1).count() > most:
        raise ValueError(f"over {most} links")
    return edges


def hover(edges: DataFrame) -> DataFrame:
    """The text shown for each link."""
    return edges.withColumn("label", F.format_string("Source: %s Dest.: %s Val: %d", F.col("src").cast("string"), F.col("dst").cast("string"), F.col("packets")))
