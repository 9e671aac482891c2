"""Address zones: interval tables ``(zone, lo, hi)`` and matrices cut by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans, stats

#: Up to so many intervals the label is a plain expression; beyond, addresses and intervals are scanned together.
INLINE = 64
#: Bits of twice an address.
TWICE = 34


def merge(zones: DataFrame) -> DataFrame:
    """Intervals of each zone with overlapping and touching ones joined; a zone of any size is scanned in bins."""
    each = zones.groupBy("zone", "lo").agg(F.max("hi").alias("hi"))
    reached = scans.running(each, "lo", {"reach": scans.Run("max", F.col("hi"))}, ("zone",), before=True, bits=TWICE)
    fresh = F.when(F.col("lo") <= F.col("reach") + 1, 0).otherwise(1).cast("long")
    runs = scans.running(reached.withColumn("fresh", fresh), "lo", {"run": scans.Run("sum", F.col("fresh"))}, ("zone",), bits=TWICE)
    return runs.groupBy("zone", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("run")


def overlaps(zones: DataFrame) -> DataFrame:
    """Pairs of intervals of different zones that share an address, some for each such place; ``zones`` are merged."""
    ends = zones.groupBy("lo").agg(F.max(F.struct("hi", "zone")).alias("e"), F.min("zone").alias("one"), F.max("zone").alias("other"))
    reached = scans.running(ends, "lo", {"reach": scans.Run("max", F.col("e"))}, before=True, bits=TWICE)
    same = reached.where("one <> other").select(F.col("one").alias("zone"), F.col("other").alias("next_zone"))
    return same.unionAll(reached.where("reach.hi >= lo").select("reach.zone", F.col("e.zone").alias("next_zone"))).distinct()


def merged_rows(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same for a few ``(zone, lo, hi)``, or an error if two zones overlap."""
    out: list[list[int]] = []
    for zone, lo, hi in sorted(rows):
        if out and out[-1][0] == zone and lo <= out[-1][2] + 1:
            out[-1][2] = max(out[-1][2], hi)
        else:
            out.append([zone, lo, hi])
    out.sort(key=lambda i: i[1])
    for one, other in zip(out, out[1:], strict=False):
        if other[1] <= one[2]:
            raise ValueError(f"zones {one[0]} and {other[0]} overlap")
    return [tuple(i) for i in out]


def _few(zones: DataFrame) -> list[tuple[int, int, int]] | None:
    """The intervals, if there are no more than ``INLINE``; one job answers it."""
    rows = zones.select(F.col("zone").cast("int"), F.col("lo").cast("long"), F.col("hi").cast("long")).limit(INLINE + 1).collect()
    return [tuple(r) for r in rows] if len(rows) <= INLINE else None


def check(zones: DataFrame) -> DataFrame:
    """The merged intervals of ``zones``, or an error if two zones overlap."""
    few = _few(zones)
    if few is not None:
        return zones.sparkSession.createDataFrame(merged_rows(few), "zone int, lo long, hi long")
    merged = merge(zones.select(F.col("zone").cast("int").alias("zone"), "lo", "hi"))
    bad = overlaps(merged).first()
    if bad:
        raise ValueError(f"zones {bad[0]} and {bad[1]} overlap")
    return merged


def label_expression(ip: Column, intervals: list[tuple[int, int, int]]) -> Column:
    """The zone of an address as one expression; null outside."""
    out = F.lit(None).cast("int")
    for zone, lo, hi in sorted(intervals, key=lambda i: i[1], reverse=True):
        out = F.when(ip.between(lo, hi), F.lit(zone)).otherwise(out)
    return out


def named(ids: DataFrame, merged: DataFrame) -> DataFrame:
    """``ids(ip)`` that lie in one of the disjoint intervals, with its ``zone``.

    Addresses and the beginnings of intervals form one order, and each address
    takes the last interval that began; a bin of it has bounded size.
    """
    begun = merged.select((F.col("lo") * 2).alias("at"), F.struct("zone", "hi").alias("z"))
    both = ids.select((F.col("ip") * 2 + 1).alias("at"), "ip").unionByName(begun, allowMissingColumns=True)
    found = scans.running(both, "at", {"f": scans.Run("last", F.col("z"))}, bits=TWICE)
    return found.where("ip <= f.hi").select("ip", "f.zone")


def label(edges: DataFrame, zones: DataFrame, complement: bool = True) -> DataFrame:
    """``edges`` with ``zone_src`` and ``zone_dst``.

    Intervals of a zone may repeat or overlap; zones that share an address are
    an error. With ``complement`` addresses outside all zones get the number
    after the last zone; without it, links with such an address are dropped. A
    few intervals become one expression, so no row moves; for many, the
    distinct addresses are scanned together with the intervals.
    """
    few = _few(zones)
    if few is not None:
        intervals, last = merged_rows(few), max((z for z, _, _ in few), default=0)
        out = edges.withColumn("zone_src", label_expression(F.col("src"), intervals)).withColumn("zone_dst", label_expression(F.col("dst"), intervals))
    else:
        merged = check(zones)
        last = merged.agg(F.max("zone")).first()[0]
        found = named(edges.select(F.explode(F.array("src", "dst")).alias("ip")).distinct(), merged)
        side = lambda end: found.select(F.col("ip").alias(end), F.col("zone").alias(f"zone_{end}"))
        out = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left").select(*edges.columns, "zone_src", "zone_dst")
    if complement:
        return out.withColumns({z: F.coalesce(z, F.lit(last + 1)) for z in ("zone_src", "zone_dst")})
    return out.where("zone_src is not null and zone_dst is not null")


def zone_ids(zones: DataFrame, complement: bool = True) -> DataFrame:
    ids = zones.select(F.col("zone").cast("int").alias("zone")).distinct()
    return ids.unionByName(zones.agg((F.coalesce(F.max("zone"), F.lit(0)) + 1).cast("int").alias("zone"))) if complement else ids


def pair_quantities(edges: DataFrame, zones: DataFrame, complement: bool = True, by: tuple[str, ...] = ()) -> DataFrame:
    """The nine quantities of each pair of zones, in one pass over the links.

    Without ``by`` pairs that have no link are there with zeros.
    """
    found = stats.quantities(label(edges, zones, complement), (*by, "zone_src", "zone_dst"))
    if by:
        return found
    ids = zone_ids(zones, complement).agg(F.collect_set("zone").alias("ids"))
    all_pairs = ids.select(F.explode("ids").alias("zone_src"), "ids").select("zone_src", F.explode("ids").alias("zone_dst"))
    return all_pairs.join(found, ["zone_src", "zone_dst"], "left").na.fill(0, list(stats.QUANTITIES))


def inside(edges: DataFrame, zones: DataFrame, end: str) -> DataFrame:
    """Links whose ``end`` (src or dst) lies in one of the zones, which may overlap."""
    return _by_place(edges, zones, end, True)


def outside(edges: DataFrame, zones: DataFrame, end: str) -> DataFrame:
    """Links whose ``end`` lies in none of the zones: everything else."""
    return _by_place(edges, zones, end, False)


def _by_place(edges: DataFrame, zones: DataFrame, end: str, wanted: bool) -> DataFrame:
    one = zones.withColumn("zone", F.lit(0))
    few = _few(one)
    if few is not None:
        held = label_expression(F.col(end), merged_rows(few)).isNotNull()
        return edges.where(held if wanted else ~held)
    found = named(edges.select(F.col(end).alias("ip")).distinct(), merge(one)).select(F.col("ip").alias(end))
    return edges.join(found, end, "left_semi" if wanted else "left_anti")
