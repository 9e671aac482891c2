"""Windows of a fixed number of packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans

#: Packets in a matrix, and matrices in a window file.
SUBWINDOW, SUBWINDOWS = 1 << 17, 64


def running_total(rows: DataFrame, order: str, weight: Column, name: str, by: tuple[str, ...] = (), bits: int = 54) -> DataFrame:
    """``rows`` with ``name``: the sum of ``weight`` up to and with each row, within its group of ``by`` if given.

    ``order`` is a whole number without ties, of so many bits; see ``scans``.
    """
    return scans.running(rows, order, {name: scans.Run("sum", weight.cast("long"))}, by, bits=bits)


def count_windows(packets: DataFrame, order: str, size: int = SUBWINDOW, per_file: int = SUBWINDOWS, by: tuple[str, ...] = ()) -> DataFrame:
    """Packets with ``subwindow`` (each ``size`` packets) and ``window`` (each ``per_file`` subwindows)."""
    numbered = running_total(packets, order, F.lit(1), "__n", by)
    return numbered.withColumn("subwindow", F.floor((F.col("__n") - 1) / size)).withColumn("window", F.floor(F.col("subwindow") / per_file)).drop("__n")


def weighted_windows(links: DataFrame, order: str, size: int = SUBWINDOW, offset: int = 0) -> DataFrame:
    """Links with ``subwindow``, cut where the total of ``packets`` fills a window.

    A link that crosses a border is split, so every window but the last holds
    exactly ``size`` packets. Links without packets are dropped. ``offset``
    packets are taken to have come before.
    """
    run = running_total(links.where("packets > 0"), order, F.col("packets"), "__hi").withColumn("__hi", F.col("__hi") + offset)
    lo = F.col("__hi") - F.col("packets")
    parts = run.withColumn("__lo", lo).withColumn("subwindow", F.explode(F.expr(f"sequence(__lo div {size}, (__hi - 1) div {size})")))
    start = F.col("subwindow") * size
    return parts.withColumn("packets", F.least(F.col("__hi"), start + size) - F.greatest(F.col("__lo"), start)).drop("__lo", "__hi")


def drop_tail(windowed: DataFrame, size: int, weight: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Without the last window of each run, if it holds fewer than ``size`` packets."""
    keys = [*by, "subwindow"]
    full = windowed.groupBy(*keys).agg(F.sum(weight if weight is not None else F.lit(1)).alias("__n")).where(F.col("__n") >= size)
    return windowed.join(full.drop("__n"), keys, "left_semi")


def starts(windowed: DataFrame, ts: str, order: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Time of the first packet of each window."""
    return windowed.groupBy(*by, "subwindow").agg(F.min_by(ts, order).alias("start_ts"))
