"""Statistics over windows, from the long table ``(window, zone_src, zone_dst, metric, value)``.

A missing cell counts as 0. Windows are ordered by their key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows that meet the cells at once.
BLOCK = 5_000
CELL = ("zone_src", "zone_dst", "metric")


def densify(stats: DataFrame) -> DataFrame:
    """Every cell in every window, absent ones as 0.

    Windows are dealt into blocks by hash, and cells meet a block at a time, so
    neither side is gathered; the rows made are those of the result.
    """
    blocks = max(1, stats.select("window").distinct().count() // BLOCK)
    windows = stats.select("window").distinct().groupBy(F.pmod(F.hash("window"), F.lit(blocks)).alias("__b")).agg(F.collect_list("window").alias("__ws"))
    grid = stats.select(*CELL).distinct().withColumn("__b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(windows, "__b")
    grid = grid.select("*", F.explode("__ws").alias("window"), F.lit(0).cast("long").alias("value")).select("window", *CELL, "value")
    # absent cells are rows of 0, so the two sides need no join
    return stats.select("window", *CELL, "value").unionByName(grid).groupBy("window", *CELL).agg(F.sum("value").alias("value"))


def summary(stats: DataFrame) -> DataFrame:
    """``current, median, max, argmax_window`` of each cell; of equal maxima the first window counts.

    Values are at least 0. Absent windows enter as one row of 0 a cell with
    their number as its weight, so nothing is spelt out.
    """
    n, first, last = stats.agg(F.count_distinct("window"), F.min("window"), F.max("window")).first()
    zeros = stats.groupBy(*CELL).agg((F.lit(n) - F.count("*")).alias("__f")).where("__f > 0")
    rows = stats.select(*CELL, "window", "value", F.lit(1).cast("long").alias("__f")).unionByName(zeros.withColumn("value", F.lit(0).cast("long")), allowMissingColumns=True)
    best = F.min(F.when(F.col("window").isNotNull(), F.struct((-F.col("value")).alias("v"), F.col("window"))))
    found = rows.groupBy(*CELL).agg(
        F.coalesce(F.max(F.when(F.col("window") == last, F.col("value"))), F.lit(0)).alias("current"),
        F.percentile("value", F.lit(0.5), F.col("__f")).alias("median"),
        F.max("value").alias("max"),
        best["window"].alias("argmax_window"),
    )
    return found.withColumn("argmax_window", F.when(F.col("max") == 0, F.lit(first)).otherwise(F.col("argmax_window")))


def zone_matrix(cells: DataFrame, value: str, n: int) -> DataFrame:
    """One row for each source zone, the last first, with a column ``z<j>`` for each destination zone."""
    return cells.groupBy("zone_src").pivot("zone_dst", list(range(1, n + 1))).agg(F.first(value)).select("zone_src", *(F.col(str(j)).alias(f"z{j}") for j in range(1, n + 1))).orderBy(F.desc("zone_src"))


def ratio(numerator: Column, denominator: Column) -> Column:
    """Null where the denominator is 0; nulls count as 0."""
    return F.try_divide(F.coalesce(numerator, F.lit(0)).cast("double"), F.coalesce(denominator, F.lit(0)).cast("double"))


def metric_ratio(cells: DataFrame, value: str, over: str, under: str, window: int | str | None = None) -> DataFrame:
    """Ratio of two metrics in each pair of zones, or in one window of each; one pass, no join.

    A pair of zones that the window lacks stays, with a null.
    """
    here = F.lit(True) if window is None else F.col("window") == window
    pick = lambda m: F.max(F.when(here & (F.col("metric") == m), F.col(value)))
    return cells.where(F.col("metric").isin(over, under)).groupBy("zone_src", "zone_dst").agg(ratio(pick(over), pick(under)).alias("ratio"))


def window_ratio(stats: DataFrame, metric: str, over: str, under: str) -> DataFrame:
    """Ratio of one metric in two windows."""
    pick = lambda w: F.max(F.when(F.col("window") == w, F.col("value")))
    return stats.where(F.col("metric") == metric).groupBy("zone_src", "zone_dst").agg(ratio(pick(over), pick(under)).alias("ratio"))


def context_ratio(summaries: DataFrame, metric: str, over: str, under: str) -> DataFrame:
    """Ratio of two summaries (current, median, max) of one metric."""
    return summaries.where(F.col("metric") == metric).select("zone_src", "zone_dst", ratio(F.col(over), F.col(under)).alias("ratio"))


def middles(stats: DataFrame) -> DataFrame:
    """``m, d`` of each cell: the median of its series and the median distance from it.

    Absent windows count as 0 by their number, so no series is spelt out, and
    one that is long is counted by value before it moves.
    """
    n = stats.select("window").distinct().count()
    seen = stats.groupBy(*CELL, F.col("value").cast("double").alias("value")).agg(F.count("*").alias("f"))
    zeros = seen.groupBy(*CELL).agg((F.lit(n) - F.sum("f")).alias("f")).where("f > 0").select(*CELL, F.lit(0.0).alias("value"), "f")
    both = seen.unionByName(zeros)
    median = both.groupBy(*CELL).agg(F.percentile("value", F.lit(0.5), F.col("f")).alias("m"))
    return both.join(median, list(CELL)).groupBy(*CELL, "m").agg(F.percentile(F.abs(F.col("value") - F.col("m")), F.lit(0.5), F.col("f")).alias("d"))


def z_scores(stats: DataFrame) -> DataFrame:
    """Robust z-score of each value in its cell's series: 0.6745 (x - median) / MAD, 0 where MAD is 0."""
    w = densify(stats).join(middles(stats), list(CELL))
    z = F.when(F.col("d") == 0, 0.0).otherwise(0.6745 * (F.col("value") - F.col("m")) / F.when(F.col("d") != 0, F.col("d")))
    return w.withColumn("z", z).select("window", *CELL, "value", "z")


def window_z_scores(stats: DataFrame, metric: str, window: int | str, n: int) -> DataFrame:
    """The z-scores of one metric in a chosen window, as a matrix of zones."""
    cells = z_scores(stats.where(F.col("metric") == metric)).where(F.col("window") == window)
    return zone_matrix(cells, "z", n)


def last_z_scores(stats: DataFrame) -> DataFrame:
    """The z-score of each cell's last window."""
    return z_scores(stats).groupBy(*CELL).agg(F.max_by("z", "window").alias("z"))


def series(stats: DataFrame, metric: str, zone_src: int, zone_dst: int) -> DataFrame:
    """One cell over time, in order."""
    return stats.where((F.col("metric") == metric) & (F.col("zone_src") == zone_src) & (F.col("zone_dst") == zone_dst)).select("window", "value").orderBy("window")


def windows(stats: DataFrame) -> DataFrame:
    """The windows with their position."""
    names = stats.select("window").distinct()
    return names.withColumn("position", F.row_number().over(Window.orderBy("window")))  # one row a window


def latest(stats: DataFrame, order: str) -> DataFrame:
    """One value for each cell and window, the one written last."""
    best = F.max_by(F.struct("value"), order)
    return stats.groupBy("window", *CELL).agg(best.alias("v")).select("window", *CELL, "v.value")
