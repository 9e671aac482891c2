"""A stored statistics table whose cells are added or replaced."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .versions import Versions

LONG = "window string, zone_src int, zone_dst int, metric string, value double"
CELL = ("window", "zone_src", "zone_dst", "metric")
#: Writes that are read together before they are written as one.
PARTS = 16


def _latest(parts: list[DataFrame]) -> DataFrame:
    """One value a cell, that of the last part which has it."""
    numbered = [p.withColumn("__n", F.lit(i)) for i, p in enumerate(parts)]
    return reduce(DataFrame.unionAll, numbered).groupBy(*CELL).agg(F.max_by(F.struct("value"), "__n").alias("v")).select(*CELL, "v.value")


def upsert_stats(stats: DataFrame, folder: str, order: str | None = None) -> int:
    """Add the cells of ``stats`` to the table in ``folder``, in place of those it has; the number of the new version.

    Of several values of a cell in ``stats`` the last by ``order`` counts, or
    else the greatest. The cells are written as they are, long, so neither
    zones nor windows are limited; a write that fails or is cut off changes
    nothing.
    """
    spark = stats.sparkSession
    table = Versions(spark, folder)
    number, state = table.latest()
    one = F.max_by(F.struct(F.col("value").cast("double").alias("value")), order) if order else F.max(F.struct(F.col("value").cast("double").alias("value")))
    new = stats.groupBy(F.col("window").cast("string").alias("window"), F.col("zone_src").cast("int").alias("zone_src"), F.col("zone_dst").cast("int").alias("zone_dst"), "metric").agg(one.alias("v")).select(*CELL, "v.value")
    path, parts = table.fresh("cells"), state.get("parts", [])
    if len(parts) + 1 >= PARTS:
        new, parts = _latest([*(spark.read.schema(LONG).parquet(p) for p in parts), new]), []
    new.write.parquet(path)
    table.commit(number + 1, {"parts": [*parts, path]})
    return number + 1


def stored_stats(spark: SparkSession, folder: str) -> DataFrame:
    """The cells of the table as it is now; none if there is no table."""
    parts = Versions(spark, folder).latest()[1].get("parts", [])
    if not parts:
        return spark.createDataFrame([], LONG)
    return _latest([spark.read.schema(LONG).parquet(p) for p in parts])
