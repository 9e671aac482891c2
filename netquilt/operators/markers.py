"""Marks that demarcate events in a log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquilt.functions.naming import micros

from . import scans


def spans(lines: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``lines(ts, text)`` that hold a mark, with ``mark``, ``started`` and ``elapsed``.

    A line with START is a start, whatever else it holds; one with END is an
    end. ``started`` is the time of the last start up to the line, and an end
    also has the seconds since then; both are null if nothing has started.
    Times differ within a group of ``by``; a log of any length is scanned in bins.
    """
    mark = F.when(F.contains(F.col("text"), F.lit("START")), "START").when(F.contains(F.col("text"), F.lit("END")), "END")
    marked = lines.withColumn("mark", mark).where("mark is not null").withColumn("__at", micros("ts"))
    begun = scans.running(marked, "__at", {"__s": scans.Run("last", F.when(F.col("mark") == "START", F.struct("ts", "__at")))}, by)
    elapsed = F.when(F.col("mark") == "END", (F.col("__at") - F.col("__s.__at")) / 1_000_000)
    return begun.select(*lines.columns, "mark", F.col("__s.ts").alias("started"), elapsed.alias("elapsed"))
