"""Names of windows and of statistics columns, and small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_name(ts: Column, packets: Column) -> Column:
    """``yyyyMMdd-HHmmss-micros.packets`` of a window's first packet."""
    return F.concat(F.date_format(ts, "yyyyMMdd-HHmmss"), F.lit("-"), (F.unix_micros(ts.cast("timestamp")) % 1_000_000).cast("string"), F.lit("."), packets.cast("string"))


def clean_window_name(name: Column, suffix: str = ".8388608") -> Column:
    return F.replace(name, F.lit(suffix), F.lit(""))


def zone_column(metric: Column, zone_src: Column, zone_dst: Column, delimiter: str = "_") -> Column:
    """``sub_<metric>_<i>_<j>``, or ``sub-<metric>-<i>_<j>`` with the other delimiter."""
    return F.concat(F.lit("sub" + delimiter), metric, F.lit(delimiter), zone_src.cast("string"), F.lit("_"), zone_dst.cast("string"))


def parse_zone_column(name: Column) -> tuple[Column, Column, Column]:
    """Metric and both zones of a column name; zones are null for the whole matrix."""
    pattern = r"^sub[_-](.+?)[_-](\d+)_(\d+)$"
    zoned = name.rlike(pattern)
    part = lambda i: F.regexp_extract(name, pattern, i)
    return F.when(zoned, part(1)).otherwise(name), F.when(zoned, part(2).cast("int")), F.when(zoned, part(3).cast("int"))


def time_at(start: Column, end: Column, offset: Column, total: Column) -> Column:
    """Whole-number time of ``offset`` out of ``total`` between start and end; 0 where that makes no sense."""
    fine = (total > 0) & (end >= start) & (offset >= 0) & (offset <= total)
    return F.when(fine, start + F.floor((end - start) * offset / F.when(total > 0, total)).cast("long")).otherwise(F.lit(0).cast("long"))


def severity(z: Column) -> Column:
    """``alert`` from 3 up, ``warning`` from 1.5 up, else ``normal``."""
    return F.when(F.abs(z) >= 3, "alert").when(F.abs(z) >= 1.5, "warning").otherwise("normal")


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time as its clock shows it, with or without a time zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    seconds = F.datediff(ts, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + F.hour(ts) * 3_600 + F.minute(ts) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
