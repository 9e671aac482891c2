"""Row choices that dashboards make: axis ticks, pages, names of metrics and zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows

#: Screen length of an axis and the least distance of two ticks on it.
AXIS, GAP = 480, 40


def _lookup(key: Column, names: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[key]


def metric_name(metric: Column) -> Column:
    """The name shown for a metric: the words of its identifier, the first letter of each a capital."""
    return F.initcap(F.replace(metric, F.lit("_"), F.lit(" ")))


def zone_name(zone: Column, names: tuple[str, ...]) -> Column:
    """The name of a zone, counted from 1; null beyond the names."""
    return _lookup(zone, dict(enumerate(names, 1)))


def cell_zones(row: Column, column: Column, zones: int) -> tuple[Column, Column]:
    """Source and destination zone of a shown cell; rows go from the last zone to the first."""
    return F.lit(zones) - row, column + 1


def every(ids: DataFrame, column: str, most: int) -> DataFrame:
    """About ``most`` ids in order: every k-th. They are numbered slice by slice, in no single task."""
    step = max(1, -(-ids.count() // most))
    ranked = windows.running_total(ids, column, F.lit(1), "__n")
    return ranked.where(F.pmod(F.col("__n") - 1, F.lit(step)) == 0).drop("__n")


def spaced(ids: DataFrame, column: str, axis: int = AXIS, gap: int = GAP) -> DataFrame:
    """Ids of an axis so that two neighbours shown are ``gap`` of ``axis`` points apart at least.

    The next one shown is the least id beyond the gap: an aggregate over all
    ids, so they never meet in one task. An axis has room for ``axis / gap`` of
    them and one more.
    """
    lo, hi = ids.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return ids.select(column)
    least = max(1, gap * (hi - lo) / axis)
    shown, last = [], lo
    while last is not None:
        shown.append(last)
        last = ids.where(F.col(column) - last >= least).agg(F.min(column)).first()[0]
    return ids.where(F.col(column).isin(shown)).select(column).distinct()


def page(rows: DataFrame, order: str, number: int, size: int = 20) -> DataFrame:
    """One page of a table, counted from 0."""
    return rows.orderBy(order).offset(number * size).limit(size)


def links_of_cell(edges: DataFrame, window: int | str, zone_src: int, zone_dst: int) -> DataFrame:
    """The links of a pair of zones in a window; an error if the window isn't there."""
    found = edges.where(F.col("window") == window)
    if found.isEmpty():
        raise ValueError(f"no window {window}")
    return found.where((F.col("zone_src") == zone_src) & (F.col("zone_dst") == zone_dst))
