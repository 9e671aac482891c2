"""Running values over an order of any length, in bins of bounded size.

The order is a whole number without ties. Its upper bits name a bin, so a bin
has at most ``2**BITS`` rows of a group, however many rows there are. Each bin
is summed up once; the bins' sums are scanned the same way, bins of bins, until
``2**TOP`` are left; and what has come before a bin enters it as a row in
front. So the input is read twice, the first time only its order, group and
value, and neither a global order nor a large group ever meets in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the order inside a bin, and those that are scanned at once at the top.
BITS, TOP = 17, 20


@dataclass(frozen=True)
class Run:
    """What is carried along: the ``sum``, the ``max`` or the ``last`` value that isn't null."""

    kind: str
    value: Column

    def whole(self, order: Column) -> Column:
        if self.kind == "last":
            return F.max_by(self.value, F.when(self.value.isNotNull(), order))
        return {"sum": F.sum, "max": F.max}[self.kind](self.value)

    def over(self, value: Column, window: Window) -> Column:
        if self.kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max}[self.kind](value).over(window)


def running(rows: DataFrame, order: str, runs: dict[str, Run], by: tuple[str, ...] = (), before: bool = False, bits: int = 54) -> DataFrame:
    """``rows`` with each of ``runs`` up to and with the row, or with ``before`` only up to it, within its group of ``by``.

    The order's values differ in their lower ``bits`` bits at most. Where
    nothing precedes a row its value is null. A null order comes first; nulls in
    ``by`` are one group.
    """
    last = -1 if before else Window.currentRow
    if bits <= TOP:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, last)
        return rows.withColumns({name: r.over(r.value, w) for name, r in runs.items()})
    mark = f"__{bits}"
    held = {name: f"{mark}_{i}" for i, name in enumerate(runs)}
    place = F.shiftright(F.col(order).cast("long"), BITS)
    bins = rows.groupBy(*by, place.alias(mark)).agg(*(r.whole(F.col(order)).alias(held[name]) for name, r in runs.items()))
    carried = {f"{c}c": Run(runs[name].kind, F.col(c)) for name, c in held.items()}
    ahead = running(bins, mark, carried, by, before=True, bits=bits - BITS).select(*by, mark, *(F.col(f"{c}c").alias(c) for c in held.values()))
    inside = rows.withColumns({mark: place, f"{mark}r": F.lit(1)} | {c: runs[name].value for name, c in held.items()})
    both = inside.unionByName(ahead.withColumn(f"{mark}r", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy(*by, mark).orderBy(f"{mark}r", order).rowsBetween(Window.unboundedPreceding, last)
    out = both.withColumns({name: runs[name].over(F.col(c), w) for name, c in held.items()})
    return out.where(F.col(f"{mark}r") == 1).select(*rows.columns, *runs)
