"""Shards of near-equal size from sampled splitters.

Records are ordered by a hash of their text and then their id, so equal texts
are neighbours and yet a huge group of them can be cut. A sample that favours
large records gives the quantiles that cut this order into many more ranges
than shards; ranges that turn out overfull are sampled and cut again. Rows
are numbered inside their range only. With the ranges' totals in front, each
row knows the bytes before it in the whole order, and that number alone decides
its shard.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

SHARDS = 16
#: Ranges: enough for rows of one to be sorted in a task, few enough for their totals to fit the driver.
LEAST_RANGES, MOST_RANGES, ROWS_A_RANGE = 256, 4_096, 500_000
#: Sampled keys for each range; the sample on the driver is at most this times ``MOST_RANGES``.
SAMPLES = 48
#: A range is overfull beyond this many times its share.
OVERFULL = 2
_LOWEST = -(1 << 63)

Key = tuple[int, int, int]


def keys(docs: DataFrame, nth: Column | None = None) -> DataFrame:
    """``doc_id, h, id, nth, size, text_crc32``: the sort key and size of each row, without its text.

    ``nth`` numbers the rows; by default it is their place in the input.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        F.xxhash64(text).alias("h"),
        F.coalesce("doc_id", F.lit(_LOWEST)).alias("id"),
        (F.monotonically_increasing_id() if nth is None else nth).alias("nth"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )


def sampled(rows: DataFrame, total: int, wanted: int) -> list[tuple[Key, float]]:
    """About ``wanted`` keys, drawn in proportion to size, each with the bytes that it stands for.

    A hash of the key makes the draw, so a task that runs again draws the same.
    """
    rate = wanted / max(1, total)
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("draw"), "h", "id", "nth"), 11) / F.lit(float(1 << 53))
    found = rows.where(draw < F.col("size") * F.lit(rate)).select("h", "id", "nth", "size")
    return [((r[0], r[1], r[2]), max(1 / rate, r[3])) for r in found.toLocalIterator()]


def splitters(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    """Keys that cut the sample into ``parts`` of about equal weight."""
    sample = sorted(sample)
    if not sample:
        return []
    run = np.cumsum([w for _, w in sample])
    at = np.minimum(len(sample) - 1, np.searchsorted(run, run[-1] * np.arange(1, parts) / parts))
    return sorted({sample[i][0] for i in at.tolist()})


def placed(rows: DataFrame, cuts: list[Key]) -> DataFrame:
    """``rows`` with ``range``: how many of ``cuts`` lie at or before the key."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([*rows.schema.fields, StructField("range", IntegerType())])
    names, out = rows.columns, to_arrow_schema(schema)
    heads = np.array([c[0] for c in cuts], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(names.index("h")).to_numpy()
            low, high = np.searchsorted(heads, h, "left"), np.searchsorted(heads, h, "right")
            at = np.flatnonzero(low != high)  # a splitter has the same hash: ids decide
            if len(at):
                same = zip(*(batch.column(names.index(c)).take(pa.array(at)).to_pylist() for c in ("h", "id", "nth")), strict=True)
                low[at] = [bisect_right(cuts, key) for key in same]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low.astype(np.int32))], schema=out)

    return rows.mapInArrow(run, schema)


def assign(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for each row of ``docs``.

    ``size`` is the UTF-8 length of the text plus 1; shards differ in size by
    about one record. A null text has no bytes and counts as empty; a null
    doc_id sorts first among equal texts; repeated rows are records of their
    own and ties among them go by their place in the input. Slots count from 0
    in each shard without gaps. Extra columns are ignored; an empty table gives
    an empty result.
    """
    return _assign(docs, shards).drop("nth")


def _assign(docs: DataFrame, shards: int, nth: Column | None = None) -> DataFrame:
    spark = docs.sparkSession
    rows = materialise(keys(docs, nth), "keys")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    parts = int(min(MOST_RANGES, max(LEAST_RANGES, n // ROWS_A_RANGE)))
    cuts = splitters(sampled(rows, total, parts * SAMPLES), parts)
    # a row beyond a range's share gets a range of its own: there are at most as many as ranges
    for r in rows.where(F.col("size") > total / parts).select("h", "id", "nth").toLocalIterator():
        cuts += [(r[0], r[1], r[2]), (r[0], r[1], r[2] + 1)]
    cuts = sorted({*cuts})
    while True:  # each round has new cuts, so it ends; the totals are always those of the last cuts
        ranged = placed(rows, cuts)
        stats = {r[0]: (r[1], r[2]) for r in ranged.groupBy("range").agg(F.count("*"), F.sum("size")).collect()}
        full = [r for r, (count, size) in stats.items() if count > 1 and size > OVERFULL * total / parts]
        if not full:
            break
        size = sum(stats[r][1] for r in full)
        again: dict[int, list[tuple[Key, float]]] = {}
        for item in sampled(ranged.where(F.col("range").isin(full)), size, max(1, size * parts // total) * SAMPLES):
            again.setdefault(bisect_right(cuts, item[0]), []).append(item)
        more = {c for r, items in again.items() for c in splitters(items, 1 + int(2 * stats[r][1] * parts // total))} - set(cuts)
        if not more:
            break
        cuts = sorted({*cuts, *more})
    ids = sorted(stats)
    before = zip(ids, accumulate((stats[r][0] for r in ids[:-1]), initial=0), accumulate((stats[r][1] for r in ids[:-1]), initial=0), strict=True) if ids else []
    base = spark.createDataFrame([*before], "range int, rows_before long, bytes_before long")
    here = Window.partitionBy("range").orderBy("h", "id", "nth")
    row = F.row_number().over(here) - 1
    start = F.sum("size").over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    found = (
        placed(rows, cuts)
        .select("doc_id", "nth", "size", "text_crc32", "range", row.alias("row"), start.alias("start"))
        .join(base, "range")
        .select("doc_id", "nth", "size", "text_crc32", (F.col("row") + F.col("rows_before")).alias("row"), F.expr(f"cast((start + bytes_before) * {shards} div {max(1, total)} as int)").alias("shard"))
    )
    found = materialise(found, "placed")
    counted = found.groupBy("shard").agg(F.min("row"), F.count("*")).collect()
    if sum(r[2] for r in counted) != n:
        raise RuntimeError("rows without a range")
    first = {r[0]: r[1] for r in counted}
    starts = F.array(*(F.lit(first.get(s, 0)).cast("long") for s in range(shards)))
    return found.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("row") - F.get(starts, F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "nth",
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write the rows of ``docs`` under ``path`` with a folder for each shard, its columns unchanged.

    Rows are numbered first, so repeated and null ids all keep their own place;
    a column ``shard`` of ``docs`` itself is left out, as the folders tell it.
    """
    mark = "_" * max(map(len, docs.columns)) + "nth"  # longer than any column of docs
    numbered = materialise(docs.withColumn(mark, F.monotonically_increasing_id()), "numbered")
    where = _assign(numbered, shards, F.col(mark)).select(F.col("nth").alias(mark), "shard")
    numbered.drop("shard").join(where, mark).drop(mark).write.partitionBy("shard").parquet(path)
