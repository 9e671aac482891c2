"""Streams: windows of a fixed number of packets, and running matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netquilt.operators import windows
from netquilt.sources.versions import Versions

#: Windows that are cut at once.
AT_ONCE = 1_000
LINKS = "shard string, subwindow long, src long, dst long, packets long"
STATE = "window long, filled long, links binary"


def count_windows(packets: DataFrame, shard: str, order: str, size: int, at_end: str = "keep", idle: str = "1 hour") -> DataFrame:
    """Complete windows of ``size`` packets of each shard, as links.

    Shards count on their own, as capture queues do; a constant shard column
    gives global windows in one task. A packet carries its weight in
    ``packets``; one that crosses a border is split, some windows at a time. An
    unfinished window waits in the state as combined links, so its size is
    bounded by ``size``. Packets of a shard are taken in the order of ``order``
    within a micro-batch.

    What is there at the end stays in the checkpoint (``unfinished`` gives it
    from a batch). With ``at_end`` of ``flush`` or ``drop`` it doesn't: when the
    watermark of ``ts`` is ``idle`` past a shard's last packet, a timer of that
    shard hands its open window on as it is, or forgets it; the shard's next
    packet begins the next window.
    """
    if at_end not in ("keep", "flush", "drop"):
        raise ValueError(f"not a policy for the end: {at_end}")
    wait = int(pd.Timedelta(idle) / pd.Timedelta("1ms"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window, filled, held = state.get if state.exists else (0, 0, b"")
        open_ = _links(held)
        if state.hasTimedOut:
            if at_end == "flush" and filled:
                yield pd.DataFrame({"shard": str(key[0]), "subwindow": window, "src": open_["src"], "dst": open_["dst"], "packets": open_["packets"]})
            state.update((window + (filled > 0), 0, b""))
            return
        new = pd.concat(list(frames)).sort_values(order, kind="stable")
        latest = max(int(new["ts"].max().value // 1_000_000), state.getCurrentWatermarkMs()) if at_end != "keep" else 0
        new = new[new["packets"] > 0]
        src, dst = new["src"].to_numpy(np.int64), new["dst"].to_numpy(np.int64)
        hi = filled + np.cumsum(new["packets"].to_numpy(np.int64))
        lo = np.r_[filled, hi[:-1]][: len(hi)]
        total = int(hi[-1]) if len(hi) else filled
        for begin in range(0, total // size + 1, AT_ONCE):
            # the part of each packet in these windows, a row for each window that it touches
            first, last = begin * size, (begin + AT_ONCE) * size
            mine = np.flatnonzero((hi > first) & (lo < last))
            a, b = np.maximum(lo[mine], first), np.minimum(hi[mine], last)
            times = (b - 1) // size - a // size + 1
            row = np.repeat(np.arange(len(mine)), times)
            at = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times) + (a // size)[row]
            part = np.minimum(b[row], (at + 1) * size) - np.maximum(a[row], at * size)
            both = pd.DataFrame({"w": at, "src": src[mine][row], "dst": dst[mine][row], "packets": part})
            if begin == 0:
                both = pd.concat([open_.assign(w=0), both])
            both = both.astype("int64").groupby(["w", "src", "dst"], as_index=False)["packets"].sum()
            done, open_ = both[both["w"] < total // size], both[both["w"] >= total // size]
            if len(done):
                yield pd.DataFrame({"shard": str(key[0]), "subwindow": window + done["w"], "src": done["src"], "dst": done["dst"], "packets": done["packets"]})
        state.update((window + total // size, total % size, _packed(open_)))
        if at_end != "keep":
            state.setTimeoutTimestamp(latest + max(1, wait))

    timer = GroupStateTimeout.NoTimeout if at_end == "keep" else GroupStateTimeout.EventTimeTimeout
    return packets.groupBy(shard).applyInPandasWithState(step, LINKS, STATE, "append", timer)


def global_windows(packets: DataFrame, order: str, size: int, path: str, checkpoint: str):
    """Windows of ``size`` packets over all shards together, as a stream in the order of ``order``.

    There are two levels: the packets of a micro-batch are numbered side by
    side in bins of the order, whatever their number, and one count of all
    packets before the batch, kept in commits under ``path``, moves them on. A
    batch writes its parts of windows to a folder of its own number and then
    commits the count, so a repeated batch finds the same count and replaces
    what it wrote. ``windows_so_far`` puts the parts together.
    """

    def add(batch: DataFrame, number: int) -> None:
        table = Versions(batch.sparkSession, f"{path}/counts")
        done, state = table.latest()
        before = 0 if number == 0 else (state if done == number else table.at(number))["after"]
        cut = windows.weighted_windows(batch, order, size, before)
        parts = cut.groupBy("subwindow", "src", "dst").agg(F.sum("packets").alias("packets"))
        parts.write.mode("overwrite").parquet(f"{path}/parts/batch={number}")
        if done <= number:
            held = batch.sparkSession.read.parquet(f"{path}/parts/batch={number}").agg(F.sum("packets")).first()[0] or 0
            table.commit(number + 1, {"before": before, "after": before + held, "size": size})

    return packets.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows_so_far(spark: SparkSession, path: str, at_end: str = "drop") -> DataFrame:
    """``subwindow, src, dst, packets`` of ``global_windows``: the complete windows, and with ``flush`` the open one too."""
    count = Versions(spark, f"{path}/counts").latest()[1]
    parts = spark.read.schema("subwindow long, src long, dst long, packets long, batch long").parquet(f"{path}/parts")
    parts = parts.where(F.col("batch") < Versions(spark, f"{path}/counts").latest()[0])
    if at_end == "drop":
        parts = parts.where(F.col("subwindow") < count["after"] // count["size"])
    return parts.groupBy("subwindow", "src", "dst").agg(F.sum("packets").alias("packets"))


def _packed(links: pd.DataFrame) -> bytes:
    """Links as an Arrow stream."""
    out = pa.BufferOutputStream()
    table = pa.table({c: pa.array(links[c].to_numpy(np.int64)) for c in ("src", "dst", "packets")})
    with pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table)
    return out.getvalue().to_pybytes()


def _links(held: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(held)).read_all().to_pandas() if held else pd.DataFrame({c: np.empty(0, np.int64) for c in ("src", "dst", "packets")})


def unfinished(packets: DataFrame, shard: str, order: str, size: int) -> DataFrame:
    """The last window of each shard of a batch, if it isn't full: what a stream over the same packets keeps back."""
    cut = windows.running_total(packets.where("packets > 0"), order, F.col("packets"), "hi", (shard,))
    totals = cut.groupBy(F.col(shard).alias("__shard")).agg((F.max("hi") - F.max("hi") % size).alias("full"))
    tail = cut.join(totals, F.col(shard).eqNullSafe(F.col("__shard"))).where("hi > full").withColumn("packets", F.least("packets", F.col("hi") - F.col("full")))
    return tail.groupBy(F.col(shard).cast("string").alias("shard"), F.expr(f"full div {size}").alias("subwindow"), "src", "dst").agg(F.sum("packets").alias("packets"))


def sliding_windows(packets: DataFrame, length: str, step: str, late: str) -> DataFrame:
    """Windows by time that overlap."""
    return packets.withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "src", "dst").agg(F.count("*").alias("packets"))


def sessions(packets: DataFrame, gap: str, late: str) -> DataFrame:
    """The packets of each link until it is silent for ``gap``."""
    return packets.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "src", "dst").agg(F.count("*").alias("packets"))


def running_matrix(links: DataFrame) -> DataFrame:
    """The matrix of all links so far; for output modes complete and update."""
    return links.groupBy("src", "dst").agg(F.sum("packets").alias("packets"))


def time_windows(packets: DataFrame, length: str, late: str) -> DataFrame:
    """Windows by time instead of count; packets later than ``late`` are left out."""
    return packets.withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "src", "dst").agg(F.count("*").alias("packets"))


def append_windows(links: DataFrame, path: str, checkpoint: str):
    """Write complete windows as they come; the checkpoint makes each window appear once."""
    return links.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
