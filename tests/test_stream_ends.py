import random

import pytest
from pyspark.sql import functions as F

from netquilt.sources.versions import Versions
from netquilt.streaming import windows

SCHEMA = "seq long, us long, shard string, src long, dst long, packets long"


def write(spark, folder, name, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_micros(F.col("us") + 1_700_000_000_000_000))
    df.coalesce(1).write.parquet(f"{folder}/{name}")
    return df.schema


def live(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def plain(rows, size):
    """``(window, src, dst) -> packets`` by one packet after another."""
    out, n = {}, 0
    for _, _, _, src, dst, packets in sorted(rows):
        for _ in range(packets):
            out[n // size, src, dst] = out.get((n // size, src, dst), 0) + 1
            n += 1
    return out, n


@pytest.mark.parametrize("policy", ["flush", "drop", "keep"])
def test_what_is_open_at_the_end(spark, tmp_path, policy):
    """A shard that is silent is flushed or dropped by its timer, and goes on with the next window."""
    day = 86_400_000_000
    first = [(i, i * 1000, "a", 1, i % 3, 1) for i in range(25)] + [(100 + i, i * 1000, "b", 2, 2, 1) for i in range(10)]
    schema = write(spark, tmp_path / "in", "0", first)
    write(spark, tmp_path / "in", "1", [(900, 9 * day, "end", 0, 0, 1)])
    write(spark, tmp_path / "in", "2", [(901, 10 * day, "end", 0, 0, 1)])
    write(spark, tmp_path / "in", "3", [(1000 + i, 11 * day + i, "a", 7, 7, 1) for i in range(12)])
    packets = live(spark, tmp_path / "in", schema).withWatermark("ts", "1 hour")
    cut = windows.count_windows(packets, "shard", "seq", 10, at_end=policy, idle="2 hours")
    windows.append_windows(cut, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {}
    for r in spark.read.schema(windows.LINKS).parquet(str(tmp_path / "out")).where("shard in ('a', 'b')").collect():
        got[r["shard"], r["subwindow"]] = got.get((r["shard"], r["subwindow"]), 0) + r["packets"]
    want = {("a", 0): 10, ("a", 1): 10, ("b", 0): 10}
    # the five packets that were open: handed on, forgotten, or filled up by what comes later
    want |= {"flush": {("a", 2): 5, ("a", 3): 10}, "drop": {("a", 3): 10}, "keep": {("a", 2): 10}}[policy]
    assert got == want


def test_an_odd_policy_is_an_error(spark):
    with pytest.raises(ValueError, match="policy"):
        windows.count_windows(spark.range(1), "id", "id", 10, at_end="forget")


def test_windows_over_all_shards(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, i, rnd.choice("abc"), rnd.randrange(4), rnd.randrange(4), rnd.randrange(7)) for i in range(400)]
    want, total = plain(rows, 64)
    for k in range(4):
        schema = write(spark, tmp_path / "in", str(k), rows[100 * k : 100 * (k + 1)])
        # a stream that stops and starts again after each file
        windows.global_windows(live(spark, tmp_path / "in", schema), "seq", 64, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
        so_far, n = plain(rows[: 100 * (k + 1)], 64)
        for policy, kept in (("flush", so_far), ("drop", {w: p for w, p in so_far.items() if w[0] < n // 64})):
            assert {tuple(r)[:3]: r["packets"] for r in windows.windows_so_far(spark, str(tmp_path / "out"), policy).collect()} == kept
    number, state = Versions(spark, str(tmp_path / "out" / "counts")).latest()
    assert (number, state["after"]) == (4, total)


def test_a_repeated_batch_counts_once(spark, tmp_path, monkeypatch):
    """The process ends after the parts are written and before the count is committed."""
    rows = [(i, i, "a", i % 3, 1, 2) for i in range(100)]
    schema = write(spark, tmp_path / "in", "0", rows[:50])
    write(spark, tmp_path / "in", "1", rows[50:])
    start = lambda: windows.global_windows(live(spark, tmp_path / "in", schema), "seq", 30, str(tmp_path / "out"), str(tmp_path / "cp"))
    real = Versions.commit
    with monkeypatch.context() as broken:

        def fails(self, number, state):
            if number == 2:
                raise OSError("lost")
            real(self, number, state)

        broken.setattr(Versions, "commit", fails)
        with pytest.raises(Exception, match="lost"):
            start().awaitTermination(120)
    before = {tuple(r)[:3]: r["packets"] for r in windows.windows_so_far(spark, str(tmp_path / "out"), "flush").collect()}
    assert before == plain(rows[:50], 30)[0]
    start().awaitTermination(120)
    assert {tuple(r)[:3]: r["packets"] for r in windows.windows_so_far(spark, str(tmp_path / "out"), "flush").collect()} == plain(rows, 30)[0]
