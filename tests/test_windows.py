import random

from pyspark.sql import functions as F

from netquilt.operators import timeseries, windows


def _stream(spark, n, seed=1, most=30):
    rnd = random.Random(seed)
    rows = [(i * 3 + 1, rnd.randrange(5), rnd.randrange(5), rnd.randrange(most), f"q{rnd.randrange(3)}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "seq long, src long, dst long, packets long, queue string").repartition(7)


def test_count_windows(spark):
    rows, df = _stream(spark, 1003)
    got = {r["seq"]: (r["subwindow"], r["window"]) for r in windows.count_windows(df, "seq", 100, 4).collect()}
    assert got == {r[0]: (i // 100, i // 400) for i, r in enumerate(rows)}
    assert windows.drop_tail(windows.count_windows(df, "seq", 100), 100).count() == 1000


def test_windows_of_each_queue(spark):
    rows, df = _stream(spark, 500)
    got = {r["seq"]: r["subwindow"] for r in windows.count_windows(df, "seq", 20, by=("queue",)).collect()}
    seen = {}
    for r in rows:
        assert got[r[0]] == seen.get(r[4], 0) // 20
        seen[r[4]] = seen.get(r[4], 0) + 1


def test_weighted_windows_match_one_packet_at_a_time(spark):
    rows, df = _stream(spark, 300, most=90)
    want, n = {}, 0
    for seq, _, _, packets, _ in rows:
        for _ in range(packets):
            want[seq, n // 64] = want.get((seq, n // 64), 0) + 1
            n += 1
    got = {(r["seq"], r["subwindow"]): r["packets"] for r in windows.weighted_windows(df, "seq", 64).collect()}
    assert got == want


def test_empty_stream(spark):
    _, df = _stream(spark, 3)
    assert windows.count_windows(df.limit(0), "seq", 10).count() == 0
    assert windows.weighted_windows(df.limit(0), "seq", 10).count() == 0


def test_summaries_count_missing_cells_as_zero(spark):
    rows = [("w1", 1, 1, "m", 4), ("w2", 1, 1, "m", 9), ("w3", 1, 1, "m", 9), ("w1", 1, 2, "m", 5)]
    df = spark.createDataFrame(rows, "window string, zone_src int, zone_dst int, metric string, value long")
    got = {r["zone_dst"]: (r["current"], r["median"], r["max"], r["argmax_window"]) for r in timeseries.summary(df).collect()}
    assert got == {1: (9, 9.0, 9, "w2"), 2: (0, 0.0, 5, "w1")}
    z = {(r["zone_dst"], r["window"]): r["z"] for r in timeseries.z_scores(df).collect()}
    assert z[1, "w1"] == 0  # MAD is 0
    assert [r["ratio"] for r in timeseries.window_ratio(df, "m", "w2", "w1").orderBy("zone_dst").collect()] == [2.25, 0.0]
    assert [tuple(r) for r in timeseries.zone_matrix(df.where("window = 'w1'"), "value", 2).collect()] == [(1, 4, 5)]


def test_ratio_by_zero_is_null(spark):
    df = spark.createDataFrame([(1, 0)], "a long, b long")
    assert df.select(timeseries.ratio(F.col("a"), F.col("b"))).first()[0] is None
