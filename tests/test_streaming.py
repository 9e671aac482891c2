import random

from netquilt.operators import matrix, windows
from netquilt.streaming import windows as streams

SCHEMA = "seq long, ts timestamp, shard string, src long, dst long, packets long"


def _files(spark, folder, n=400, parts=4):
    rnd = random.Random(2)
    rows = [(i, None, f"s{rnd.randrange(2)}", rnd.randrange(4), rnd.randrange(4), rnd.randrange(6)) for i in range(n)]
    for k in range(parts):
        spark.createDataFrame(rows[k * n // parts : (k + 1) * n // parts], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return rows


def test_streamed_windows_are_the_batch_windows(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = _files(spark, folder)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = streams.append_windows(streams.count_windows(source, "shard", "seq", 50), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("shard", "subwindow", "src", "dst", "packets").collect()))
    want = []
    for shard in ("s0", "s1"):
        batch = spark.createDataFrame([r for r in rows if r[2] == shard], SCHEMA)
        cut = matrix.build(windows.weighted_windows(batch, "seq", 50), ("subwindow",))
        total = sum(r[5] for r in rows if r[2] == shard)
        want += [(shard, *r) for r in cut.collect() if r["subwindow"] < total // 50]
    assert got == sorted(want)
    left = sorted(map(tuple, streams.unfinished(spark.createDataFrame(rows, SCHEMA), "shard", "seq", 50).collect()))
    tail = []
    for shard in ("s0", "s1"):
        total = sum(r[5] for r in rows if r[2] == shard)
        cut = matrix.build(windows.weighted_windows(spark.createDataFrame([r for r in rows if r[2] == shard], SCHEMA), "seq", 50), ("subwindow",))
        tail += [(shard, *r) for r in cut.collect() if r["subwindow"] >= total // 50]
    assert left == sorted(tail)


def test_a_packet_over_many_windows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "AT_ONCE", 7)
    folder = str(tmp_path / "in")
    spark.createDataFrame([(1, None, "s", 1, 2, 1003), (2, None, "s", 3, 4, 17)], SCHEMA).coalesce(1).write.parquet(folder)
    source = spark.readStream.schema(SCHEMA).parquet(folder)
    streams.append_windows(streams.count_windows(source, "shard", "seq", 10), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("subwindow").agg({"packets": "sum"}).collect()
    assert sorted(map(tuple, got)) == [(i, 10) for i in range(102)]


def test_windows_by_time(spark):
    from datetime import datetime

    rows = [(datetime(2024, 1, 1, 0, 0, s), 1, 2) for s in (0, 3, 4, 20, 21)]
    df = spark.createDataFrame(rows, "ts timestamp, src long, dst long")
    assert sorted(r["packets"] for r in streams.time_windows(df, "10 seconds", "1 minute").collect()) == [2, 3]
    assert sorted(r["packets"] for r in streams.sessions(df, "5 seconds", "1 minute").collect()) == [2, 3]
    assert sum(r["packets"] for r in streams.sliding_windows(df, "10 seconds", "5 seconds", "1 minute").collect()) == 10


def test_running_matrix(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = _files(spark, folder)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    query = streams.running_matrix(source).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("running").selectExpr("sum(packets)").first()[0] == sum(r[5] for r in rows)


def test_flows_are_accumulated_once(spark, tmp_path):
    import json

    from netquilt.operators import filters
    from netquilt.streaming import sources

    folder, out, cp = (str(tmp_path / x) for x in ("flows", "matrix", "cp"))
    (tmp_path / "flows").mkdir()
    line = json.dumps({"src_ip": "0.0.0.1", "dest_ip": "0.0.0.2", "flow": {"pkts_toserver": 3, "pkts_toclient": 1}})
    for k in range(3):
        (tmp_path / "flows" / f"{k}.json").write_text((line + "\n") * (k + 1) + "{bad\n")
        query = sources.accumulate(filters.flows_to_links(sources.flows_from_files(spark, folder, 1)), out, cp)
        query.awaitTermination(120)
    assert {tuple(r) for r in sources.accumulated(spark, out).collect()} == {(1, 2, 18), (2, 1, 6)}


def test_captures_as_stream_and_as_data_source(spark, tmp_path, twelve):
    from netquilt.sources import datasource, sinks
    from netquilt.streaming import sources

    (tmp_path / "in").mkdir()
    for k in range(2):
        sinks.write_pcap(sinks.expand_packets(twelve, 0, 1_000_000), str(tmp_path / "in"), prefix=str(k))
    query = sources.accumulate(sources.valid_links(sources.packets_from_captures(spark, str(tmp_path / "in"), 1)), str(tmp_path / "m"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    twice = matrix.add(twelve, twelve)
    assert matrix.equal(sources.accumulated(spark, str(tmp_path / "m")), twice).first()["equal"]
    datasource.register(spark)
    packets = spark.read.format(datasource.NAME).load(str(tmp_path / "in"))
    assert matrix.equal(matrix.from_packets(packets.select("src", "dst")), twice).first()["equal"]
