import io
import json
import struct
import tarfile

import pytest
from pyspark.sql import functions as F

from netquilt.operators import filters, matrix
from netquilt.plans import traffic
from netquilt.sources import readers, sinks


def _frame(src, dst, kind=0x0800, vlan=False, version=4):
    head = b"\0" * 12 + (b"\x81\x00\0\1" if vlan else b"") + kind.to_bytes(2, "big")
    return head + bytes([version << 4 | 5]) + b"\0" * 11 + struct.pack(">II", src, dst)


def test_capture(spark, tmp_path):
    frames = [_frame(1, 2), _frame(3, 4, vlan=True), _frame(5, 6, kind=0x86DD), _frame(7, 8, version=6), b"\0" * 5]
    body = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    for i, f in enumerate(frames):
        body += struct.pack("<IIII", 10 + i, 7, len(f), len(f)) + f
    (tmp_path / "a.pcap").write_bytes(body + b"\0" * 9)
    rows = readers.read_pcap(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["src"], r["dst"], r["vlan"]) for r in rows] == [(1, 2, False), (3, 4, True), (None, None, False), (None, None, False), (None, None, False)]
    assert rows[0]["ts"].timestamp() == pytest.approx(10.000007)
    packets = readers.read_pcap(spark, str(tmp_path))
    assert filters.ipv4_only(packets).count() == 2
    assert tuple(filters.counters(packets).first()) == (5, 3)


def test_capture_round_trip(spark, tmp_path, twelve):
    packets = sinks.expand_packets(twelve, 1_000_000, 3_000_000)
    assert packets.count() == 21
    path = str(tmp_path / "out")
    assert sinks.write_pcap(packets, path, 3, ip_id=5, sport=1, dport=80, window=64, seq=9) == 3
    back = readers.read_pcap(spark, path)
    assert matrix.equal(matrix.from_packets(back.select("src", "dst")), twelve).first()["equal"]
    assert back.agg(F.min("ts").cast("long"), F.max("ts").cast("long")).first()[0] == 1


def test_checksums():
    data = sinks.syn_packet(0x0A000001, 0x0A000002, 1, 2, 3, 4, 5)
    assert len(data) == 40
    assert sinks.checksum(data[:20]) == 0
    assert sinks.checksum(data[12:20] + b"\0\6\0\x14" + data[20:]) == 0


def test_flows(spark, tmp_path):
    good = {"src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "flow": {"pkts_toserver": 3, "pkts_toclient": 2}}
    lines = [json.dumps(good), json.dumps(good | {"flow": {"pkts_toserver": 4, "pkts_toclient": 0}}), json.dumps({k: good[k] for k in ("src_ip", "dest_ip")}), json.dumps(good | {"src_ip": "300.1.1.1"}), '{"src_ip": "10.0', json.dumps(good | {"flow": {"pkts_toserver": 1}})]
    (tmp_path / "eve.json").write_text("\n".join(lines))
    links = matrix.build(filters.flows_to_links(readers.read_flows(spark, str(tmp_path))))
    assert {tuple(r) for r in links.collect()} == {(167772161, 167772162, 8), (167772162, 167772161, 2)}


def test_tsv(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("a\tb\tsrc\tdst\tn\n1\t1\t0.0.0.1\t0.0.0.2\t7\n1\t1\t0.0.0.1\t0.0.0.2\t5\n")
    assert matrix.build(readers.read_tsv_links(spark, str(tmp_path))).first()["packets"] == 2
    assert matrix.build(readers.read_tsv_links(spark, str(tmp_path), with_value=True)).first()["packets"] == 12
    (tmp_path / "f.tsv").write_text("a\tb\tsrc\tdst\tn\n1\t1\t0.0.0.1\t0.0.0.999\t7\n")
    with pytest.raises(Exception, match="IPv4"):
        readers.read_tsv_links(spark, str(tmp_path)).collect()


def test_binary_dumps_and_archives(spark, tmp_path, twelve):
    blobs = sinks.dump_coo(twelve).collect()
    assert matrix.equal(readers.links_of_coo(spark.createDataFrame(blobs, "content binary")), twelve).first()["equal"]
    with tarfile.open(tmp_path / "w.tar", "w") as tar:
        for i, (blob,) in enumerate([*blobs, (b"123",), (b"",)]):
            for name in (f"{i}.coo", f"{i}.txt"):
                info = tarfile.TarInfo(name)
                info.size = len(blob)
                tar.addfile(info, io.BytesIO(bytes(blob)))
    found = readers.read_tar(spark, str(tmp_path / "w.tar"))
    assert matrix.equal(matrix.build(found), twelve).first()["equal"]
    assert readers.read_tar(spark, str(tmp_path / "w.tar"), ignored=tuple(f"{i}.coo" for i in range(len(blobs)))).count() == 0


def test_address_lists(spark, tmp_path):
    (tmp_path / "a.txt").write_text("10.0.0.0/8\n10.0.0.0/8\n\n172.16.0.0/12\n192.168.0.0/16\n")
    (tmp_path / "b.txt").write_text("0.0.0.1:0.0.0.3\nnonsense\n")
    got = readers.read_address_lists(spark, [str(tmp_path / "a.txt")])
    assert got.select(F.sum(F.col("hi") - F.col("lo") + 1)).first()[0] == 17891328
    with pytest.raises(Exception, match="address range"):
        readers.read_address_lists(spark, [str(tmp_path / "b.txt")]).collect()
    assert [tuple(r) for r in readers.read_address_lists(spark, [str(tmp_path / "b.txt")], strict=False).collect()] == [(1, 1, 3)]


def test_statistics_round_trip(spark, tmp_path):
    rows = [("w1", None, None, "n_links", 3.0), ("w1", 1, 2, "max_fan_in", 4.0), ("w2", 1, 2, "max_fan_in", 5.0)]
    df = spark.createDataFrame(rows, "window string, zone_src int, zone_dst int, metric string, value double")
    for delimiter in "_-":
        sinks.write_stats(df, str(tmp_path / "s"), delimiter)
        assert sorted(map(str, map(tuple, readers.read_stats(spark, str(tmp_path / "s")).collect()))) == sorted(map(str, rows))


def test_modules(spark, tmp_path):
    text = '{"name": "m", "size": "2x2", "axis_labels": ["A", "B",], "traffic_matrix": [[0, 2,], [1, 0],], "traffic_matrix_colors": [[0, 1], [2, 0],],}'
    (tmp_path / "m.json").write_text(text)
    got = {(r["src"], r["dst"], r["packets"], r["color"]) for r in readers.read_modules(spark, str(tmp_path)).collect()}
    assert got == {("A", "B", 2, 1), ("B", "A", 1, 2)}
    assert readers.loads_lenient(text)["axis_labels"] == ["A", "B"]


def test_export_settings(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("# note\n w\nm.tar\t1\t2\t3\t4\t5\t6\t7\n")
    assert [tuple(r) for r in readers.read_export_config(spark, str(tmp_path)).collect()] == [("m.tar", 1, 2, 3, 4, 5, 6, 7)]


def test_text_dump_and_description(twelve):
    lines = [r[0] for r in sinks.dump_text(twelve).collect()]
    assert lines[0] == "0.0.0.0 0.0.0.1 1" and len(lines) == 12
    assert tuple(sinks.describe(twelve).first()) == (12, 4, 4, 21)


def test_counts_beyond_the_format_are_refused(spark, twelve):
    with pytest.raises(Exception, match="32 bits"):
        sinks.dump_coo(spark.createDataFrame([(1, 2, 1 << 32)], "src long, dst long, packets long")).collect()


def test_the_last_value_written_counts(spark, tmp_path):
    rows = [("w", 1, 2, "n_links", 9.0, 1), ("w", 1, 2, "n_links", 4.0, 2)]
    sinks.write_stats(spark.createDataFrame(rows, "window string, zone_src int, zone_dst int, metric string, value double, at int"), str(tmp_path / "s"), order="at")
    assert readers.read_stats(spark, str(tmp_path / "s")).first()["value"] == 4.0


def test_commas_inside_strings_stay(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"name": "a, ]b", "axis_labels": ["A,]", "B",], "traffic_matrix": [[0, 2,], [1, 0]],}')
    assert {(r["name"], r["src"], r["dst"]) for r in readers.read_modules(spark, str(tmp_path)).collect()} == {("a, ]b", "A,]", "B"), ("a, ]b", "B", "A,]")}


def test_key_files(spark, tmp_path):
    from netquilt.operators import anonymize

    key = anonymize.stored_key(spark, str(tmp_path / "key"))
    assert len(key) == 64 and anonymize.stored_key(spark, str(tmp_path / "key")) == key
    full = anonymize.full_table(spark, "k", 10, 300).collect()
    assert len(full) == 291 and len({r[1] for r in full}) == 291


def test_folders_archives_and_spellings(spark, tmp_path, twelve):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    twelve.coalesce(1).write.parquet(str(tmp_path / "in" / "w1"))
    blobs = sinks.dump_coo(twelve.coalesce(1)).withColumn("member", F.lit("x.coo"))
    sinks.write_tar(blobs, str(tmp_path / "in" / "deep"))
    m = traffic.TrafficMatrix(spark)
    m.update(str(tmp_path / "in" / "w1"))
    m.update(str(tmp_path / "in" / "w1") + "/", f"file://{tmp_path}/in/./w1")
    assert m.value("n_packets") == 21
    m.update(str(tmp_path / "in"), recursive=True)
    assert m.value("n_packets") == 42 and m.value("n_links") == 12


def test_files_and_matrix(spark, tmp_path, twelve):
    paths = [str(tmp_path / f"w{i}") for i in range(3)]
    for p in paths:
        twelve.write.parquet(p)
    m = traffic.TrafficMatrix(spark, spark.createDataFrame([(1, 0, 2)], "zone int, lo long, hi long"))
    m.update(*paths[:2])
    m.update(*paths)
    assert m.value("n_packets") == 63
    rows = {(r["zone_src"], r["zone_dst"], r["metric"]): r["value"] for r in m.analyze(count_multiplicities=True).collect()}
    assert rows[None, None, "max_packets"] == 12 and rows[None, None, "max_packets_links"] == 2
    assert sum(v for k, v in rows.items() if k[0] and k[2] == "n_packets") == 63
    m.clear()
    assert m.value("n_links") == 0
    table = traffic.process_files(spark, "w", paths)
    assert {r["metric"] for r in table.collect()} >= {"n_links", "update_time", "analyze_rate"}
    (tmp_path / "list.txt").write_text("\n".join([*paths, paths[0], ""]))
    assert readers.file_list(spark, str(tmp_path / "list.txt")) == paths
