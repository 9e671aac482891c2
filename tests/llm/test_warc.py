import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from netquilt.llm import warc

SCHEMA = "page_id long, url string, html string, first long, n int, revisit string"


def test_round_trip(spark, prose):
    same = prose(50)
    pages = [(5, "http://a", same), (3, None, same), (9, "x\r\ny", same), (1, "u", None), (2, "u", ""), (7, "é", "漢字" * 50_000), (None, "u", same), (None, "u", "lone"), (8, "u", "twice"), (8, "u", "twice")]
    df = spark.createDataFrame([(*p, 1, 1, "z") for p in pages], SCHEMA).repartition(3)
    got = sorted(map(repr, map(tuple, warc.round_trip(df).collect())))
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = min(p[0] for p in pages if (p[2] or "") == (h or "") and p[0] is not None) if i is not None or h == same else None
        again = first is not None and i != first
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", first if again else None))
    assert got == sorted(map(repr, want))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_a_task_that_fails_leaves_no_file(spark, tmp_path, monkeypatch, prose):
    df = spark.createDataFrame([(i, "u", prose(20)) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    broken = warc.with_responses(df).withColumn("url", F.when(F.col("page_id") == 15, F.raise_error(F.lit("gone"))).otherwise(F.col("url")))
    monkeypatch.setattr(warc, "with_responses", lambda pages, least: broken)
    with pytest.raises(Exception, match="gone"):
        warc.write(df, f"file://{tmp_path}/w")
    assert not (tmp_path / "w").exists() or not list((tmp_path / "w").iterdir())
    monkeypatch.undo()
    for _ in range(2):  # a task that runs again replaces its files
        assert sum(r["records"] for r in warc.write(df, f"file://{tmp_path}/w").collect()) == 20
    assert len(list((tmp_path / "w").iterdir())) == 1


def test_small_payloads_are_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_archives_are_plain_gzip_and_roll_over(spark, tmp_path, monkeypatch, prose):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2_000)
    df = spark.createDataFrame([(i, f"http://h/{i}", prose(100)) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    made = warc.write(df, f"file://{tmp_path}/w").collect()
    assert len(made) > 5 and sum(r["records"] for r in made) == 40
    data = b"".join(open(r["path"], "rb").read() for r in sorted(made))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 40
    assert all(p.name.endswith(".warc.gz") for p in (tmp_path / "w").iterdir())


def test_reader_takes_any_chunks_and_sees_damage():
    members = [warc.encode_record(i, "u", f"payload {i}".encode() * 50, None, False) for i in range(5)]
    data = b"".join(members)
    for step in (1, 7, 1000, len(data)):
        found = list(warc.read_records(iter([data[i : i + step] for i in range(0, len(data), step)])))
        assert [r.payload for r in found] == [f"payload {i}".encode() * 50 for i in range(5)]
    for left in range(1, len(members[-1])):  # cut at each byte of the last member
        for step in (3, len(data)):
            cut = data[: len(data) - left]
            with pytest.raises(ValueError, match="cut off"):
                list(warc.read_records(iter([cut[i : i + step] for i in range(0, len(cut), step)])))
    big = warc.encode_record(1, "u", bytes(30 << 20), None, False)
    assert len(next(warc.read_records(iter([big]))).payload) == 30 << 20
    raw = gzip.decompress(members[0])
    for bad in (raw.replace(b"payload 0p", b"payload 1p", 1), raw.replace(b"Content-Length: 5", b"Content-Length: 6"), raw[:-1], b"HTTP" + raw):
        with pytest.raises((ValueError, KeyError)):
            list(warc.read_records(iter([gzip.compress(bad)])))
