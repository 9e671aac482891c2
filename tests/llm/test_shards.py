import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from netquilt.llm import shards


def check(rows, docs, n=16):
    assert len(rows) == len(docs)
    text = {i: t or "" for i, t in docs}
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        assert 0 <= r["shard"] < n
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    most = max(r["size"] for r in rows)
    share = sum(size.values()) / n
    assert all(abs(size[s] - share) <= most + 1 for s in range(n))


@pytest.mark.parametrize("ranges", [shards.LEAST_RANGES, 4])
def test_near_equal_bytes(docs_of, prose, rnd, monkeypatch, ranges):
    monkeypatch.setattr(shards, "LEAST_RANGES", ranges)
    same = prose(60)
    docs = [(i, prose(rnd.randint(0, 80))) for i in range(900)] + [(1000 + i, same) for i in range(500)] + [(5000, None), (5001, ""), (None, "é")] + [(6000, "repeated row")] * 200
    check(shards.assign(docs_of(docs)).collect(), docs)


def test_equal_to_one_plain_pass(docs_of, prose, rnd):
    docs = [(i, prose(rnd.randint(0, 40))) for i in range(400)] + [(500 + i, "same") for i in range(150)] + [(900, None), (901, ""), (None, "é")]
    frame = docs_of(docs)
    order = sorted((r[0], -(1 << 63) if r[1] is None else r[1], r[1], r[2]) for r in frame.select(F.xxhash64(F.coalesce("text", F.lit(""))), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 1).collect())
    total, at, slots, want = sum(r[3] for r in order), 0, Counter(), []
    for _, _, i, size in order:
        s = at * 16 // total
        want.append((i, size, s, slots[s]))
        slots[s] += 1
        at += size
    got = [(r["doc_id"], r["size"], r["shard"], r["slot"]) for r in shards.assign(frame).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_few_and_none(docs_of):
    docs = [(1, "a"), (2, "b")]
    check(shards.assign(docs_of(docs)).collect(), docs)
    assert shards.assign(docs_of(docs).limit(0)).count() == 0


def test_splitters_follow_weight():
    sample = [((i, 0, 0), 1.0) for i in range(100)] + [((200, 0, 0), 100.0)]
    assert shards.splitters(sample, 2) in ([(99, 0, 0)], [(200, 0, 0)])
    assert shards.splitters([], 4) == []


def test_overfull_ranges_are_cut_again(docs_of, prose, monkeypatch):
    monkeypatch.setattr(shards, "SAMPLES", 1)  # so poor a sample leaves overfull ranges
    docs = [(i, prose(10)) for i in range(2000)]
    check(shards.assign(docs_of(docs)).collect(), docs)


def test_many_rounds_and_dozens_of_huge_rows(docs_of, prose, rnd, monkeypatch):
    halved = shards.splitters
    monkeypatch.setattr(shards, "splitters", lambda sample, parts: halved(sample, min(parts, 2)))  # over four rounds until no range is overfull
    docs = [(i, prose(rnd.randint(1, 12))) for i in range(3000)] + [(10_000 + i, "w" * rnd.randint(200, 20_000)) for i in range(60)]
    check(shards.assign(docs_of(docs)).collect(), docs)


def test_written_shards(spark, docs_of, prose, tmp_path):
    docs = [(i, prose(10)) for i in range(50)] + [(7, "again"), (7, "again"), (None, "a"), (None, None)]
    frame = docs_of(docs).withColumn("shard", F.lit(99)).withColumn("a.b", F.lit(1))
    shards.write_shards(frame, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(repr, map(tuple, back.select("doc_id", "text").collect()))) == sorted(map(repr, docs))
    assert set(back.columns) == set(frame.columns)
    assert len(list((tmp_path / "s").glob("shard=*"))) == 4
