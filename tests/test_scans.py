import random

import pytest
from pyspark.sql import functions as F

from netquilt.operators import anonymize, filters, scans, windows, zones


@pytest.fixture
def rows(spark):
    rnd = random.Random(4)
    made = [(at, rnd.choice(["a", "b", None]), rnd.randrange(50), rnd.choice([None, rnd.randrange(9)])) for at in rnd.sample(range(-(1 << 40), 1 << 40), 400) + rnd.sample(range(1000), 200)]
    return made, spark.createDataFrame(made, "at long, g string, v long, w long").repartition(5)


def plain(rows, kind, column, by, before):
    out, seen = {}, {}
    for r in sorted(rows, key=lambda r: r[0]):
        g, v = (r[1] if by else 0), r[column]
        had = seen.get(g)
        now = v if had is None else had if v is None else {"sum": had + v, "max": max(had, v), "last": v}[kind]
        seen[g], out[r[0]] = now, had if before else now
    return out


@pytest.mark.parametrize("before", [False, True])
@pytest.mark.parametrize("by", [(), ("g",)])
@pytest.mark.parametrize("sizes", [(17, 20), (6, 8)])
def test_running_values(rows, monkeypatch, sizes, by, before):
    """One bin or many, of several levels, give what one pass over the whole order gives."""
    monkeypatch.setattr(scans, "BITS", sizes[0])
    monkeypatch.setattr(scans, "TOP", sizes[1])
    made, df = rows
    runs = {k: scans.Run(k, F.col(c)) for k, c in (("sum", "v"), ("max", "v"), ("last", "w"))}
    got = {r["at"]: r for r in scans.running(df, "at", runs, by, before).collect()}
    assert len(got) == len(made)
    for kind, column in (("sum", 2), ("max", 2), ("last", 3)):
        assert {at: r[kind] for at, r in got.items()} == plain(made, kind, column, by, before)


@pytest.mark.parametrize("n", [1_000, 20_000])
def test_no_task_takes_more_than_a_bin(spark, monkeypatch, n):
    """The rows of a window are bounded at any size, and the input is read twice."""
    monkeypatch.setattr(scans, "BITS", 7)
    monkeypatch.setattr(scans, "TOP", 9)
    df = spark.range(n).select(F.col("id").alias("at"), F.lit(1).cast("long").alias("v"))
    marked = df.withColumn("bin", F.shiftright("at", 7))
    assert marked.groupBy("bin").count().agg(F.max("count")).first()[0] <= 128
    out = scans.running(df, "at", {"n": scans.Run("sum", F.col("v"))}, bits=30)
    assert all(r["n"] == r["at"] + 1 for r in out.collect())
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Range (") == 2 and plan.count("ReusedExchange") >= 1
    # all windows but the topmost have a bin as their group
    assert [line.count("__") > 0 for line in plan.splitlines() if " Window [" in line].count(False) <= 1


def test_drops_of_one_ring_at_any_number_of_bins(spark, monkeypatch):
    rnd = random.Random(8)
    rows, count, at = [], 0, 1_700_000_000_000_000
    for _ in range(500):
        at += rnd.randrange(1, 2_000_000)
        count = rnd.randrange(5) if rnd.random() < 0.1 else count + rnd.randrange(4)
        rows.append(("one", at, count))
    want, last = {}, None
    for _, t, c in rows:
        rise = 0 if last is None else c if c < last else c - last
        want[t // 1_000_000] = want.get(t // 1_000_000, 0) + rise
        last = c
    df = spark.createDataFrame(rows, "ring string, us long, dropped long").select("ring", F.timestamp_micros("us").alias("ts"), "dropped").repartition(6)
    for bits, top in ((17, 20), (40, 41), (22, 24)):
        monkeypatch.setattr(scans, "BITS", bits)
        monkeypatch.setattr(scans, "TOP", top)
        got = {int(r["second"].timestamp()): r["dropped"] for r in filters.drops(df).collect()}
        assert got == want


def test_windows_over_many_bins(spark, monkeypatch):
    monkeypatch.setattr(scans, "BITS", 4)
    monkeypatch.setattr(scans, "TOP", 6)
    df = spark.range(500).select((F.col("id") * 3).alias("seq"))
    got = {r["seq"]: r["subwindow"] for r in windows.count_windows(df, "seq", 32).collect()}
    assert got == {3 * i: i // 32 for i in range(500)}


@pytest.mark.parametrize(("lo", "hi"), [(0, 0), (0, (1 << 32) - 1), (1, (1 << 32) - 2), (5, 5), (6, 9), (1 << 24, (1 << 25) - 1), (4_000_000_000, 4_294_967_295), (255, 256)])
def test_prefixes_cover_an_interval_once(spark, lo, hi):
    found = [(r["base"], r["bits"]) for r in anonymize.prefixes(spark.createDataFrame([(1, lo, hi)], "zone int, lo long, hi long")).collect()]
    assert len(found) <= 62 and all(base % (1 << bits) == 0 for base, bits in found)
    at = lo
    for base, bits in sorted(found):
        assert base == at
        at += 1 << bits
    assert at == hi + 1


@pytest.mark.parametrize("keep", [0, 16, 24])
def test_mapped_zones_hold_the_mapped_addresses(spark, keep):
    lists = [(1, 1000, 1700), (1, 1650, 1800), (2, 5000, 5000), (2, 5003, 5300), (3, 70_000, 70_004)]
    got = anonymize.zone_table(spark.createDataFrame(lists, "zone int, lo long, hi long"), "k", keep).collect()
    ids = spark.createDataFrame([(z, i) for z, lo, hi in lists for i in range(lo, hi + 1)], "zone int, ip long").distinct()
    want = {(r["zone"], r["a"]) for r in ids.select("zone", anonymize.scramble(F.col("ip"), "k", keep).alias("a")).collect()}
    assert {(r["zone"], i) for r in got for i in range(r["lo"], r["hi"] + 1)} == want
    spans = sorted((r["zone"], r["lo"], r["hi"]) for r in got)
    assert all(a[0] != b[0] or b[1] > a[2] + 1 for a, b in zip(spans, spans[1:], strict=False))


def test_many_intervals(spark, monkeypatch):
    """Addresses take their zone from a scan over both; zones that share one are found."""
    monkeypatch.setattr(scans, "BITS", 9)
    many = spark.range(3000).select((F.col("id") % 7 + 1).cast("int").alias("zone"), (F.col("id") * 50).alias("lo"), (F.col("id") * 50 + 20).alias("hi"))
    links = spark.range(2000).select((F.col("id") * 73).alias("src"), (F.col("id") * 31 + 7).alias("dst"), F.lit(1).cast("long").alias("packets"))
    zone = lambda ip: ip // 50 % 7 + 1 if ip % 50 <= 20 and ip < 150_000 else 8
    got = zones.label(links, many).collect()
    assert len(got) == 2000 and all((r["zone_src"], r["zone_dst"]) == (zone(r["src"]), zone(r["dst"])) for r in got)
    assert zones.inside(links, many, "src").count() == sum(zone(73 * i) < 8 for i in range(2000)) == 2000 - zones.outside(links, many, "src").count()
    for extra in ((9, 60, 60), (9, 50, 50), (9, 0, 10**6)):
        with pytest.raises(ValueError, match="overlap"):
            zones.check(many.unionByName(spark.createDataFrame([extra], "zone int, lo long, hi long")))
