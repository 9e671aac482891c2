import pytest
from pyspark.sql import functions as F

from netquilt.functions import ip, naming
from netquilt.operators import anonymize


def test_addresses(spark):
    rows = [("0.0.0.0", 0), ("10.0.0.1", 167772161), ("192.168.1.1", 3232235777), ("255.255.255.255", 4294967295), ("1.2.3", None), ("01.2.3.4", None), ("1.2.3.256", None), (None, None), ("1.2.3.4 ", None)]
    df = spark.createDataFrame(rows, "t string, want long")
    got = df.select("want", ip.ip_to_int(F.col("t")).alias("big"), ip.ip_to_int(F.col("t"), "LE").alias("little"), ip.int_to_ip(F.col("want")).alias("back"), "t").collect()
    for r in got:
        assert r["big"] == r["want"]
        if r["want"] is not None:
            assert r["back"] == r["t"]
            assert r["little"] == int.from_bytes(r["want"].to_bytes(4, "big"), "little")
    with pytest.raises(Exception, match="IPv4"):
        df.where("t = '1.2.3'").select(ip.ip_to_int(F.col("t"), strict=True)).collect()


def test_bounds(spark):
    rows = [("10.0.0.0/8", 167772160, 184549375), ("1.2.3.4/32", 16909060, 16909060), ("9.9.9.9/0", 0, 4294967295), ("0.0.0.5:0.0.0.9", 5, 9), ("0.0.0.9:0.0.0.5", None, None), ("1.2.3.4/33", None, None), ("x", None, None)]
    df = spark.createDataFrame(rows, "line string, a long, b long")
    lo, hi = ip.bounds(F.col("line"))
    assert all((r[0], r[1]) == (r[2], r[3]) for r in df.select(lo, hi, "a", "b").collect())


def test_names(spark):
    df = spark.createDataFrame([("sub_max_fan_in_2_11",), ("sub-n_links-1_3",), ("n_links",)], "n string")
    metric, i, j = naming.parse_zone_column(F.col("n"))
    assert [tuple(r) for r in df.select(metric, i, j).collect()] == [("max_fan_in", 2, 11), ("n_links", 1, 3), ("n_links", None, None)]
    z = spark.createDataFrame([(3.5,), (-2.0,), (0.1,)], "z double")
    assert [r[0] for r in z.select(naming.severity(F.col("z"))).collect()] == ["alert", "warning", "normal"]
    t = spark.createDataFrame([(10, 20, 1, 4), (20, 10, 1, 4), (0, 10, 5, 4)], "a long, b long, o long, t long")
    assert [r[0] for r in t.select(naming.time_at(*map(F.col, "abot"))).collect()] == [12, 0, 0]


def test_padding_and_swaps(spark):
    df = spark.createDataFrame([("1.22.3.4",)], "t string").withColumn("p", ip.pad_ip(F.col("t")))
    row = df.select("p", ip.unpad_ip(F.col("p")).alias("u"), ip.byteswap32(F.lit(0x01020304)).alias("s"), ip.xor_mask(F.lit(5)).alias("x")).first()
    assert tuple(row) == ("001.022.003.004", "1.22.3.4", 0x04030201, 5 ^ 0xAAAAAAAA)


def test_anonymizer_keeps_prefixes_and_is_one_to_one(spark):
    ids = spark.range(3232235520, 3232235520 + 3000).select(F.col("id").alias("ip"))
    got = {r["ip"]: r["a"] for r in ids.withColumn("a", anonymize.scramble(F.col("ip"), "k")).collect()}
    assert len(set(got.values())) == 3000
    common = lambda a, b: 32 - (a ^ b).bit_length()
    known = sorted(got)[::37]
    assert all(common(a, b) == common(got[a], got[b]) for a in known for b in known)
    assert all(a >> 16 == b >> 16 for a, b in got.items())


def test_lenient_addresses(spark):
    import socket

    from pyspark.sql import functions as F

    from netquilt.functions import ip

    texts = ["1", "1.2", "1.2.3", "1.2.3.4", "0x7f.1", "017.0.0.1", "0xffffffff", "4294967295", "256.1", "1.2.65536", "1.2.65535", "08.1.1.1", "a.b", "", "1.2.3.4.5", "0", "00.0.0.0"]
    got = {r[0]: r[1] for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", ip.lenient_ip_to_int(F.col("t"))).collect()}
    for t in texts:
        try:
            want = int.from_bytes(socket.inet_aton(t), "big")
        except OSError:
            want = None
        assert got[t] == want, t
