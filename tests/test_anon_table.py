import numpy as np
import pytest
from pyspark.sql import functions as F

from netquilt.operators import anonymize
from netquilt.sources import anon_table


@pytest.mark.parametrize("block", [64, 1000, 1 << 20])
def test_written_and_looked_up(spark, tmp_path, block):
    """A range of addresses, in blocks that end anywhere, gives what the function gives."""
    assert anon_table.write_table(spark, str(tmp_path / "t"), "k", 300, 5_299, keep=4, block=block) == -(-5_000 // block)
    asked = [0, 299, 300, 301, 363, 364, 1_299, 1_300, 4_000, 4_000, 5_298, 5_299, 5_300, 10**9]
    ids = spark.createDataFrame([(i,) for i in asked], "ip long")
    got = {r["ip"]: r["anon_ip"] for r in anon_table.look_up(ids, str(tmp_path / "t"), 300, block).collect()}
    inside = [i for i in asked if 300 <= i < 5_300]
    want = {r["ip"]: r["a"] for r in spark.createDataFrame([(i,) for i in inside], "ip long").select("ip", anonymize.scramble(F.col("ip"), "k", 4).alias("a")).collect()}
    assert got == want
    sizes = sorted(p.stat().st_size for p in (tmp_path / "t").iterdir() if p.name.endswith(".bin"))
    assert sum(sizes) == 4 * 5_000


def test_one_file(spark, tmp_path):
    np.arange(500, dtype="<u4")[::-1].tofile(tmp_path / "table")
    ids = spark.createDataFrame([(0,), (7,), (499,), (500,), (10**6,)], "ip long")
    got = {r["ip"]: r["anon_ip"] for r in anon_table.look_up(ids, str(tmp_path / "table"), block=100).collect()}
    assert got == {0: 499, 7: 492, 499: 0}
