import io
import tarfile

import pytest
from pyspark.sql import functions as F

from netquilt.operators import matrix
from netquilt.plans import traffic
from netquilt.sources import readers, sinks, stats_table, versions

LONG = stats_table.LONG


def cells(df):
    return {tuple(r)[:4]: r["value"] for r in df.collect()}


def test_cells_are_added_and_replaced(spark, tmp_path):
    where = str(tmp_path / "t")
    assert stats_table.stored_stats(spark, where).count() == 0
    first = {("w1", None, None, "n_links"): 3.0, ("w1", 1, 2, "max_fan_in"): 4.0}
    make = lambda d: spark.createDataFrame([(*k, v) for k, v in d.items()], LONG)
    assert stats_table.upsert_stats(make(first), where) == 1
    second = {("w1", None, None, "n_links"): 1.0, ("w2", 2, 2, "n_links"): 7.0}
    assert stats_table.upsert_stats(make(second), where) == 2
    assert cells(stats_table.stored_stats(spark, where)) == first | second
    twice = spark.createDataFrame([("w1", 1, 2, "max_fan_in", 9.0, 1), ("w1", 1, 2, "max_fan_in", 2.0, 2)], LONG + ", at int")
    stats_table.upsert_stats(twice, where, order="at")
    assert cells(stats_table.stored_stats(spark, where))["w1", 1, 2, "max_fan_in"] == 2.0


def test_many_writes_become_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stats_table, "PARTS", 3)
    where = str(tmp_path / "t")
    for k in range(7):
        stats_table.upsert_stats(spark.createDataFrame([("w", 1, k % 3, "m", float(k))], LONG), where)
        assert len(versions.Versions(spark, where).latest()[1]["parts"]) < 3
    assert cells(stats_table.stored_stats(spark, where)) == {("w", 1, 0, "m"): 6.0, ("w", 1, 1, "m"): 4.0, ("w", 1, 2, "m"): 5.0}


def test_a_write_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    where = str(tmp_path / "t")
    stats_table.upsert_stats(spark.createDataFrame([("w", 1, 1, "m", 1.0)], LONG), where)
    bad = spark.createDataFrame([("w", 1, 1, "m", 2.0)], LONG).withColumn("value", F.raise_error(F.lit("cut off")).cast("double"))
    with pytest.raises(Exception, match="cut off"):
        stats_table.upsert_stats(bad, where)
    assert cells(stats_table.stored_stats(spark, where)) == {("w", 1, 1, "m"): 1.0}


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = versions.Versions(spark, str(tmp_path / "v")), versions.Versions(spark, str(tmp_path / "v"))
    a.commit(1, {"x": ["a"]})
    with pytest.raises(RuntimeError, match="another writer"):
        b.commit(1, {"x": ["b"]})
    assert b.latest() == (1, {"x": ["a"]})
    assert not [p for p in (tmp_path / "v" / "commits").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_tables_of_a_hundred_zones(spark, tmp_path):
    """More columns than Spark's pivot takes."""
    pairs = spark.range(10_000).select(F.lit("w").alias("window"), F.expr("cast(id div 100 + 1 as int)").alias("zone_src"), (F.col("id") % 100 + 1).cast("int").alias("zone_dst"), F.lit("n_links").alias("metric"), F.col("id").cast("double").alias("value"))
    both = pairs.unionAll(pairs.withColumn("metric", F.lit("n_packets"))).unionAll(pairs.where("zone_src = 1").withColumn("window", F.lit("a\tb \"c\"")))
    sinks.write_stats(both, str(tmp_path / "s"))
    assert cells(readers.read_stats(spark, str(tmp_path / "s"))) == cells(both)
    stats_table.upsert_stats(both, str(tmp_path / "t"))
    assert cells(stats_table.stored_stats(spark, str(tmp_path / "t"))) == cells(both)


def test_another_process_goes_on(spark, tmp_path, twelve, monkeypatch):
    monkeypatch.setattr(traffic, "PARTS", 3)
    where, paths = str(tmp_path / "m"), [str(tmp_path / f"w{i}") for i in range(5)]
    for i, p in enumerate(paths):
        twelve.coalesce(1).write.parquet(p)
        traffic.TrafficMatrix(spark, folder=where).update(*paths[: i + 1])
        m = traffic.TrafficMatrix(spark, folder=where)
        assert m.value("n_packets") == 21 * (i + 1) and m.processed().count() == i + 1
        assert len(m.parts) < 3
    m.update(*paths)
    assert m.value("n_packets") == 105
    m.clear()
    assert traffic.TrafficMatrix(spark, folder=where).value("n_packets") == 0
    m.update(paths[0])
    assert traffic.TrafficMatrix(spark, folder=where).value("n_packets") == 21


def test_a_crash_between_sum_and_commit(spark, tmp_path, twelve, monkeypatch):
    where, path = str(tmp_path / "m"), str(tmp_path / "w")
    twelve.coalesce(1).write.parquet(path)
    m = traffic.TrafficMatrix(spark, folder=where)
    with monkeypatch.context() as broken:
        broken.setattr(versions.Versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            m.update(path)
    for again in (m, traffic.TrafficMatrix(spark, folder=where)):
        assert again.value("n_packets") == 0 and again.processed().count() == 0
    m.update(path)
    assert traffic.TrafficMatrix(spark, folder=where).value("n_packets") == 21
    with pytest.raises(RuntimeError, match="another writer"):  # one that began before that commit
        again.update(path)


@pytest.mark.parametrize("folder", [None, "m"])
def test_unknown_files_and_bad_members(spark, tmp_path, twelve, folder):
    twelve.coalesce(1).write.parquet(str(tmp_path / "in"))
    (tmp_path / "in" / "window1").write_bytes(b"x")
    m = traffic.TrafficMatrix(spark, folder=folder and str(tmp_path / folder))
    with pytest.raises(ValueError, match="no reader for .*window1"):
        m.update(str(tmp_path / "in"))
    assert m.value("n_links") == 0 and m.processed().count() == 0
    m.update(str(tmp_path / "in"), skip_unknown=True)
    assert m.value("n_packets") == 21 and [p.rsplit("/", 1)[1] for p in m.skipped] == ["window1"]
    blob = bytes(sinks.dump_coo(twelve.coalesce(1)).first()[0])
    with tarfile.open(tmp_path / "bad.tar", "w") as tar:
        for name, data in (("a.coo", blob), ("b.coo", b"123"), ("c.coo", blob)):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    with pytest.raises(Exception, match="bad.tar: a member can't be read"):
        m.update(str(tmp_path / "bad.tar"))
    assert m.value("n_packets") == 21 and not m.processed().where("path like '%bad.tar'").count()
    assert readers.read_tar(spark, str(tmp_path / "bad.tar")).count() == 12  # what came before it


def test_readers_of_the_user(spark, tmp_path, twelve):
    twelve.coalesce(1).write.option("sep", ";").csv(str(tmp_path / "in"))
    own = {".csv": lambda spark, files: spark.read.schema("src long, dst long, packets long").option("sep", ";").csv(files)}
    m = traffic.TrafficMatrix(spark, readers=traffic.READERS | own)
    m.update(str(tmp_path / "in"))
    assert matrix.equal(m.edges, twelve).first()["equal"]
