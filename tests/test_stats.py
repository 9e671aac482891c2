import random

import pytest

from netquilt.operators import drill, matrix, scans, stats, timeseries, zones


def test_nine_quantities(twelve):
    got = stats.quantities(twelve).first().asDict()
    assert got == {"n_packets": 21, "n_links": 12, "n_sources": 4, "n_destinations": 4, "max_packets": 4, "max_source_packets": 7, "max_destination_packets": 6, "max_fan_out": 4, "max_fan_in": 4}


def test_multiplicities(twelve):
    got = stats.multiplicities(twelve).first().asDict()
    assert got == {"max_packets_links": 2, "max_source_packets_sources": 2, "max_destination_packets_destinations": 2, "max_fan_out_sources": 1, "max_fan_in_destinations": 2}


def test_empty_matrix_is_all_zero(twelve):
    none = twelve.limit(0)
    assert set(stats.quantities(none).first()) == {0}
    assert set(stats.multiplicities(none).first()) == {0}


@pytest.fixture
def two_zones(spark):
    return spark.createDataFrame([(1, 0, 0), (1, 2, 2), (2, 1, 1), (2, 4, 5)], "zone int, lo long, hi long")


def _pairs(frame, names):
    return {(r["zone_src"], r["zone_dst"]): tuple(r[n] for n in names) for r in frame.collect()}


NAMES = ("n_links", "n_packets", "n_sources", "n_destinations", "max_packets", "max_source_packets", "max_destination_packets", "max_fan_out", "max_fan_in")


def test_zone_pairs(twelve, two_zones):
    got = _pairs(zones.pair_quantities(twelve, two_zones, complement=False), NAMES)
    assert got == {(1, 1): (2, 3, 2, 1, 2, 2, 3, 1, 2), (1, 2): (4, 7, 2, 2, 4, 5, 5, 2, 2), (2, 1): (1, 1, 1, 1, 1, 1, 1, 1, 1), (2, 2): (1, 1, 1, 1, 1, 1, 1, 1, 1)}


def test_complement_zone_keeps_all_packets(twelve, two_zones):
    got = _pairs(zones.pair_quantities(twelve, two_zones), NAMES)
    assert got[1, 3] == (1, 2, 1, 1, 2, 2, 2, 1, 1)
    assert got[2, 3] == (0,) * 9
    assert got[3, 3] == (1, 4, 1, 1, 4, 4, 4, 1, 1)
    assert sum(v[0] for v in got.values()) == 12
    assert sum(v[1] for v in got.values()) == 21


def test_many_intervals_label_like_few(spark, monkeypatch):
    rnd = random.Random(5)
    edges = spark.createDataFrame([(rnd.randrange(1 << 20), rnd.randrange(1 << 20), 1) for _ in range(300)], "src long, dst long, packets long")
    cut = spark.createDataFrame([(i % 4 + 1, i * 30_000, i * 30_000 + 20_000) for i in range(30)], "zone int, lo long, hi long")
    few = sorted(map(tuple, zones.label(edges, cut).collect()))
    monkeypatch.setattr(zones, "INLINE", 3)
    assert sorted(map(tuple, zones.label(edges, cut).collect())) == few


def test_overlapping_zones_are_refused(spark, two_zones):
    assert zones.check(two_zones).count() == 4
    bad = two_zones.unionAll(spark.createDataFrame([(3, 3, 4)], "zone int, lo long, hi long"))
    none = spark.createDataFrame([], "src long, dst long, packets long")
    for cut in (zones.check, lambda z: zones.label(none, z), lambda z: zones.pair_quantities(none, z)):
        with pytest.raises(ValueError, match="overlap"):
            cut(bad)


@pytest.mark.parametrize(("inline", "bits"), [(zones.INLINE, 17), (3, 17), (3, 5)])
def test_intervals_that_overlap_label_a_link_once(spark, monkeypatch, inline, bits):
    monkeypatch.setattr(zones, "INLINE", inline)
    monkeypatch.setattr(scans, "BITS", bits)
    cut = [(1, 0, 50), (1, 0, 10), (1, 0, 50), *((2, 100 + 10 * i, 105 + 10 * i) for i in range(70)), (3, 60_000, 200_000)]
    rnd = random.Random(8)
    links = [(rnd.randrange(1000), rnd.randrange(250_000), 1) for _ in range(200)] + [(5, 7, 1)]
    zone = lambda ip: next((z for z, lo, hi in cut if lo <= ip <= hi), 4)
    got = zones.label(spark.createDataFrame(links, "src long, dst long, packets long"), spark.createDataFrame(cut, "zone int, lo long, hi long"))
    assert sorted(map(tuple, got.collect())) == sorted((*e, zone(e[0]), zone(e[1])) for e in links)


def test_inside_and_outside_part_the_links(twelve, two_zones):
    a, b = zones.inside(twelve, two_zones, "src"), zones.outside(twelve, two_zones, "src")
    assert {r["src"] for r in a.collect()} == {0, 2, 4}
    assert {r["src"] for r in b.collect()} == {3}


def test_matrix_algebra(twelve):
    twice = matrix.add(twelve, twelve)
    assert stats.quantities(twice).first()["n_packets"] == 42
    assert matrix.subtract(twelve, twelve).count() == 0
    assert matrix.equal(matrix.subtract(twice, twelve), twelve).first()["equal"]
    assert not matrix.equal(twice, twelve).first()["equal"]
    assert matrix.intersect(twelve, twice).count() == 12
    assert matrix.difference(twelve, twelve.where("src = 0")).count() == 8
    assert {tuple(r) for r in matrix.reduce(twelve, "src", "sum").collect()} == {(0, 5), (2, 7), (3, 7), (4, 2)}


def test_drill_down_keeps_weights(twelve):
    assert {tuple(r) for r in drill.behind(twelve, "max_packets").collect()} == {(2, 1, 4), (3, 3, 4)}
    assert {r["src"] for r in drill.behind(twelve, "max_source_packets").collect()} == {2, 3}
    assert {r["dst"] for r in drill.behind(twelve, "max_fan_in").collect()} == {2, 4}
    assert {r["dst"] for r in drill.behind(twelve, "max_fan_in", 2).collect()} == {1, 3}
    with pytest.raises(ValueError):
        drill.shown(twelve, 11)


STAR = [(0, i, 1) for i in range(1, 7)] + [(i, 0, 1) for i in range(1, 7)]
RING = [(i, (i + 1) % 6, 1) for i in range(6)] + [((i + 1) % 6, i, 1) for i in range(6)]
CLIQUE = [(i, j, 1) for i in range(6) for j in range(6) if i != j]


@pytest.mark.parametrize(("links", "want"), [(STAR, (12, 12, 7, 7, 1, 6, 6, 6, 6)), (RING, (12, 12, 6, 6, 1, 2, 2, 2, 2)), (CLIQUE, (30, 30, 6, 6, 1, 5, 5, 5, 5))])
def test_topologies(spark, links, want):
    got = stats.quantities(spark.createDataFrame(links, "src long, dst long, packets long")).first()
    assert tuple(got[n] for n in NAMES) == want


def test_display_rows(spark):
    from pyspark.sql import functions as F

    from netquilt.operators import display

    ids = spark.createDataFrame([(i,) for i in [0, 10, 39, 40, 79, 85, 480]], "id long")
    assert sorted(r[0] for r in display.spaced(ids, "id").collect()) == [0, 40, 85, 480]
    assert sorted(r[0] for r in display.every(ids, "id", 3).collect()) == [0, 40, 480]
    assert display.spaced(ids.limit(0), "id").count() == display.every(ids.limit(0), "id", 3).count() == 0
    assert [r[0] for r in display.page(ids, "id", 1, 3).collect()] == [40, 79, 85]
    row = ids.limit(1).select(display.metric_name(F.lit("max_fan_out")), display.zone_name(F.lit(2), ("a", "b")), display.zone_name(F.lit(9), ("a", "b")), *display.cell_zones(F.lit(0), F.lit(2), 5)).first()
    assert tuple(row) == ("Max Fan Out", "b", None, 5, 3)


def test_ratio_in_a_window_that_lacks_a_pair_of_zones(spark):
    rows = [(0, 1, 1, "a", 6), (0, 1, 1, "b", 3), (1, 1, 1, "a", 8), (1, 1, 1, "b", 2), (0, 1, 2, "a", 5), (0, 1, 2, "b", 5), (1, 2, 2, "a", 5), (1, 2, 2, "b", 0)]
    cells = spark.createDataFrame(rows, "window int, zone_src int, zone_dst int, metric string, value long")
    got = {tuple(r) for r in timeseries.metric_ratio(cells, "value", "a", "b", 1).collect()}
    assert got == {(1, 1, 4.0), (1, 2, None), (2, 2, None)}
