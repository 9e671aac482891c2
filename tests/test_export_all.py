from netquilt.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_every_packet_of_every_link_is_exported(spark):
    want = [(e["src"], e["dst"]) for e in sorted(catalog.edges(spark, DATA).collect(), key=lambda e: (e["src"], e["dst"])) for _ in range(e["packets"])]
    got = sorted(catalog.QUERIES["export_all_packets"](spark, DATA).collect(), key=lambda r: r["seq"])
    assert [r["seq"] for r in got] == list(range(len(want)))
    assert [(r["src"], r["dst"]) for r in got] == want
