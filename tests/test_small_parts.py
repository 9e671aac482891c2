"""Spooled sockets, event marks, the run log, labels of links, and stored tables that are removed."""

import json
import logging
import socket
from datetime import datetime, timedelta

import pytest

from netquilt.operators import drill, filters, markers, scans
from netquilt.plans import traffic
from netquilt.sources.stored import discard, fresh, stored
from netquilt.streaming import sources
from netquilt.streaming.spool import Spool


def flow(i):
    return json.dumps({"src_ip": f"0.0.0.{i}", "dest_ip": "0.0.1.0", "flow": {"pkts_toserver": i, "pkts_toclient": 0}})


def send(where, data):
    kind = socket.AF_UNIX if isinstance(where, str) else socket.AF_INET
    with socket.socket(kind, socket.SOCK_STREAM) as s:
        s.connect(where)
        for at in range(0, len(data), 37):  # cuts lines anywhere
            s.sendall(data[at : at + 37])


@pytest.mark.parametrize("local", [True, False])
def test_a_socket_can_be_replayed(spark, tmp_path, local):
    where = str(tmp_path / "s") if local else ("127.0.0.1", 0)
    folder = str(tmp_path / "spool")
    spool = Spool(where, folder, size=200)
    to = where if local else spool.address
    send(to, "\n".join(flow(i) for i in range(1, 20)).encode())
    send(to, (flow(20) + "\nnonsense\n" + flow(21)).encode())
    spool.stop()
    assert len(list((tmp_path / "spool").glob("*.json"))) > 3
    for k in range(2):  # the same flows each time
        out = str(tmp_path / f"m{k}")
        links = filters.flows_to_links(sources.flows_from_files(spark, folder, 2))
        sources.accumulate(links, out, str(tmp_path / f"cp{k}")).awaitTermination(120)
        assert {(r["src"], r["packets"]) for r in sources.accumulated(spark, out).collect()} == {(i, i) for i in range(1, 22)}
    again = Spool(where if local else ("127.0.0.1", 0), folder)
    send(where if local else again.address, flow(50).encode())
    again.stop()
    sources.accumulate(filters.flows_to_links(sources.flows_from_files(spark, folder)), str(tmp_path / "m0"), str(tmp_path / "cp0")).awaitTermination(120)
    assert {r["src"] for r in sources.accumulated(spark, str(tmp_path / "m0")).collect()} == {*range(1, 22), 50}


def test_marks(spark, monkeypatch):
    monkeypatch.setattr(scans, "BITS", 21)
    monkeypatch.setattr(scans, "TOP", 22)
    at = datetime(2024, 5, 1)
    texts = ["x END", "noise", "START a", "END a", "START b END", "nothing", "END b", "END b", None]
    rows = [(at + timedelta(seconds=1.5 * i), t) for i, t in enumerate(texts)]
    got = [tuple(r) for r in markers.spans(spark.createDataFrame(rows, "ts timestamp, text string")).orderBy("ts").collect()]
    t = [r[0] for r in rows]
    assert got == [(t[0], "x END", "END", None, None), (t[2], "START a", "START", t[2], None), (t[3], "END a", "END", t[2], 1.5), (t[4], "START b END", "START", t[4], None), (t[6], "END b", "END", t[4], 3.0), (t[7], "END b", "END", t[4], 4.5)]


def test_run_log(spark, tmp_path, twelve, caplog):
    twelve.coalesce(1).write.parquet(str(tmp_path / "w"))
    with caplog.at_level(logging.INFO, "netquilt"):
        traffic.process_files(spark, "window-7", [str(tmp_path / "w")])
    assert "window-7: 1 files, 21 packets" in caplog.text and "analyze" in caplog.text


def test_labels_of_links(twelve):
    assert "Source: 3 Dest.: 3 Val: 4" in {r["label"] for r in drill.hover(twelve).collect()}


def test_stored_tables_can_be_removed(spark, twelve):
    discard(spark)
    held = stored(twelve, "gone")
    fresh(spark, "never-written")
    assert held.count() == 12
    assert discard(spark) == 1 and discard(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(held.inputFiles()[0]).count()
