import re

import pytest
from pyspark.sql import functions as F

from netquilt.llm import urls

def plain(url, hosts=None, rules=urls.RULES):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = m.groups() if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    under = lambda h: host == h or host.endswith("." + h)
    fit = [r for r in rules if under(r.host) and path.startswith(r.path)]
    rule = max(fit, key=lambda r: len(r.host + r.path), default=None)
    listed = any(map(under, hosts)) if hosts is not None else bool(re.search(urls.JUNK, host))
    block = rule.block if rule else listed
    return host, path, rule and rule.host + rule.path, "block" if block else "allow"


URLS = [
    None, "", "no scheme", "http://", "http://example.org", "http://example.org/", "HTTP://Example.ORG/es/x", "http://a.b.example.org/es/", "http://example.org/es", "http://example.org/en/1", "http://example.org/en/10?x", "http://www.example.org/en/2",
    "http://x.com/fr/1", "http://x.com/de/1", "http://com/de/", "http://xcom/de/", "http://free-bets.example.com/en", "http://m.free-bets.example.com?q", "http://bets.example.com/", "https://casino-win.example.org", "http://É.ORG/é?#", "a://b://c.org/",
    "http://example.org#/es/", "http://.org/", "http://org./", "ftp://x.net/" + "p" * 50_000, "http://" + "a." * 500 + "org/x", "http://example.org\n/es/", "://org/",
]


def test_verdicts(spark):
    rows = [(i, u, "x", "y", "z") for i, u in enumerate(URLS)] + [(None, URLS[6], "x", "y", "z")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, host string, rule string, keys string")
    got = [tuple(r) for r in urls.judge(df).collect()]
    assert sorted(map(repr, got)) == sorted(repr((r[0], *plain(r[1]))) for r in rows)
    assert urls.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [urls.SHARD_KEYS, 7])
def test_membership_is_exact_over_the_universe(spark, monkeypatch, shard):
    monkeypatch.setattr(urls, "SHARD_KEYS", shard)
    hosts = [f"h{i}.example.net" for i in range(0, 600, 7)]
    df = spark.createDataFrame([(i, f"http://www.h{i}.example.net/p{i}") for i in range(600)], "page_id long, url string")
    got = urls.judge(df, hosts=spark.createDataFrame([(h,) for h in hosts] * 2 + [("",), (None,)], "host string"))
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == set(range(0, 600, 7))


def test_rules_without_a_path(spark):
    rules = (urls.Rule("x.net", "", False), urls.Rule("x.net", "/bad", True), urls.Rule("spam.org", "", True), urls.Rule("ok.spam.org", "", False), urls.Rule("net", "", True))
    rows = [(i, u) for i, u in enumerate(["http://x.net", "http://a.x.net/bad/1", "http://y.net/", "http://spam.org?q", "http://ok.spam.org/", "http://x.org/", "http://ads.org/", None])]
    df = spark.createDataFrame(rows, "page_id long, url string")
    got = [tuple(r) for r in urls.judge(df, rules).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *plain(u, rules=rules))) for i, u in rows)
    hosts = spark.createDataFrame([("x.net",), ("y.net",)], "host string")
    got = [tuple(r) for r in urls.judge(df, rules[:1], hosts).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *plain(u, ("x.net", "y.net"), rules[:1]))) for i, u in rows)
    assert urls.judge(df, ()).where("rule is not null").count() == 0
    with pytest.raises(ValueError, match="both"):
        urls.judge(df, (urls.Rule("a", "/", True), urls.Rule("a", "/", False)))


def test_the_default_list_grows_with_the_hosts(spark):
    rows = [(i, f"http://{'casino' if i % 3 == 0 else 'plain'}-{i}.example.net/p") for i in range(3000)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"))
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == set(range(0, 3000, 3))


def test_cascade_has_levels_and_no_mistakes(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 5 == 0).alias("listed"))
    cascade = urls.Cascade(keys)
    assert len(cascade.levels) >= 2
    assert keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    assert keys.limit(3).where(urls.Cascade(keys.where("false")).holds(F.col("key"))).count() == 0


def test_plan_is_native(spark):
    df = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    plan = urls.judge(df)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Python" not in plan and "Arrow" not in plan
