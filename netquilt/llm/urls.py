"""URL filters with a cascade of Bloom filters, in DataFrame functions only.

The keys of a url are the ends of its host, bare or with a start of its path.
The corpus's keys, all of them, form the universe. Level 1 encodes the listed
keys, level 2 the keys of the universe that pass level 1 by mistake, level 3
the listed keys that pass level 2 by mistake, and so on until a level makes no
mistake. For every key of the universe the levels then give exact membership,
so urls are judged by bit tests inside one projection, without a join.

A filter is a constant of bounded size. Beyond ``SHARD_KEYS`` keys the key
space is cut by hash into shards with a cascade each, and the urls pass
through one shard's constants at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Keys in one level's filter at most; about 5 MB of bits.
SHARD_KEYS = 2_000_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``block`` or allow a host with its subdomains where the path starts with ``path``."""

    host: str
    path: str
    block: bool

    @property
    def key(self) -> str:
        return self.host + (self.path or _WHOLE)


RULES = (Rule("org", "/", False), Rule("example.org", "/es/", True), Rule("example.org", "/en/1", True), Rule("com", "/fr/", False), Rule("com", "/de/", True))
#: The default list: those hosts of the table itself, and what lies under them, that have one of these words between dots and dashes.
JUNK = "(^|[.-])(ads?|adserver|adult|bets?|betting|casino|lottery|pills|poker|porn|sex|slots|spam|tracker|tracking|viagra|xxx)([.-]|$)"
#: Stands behind the host in the key of a rule without a path, so that it is no listed host.
_WHOLE = "\x01"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z in lower case, and path; both empty for null or without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _UPPER.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_keys(host: Column, path: Column, labels: int, starts: Sequence[int], whole: bool = False) -> Column:
    """Keys of a url: each end of up to ``labels`` labels of its host, bare, with each start of its path and, if ``whole``, for rules without one."""
    parts = F.slice(F.reverse(F.split(host, r"\.")), 1, labels)
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.reverse(F.slice(parts, 1, n)), "."))
    heads = F.filter(F.array(F.lit(""), *([F.lit(_WHOLE)] if whole else []), *(F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in starts)), lambda p: p.isNotNull())
    return F.flatten(F.transform(ends, lambda e: F.transform(heads, lambda p: F.concat(e, p))))


@dataclass
class Level:
    """A Bloom filter as a constant array of 64-bit words."""

    salt: int
    bits: int
    hashes: int
    words: list[int] = field(default_factory=list)

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.salt), F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def encode(self, keys: DataFrame) -> Level:
        """Set the bits of ``keys``; each word is made by a distributed OR."""
        spread = keys.select(F.explode(F.array(*self.positions(F.col("key")))).alias("at"))
        words = spread.groupBy((F.shiftright("at", 6)).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(at & 63))")).alias("bits"))
        self.words = [0] * (self.bits // 64)
        for word, bits in words.collect():  # bounded by the size of the filter
            self.words[word] = bits
        return self

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to one constant
        tests = [F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in self.positions(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def _sized(salt: int, n: int, wrong: float) -> Level:
    """A level for ``n`` keys that passes a share ``wrong`` of others."""
    bits = max(64, math.ceil(n * 1.45 * math.log2(1 / wrong) / 64) * 64)
    return Level(salt, bits, max(1, min(16, round(bits / n * math.log(2)))))


class Cascade:
    """Exact membership for the keys of a universe ``(key, listed)`` of distinct keys."""

    def __init__(self, universe: DataFrame, salt: int = 0):
        self.levels: list[Level] = []
        n, all_ = universe.agg(F.count_if("listed"), F.count("*")).first()
        inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
        wrong = min(0.01, max(1e-6, 0.5 * n / max(1, all_)))  # so that level 2 is no larger than level 1
        while n:
            self.levels.append(_sized(salt * 100 + len(self.levels), n, wrong).encode(inside))
            outside = materialise(outside.where(self.levels[-1].passes(F.col("key"))), "mistakes")
            inside, outside, n, wrong = outside, inside, outside.count(), 0.01

    def holds(self, key: Column) -> Column:
        """Whether a key of the universe is listed: the first level that it fails decides."""
        if not self.levels:
            return F.lit(False)
        out = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            out = F.when(self.levels[i].passes(key), out).otherwise(F.lit(i % 2 == 1))
        return out


def judge(pages: DataFrame, rules: Sequence[Rule] = RULES, hosts: DataFrame | None = None) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    Of the rules that fit, the longest wins. A rule without a path fits its host
    and what lies under it; a key that is both allowed and blocked is an error.
    Without a rule, a url whose host is, or lies under, one of ``hosts`` (column
    ``host``; by default the table's own hosts that match ``JUNK``) is blocked
    and any other allowed. A null url, or one without ``://``, has an empty host
    and path, fits no rule and is allowed. Repeated rows are judged alike; a
    null page_id stays null; very long urls are judged whole; extra columns are
    ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    kinds: dict[str, bool] = {}
    for r in rules:
        if kinds.setdefault(r.key, r.block) != r.block:
            raise ValueError(f"{r.host}{r.path} is both allowed and blocked")
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    if hosts is None:
        hosts = urls.select("host").distinct().where(F.col("host").rlike(JUNK))
    # a null or empty host lists nothing
    listed = hosts.where("host <> ''").select(F.translate("host", _UPPER, _UPPER.lower()).alias("key"), F.lit(True).alias("block"))
    if kinds:
        given = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(b).alias("block")) for k, b in kinds.items()))
        listed = spark.range(1).select(F.inline(given)).unionAll(listed)
    listed = materialise(listed.distinct(), "listed")
    n, labels = listed.agg(F.count("*"), F.max(F.size(F.split(F.split("key", "/")[0], r"\.")))).first()
    starts = sorted({len(r.path) for r in rules if r.path})
    its_keys = url_keys(F.col("host"), F.col("path"), labels or 1, starts, any(not r.path for r in rules))
    universe = urls.select(F.explode(its_keys).alias("key"), F.lit(False).alias("listed")).unionAll(listed.select("key", F.lit(True)))
    universe = materialise(universe.groupBy("key").agg(F.max("listed").alias("listed")), "universe")

    shards = n // SHARD_KEYS + 1
    shard = lambda k: F.pmod(F.xxhash64(F.lit("shard"), k), F.lit(shards))
    out = urls.withColumn("keys", its_keys).withColumn("found", F.array().cast("array<string>")).withColumn("blocks", F.array().cast("array<string>"))
    for i in range(shards):
        mine = lambda k, i=i: shard(k) == i if shards > 1 else F.lit(True)
        member = Cascade(universe.where(mine(F.col("key"))), 2 * i + 1)
        blocking = Cascade(listed.where(mine(F.col("key"))).select("key", F.col("block").alias("listed")), 2 * i + 2)
        hits = F.filter("keys", lambda k: mine(k) & member.holds(k))
        out = out.withColumn("hits", hits).select("page_id", "host", "path", "keys", F.concat("found", "hits").alias("found"), F.concat("blocks", F.filter("hits", blocking.holds)).alias("blocks"))
        out = materialise(out, "judged") if shards > 1 else out
    # the longest key with a path, or for a whole host, is the rule; any other listed key is a host
    ruled = lambda k: F.contains(k, F.lit("/")) | F.contains(k, F.lit(_WHOLE))
    fitting = F.filter("found", ruled)
    rule = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(F.replace(k, F.lit(_WHOLE), F.lit(""))).alias("n"), k.alias("key"))))["key"]
    out = out.withColumn("rule", rule)
    bare = F.size(F.filter("found", lambda k: ~ruled(k))) > 0
    blocked = F.when(F.col("rule").isNotNull(), F.array_contains("blocks", F.col("rule"))).otherwise(bare)
    return out.select("page_id", "host", "path", F.replace("rule", F.lit(_WHOLE), F.lit("")).alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


#: The same judgement in SQL.
ORACLE = f"""
WITH parsed AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_UPPER.lower()}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fit AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parsed)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(host, '{JUNK}') THEN 'block'
    ELSE 'allow' END AS verdict
FROM fit
"""
