import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netquilt.llm import simhash


def plain(text):
    """The fingerprint, bit by bit."""
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \t\n", "One", "one two", "A b C d", "é É ß x y z w", "a b c " * 40_000, None, "x" * 200_000])
def test_fingerprint(text):
    assert simhash.fingerprint(text) % (1 << 64) == plain(text)


def components(pairs):
    fps = [plain(t) for _, t in pairs]
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(pairs):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(pairs, fps, strict=True))]


def test_components_equal_all_pairs(docs_of, prose, rnd):
    pairs = []
    for i in range(60):
        text = prose(rnd.randint(1, 120))
        pairs.append((3 * i + 5, text))
        for k in range(rnd.randint(0, 4)):
            words = text.split()
            words[rnd.randrange(len(words))] = "odd"
            pairs.append((1000 + 10 * i + k, " ".join(words)))
    pairs += [(1, None), (2, ""), (3, " "), (4, pairs[0][1]), (None, pairs[0][1]), (5, pairs[0][1])]
    got = simhash.near_duplicates(docs_of(pairs)).select("doc_id", "fingerprint", "component_id").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(components(pairs), key=key)


def test_empty(docs_of):
    assert simhash.near_duplicates(docs_of([(1, "a")]).limit(0)).count() == 0
    assert simhash.keep_one(docs_of([(1, "a")]).limit(0)).count() == 0


def test_bound_is_below_the_distance():
    g = np.random.default_rng(1)
    a, b = g.integers(0, 1 << 63, (2, 5000), dtype=np.uint64)
    b = np.where(np.arange(5000) % 2 == 0, a ^ (np.uint64(1) << g.integers(0, 64, 5000).astype(np.uint64)), b)
    assert (simhash.lower_bound(a, b) <= np.bitwise_count(a ^ b)).all()


def _near(spark, monkeypatch=None):
    g = random.Random(3)
    base = [g.getrandbits(64) for _ in range(40)]
    made = set(base)
    for f in base:
        for _ in range(60):
            x = f
            for b in g.sample(range(64), g.randint(1, 4)):
                x ^= 1 << b
            made.add(x)
    return sorted(x - (1 << 64) if x >> 63 else x for x in made)


@pytest.mark.parametrize("most", [simhash.MAX_CELL, 17])
def test_links_span_all_groups_even_in_large_cells(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "MAX_CELL", most)
    monkeypatch.setattr(simhash, "BLOCK", 10)
    fps = _near(spark)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r["node"]: r["root"] for r in simhash.connected(simhash.links(frame)).collect()}
    u = np.array(fps, np.int64).view(np.uint64)
    want = {}
    for i, f in enumerate(fps):
        want.setdefault(f, f)
        for j in np.flatnonzero(np.bitwise_count(u ^ u[i]) <= 3).tolist():
            a, b = f, fps[j]
            while want.get(a, a) != a:
                a = want[a]
            while want.setdefault(b, b) != b:
                b = want[b]
            want[max(a, b)] = min(a, b)

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    assert {f: roots.get(f, f) for f in fps} == {f: find(f) for f in fps}


def test_connected_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, 1001 + i) for i in range(500)]
    got = simhash.connected(spark.createDataFrame(chain + hub + hub, "a long, b long")).groupBy("root").agg(F.count("*")).collect()
    assert sorted(map(tuple, got)) == [(0, 201), (1000, 501)]


def test_keep_one(docs_of, prose):
    a, b, c = prose(50), prose(50), prose(50)
    kept = simhash.keep_one(docs_of([(5, a), (3, a), (9, b), (9, b), (9, c), (2, None), (4, "")]))
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(3, a), (9, b), (9, c), (2, "")])
    assert kept.columns == docs_of([]).columns
