import hashlib
import zlib
from collections import defaultdict

import pytest

from netquilt.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, c string"


def sha(ids):
    return hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()


def plain(rows, rebuild):
    """The trie by walking every conversation's prefixes."""
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            turns[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [t[1:] for t in sorted(x)] for c, x in turns.items()}
    convs = dict(own)
    if rebuild:
        for c, x in own.items():
            first, h = c - c % 5, zlib.crc32(str(c).encode()) % 9  # conv_ids are not negative here
            convs[c] = own.get(first, [])[:h] + x[h:]
    nodes = defaultdict(list)
    for c, x in convs.items():
        for d in range(len(x) + 1):
            nodes[tuple(x[:d])].append(c)
    kids = defaultdict(list)
    for key in nodes:
        if key:
            kids[key[:-1]].append(key)
    worth, leaves = {}, {}
    for key in sorted(nodes, key=len, reverse=True):
        mine = (len(nodes[key]) - 1) * len(key[-1][1].encode()) if key else 0
        worth[key] = mine + sum(worth[k] for k in kids[key])
        leaves[key] = sum(leaves[k] for k in kids[key]) or 1
    return sorted(
        (min(m), len(key), min(nodes[key[:-1]]) if key else None, len(m), len(kids[key]), leaves[key], worth[key], sha([c for c in m if len(convs[c]) == len(key)])) for key, m in nodes.items()
    )


def got(df):
    return sorted(map(tuple, df.collect()))


@pytest.fixture
def talks(rnd):
    """Conversations of which many begin alike, some are copies, and one is deep."""
    out = []
    for c in range(60):
        depth = rnd.choice([1, 2, 3, 5, 9, 12])
        if c % 4 == 0:
            out += [(c, t, "user", f"common {min(t, 3)}") for t in range(depth)]
        else:
            out += [(c, t, rnd.choice(["user", "assistant"]), rnd.choice(["a", "b", "é"]) * rnd.randint(0, 2)) for t in range(depth)]
    out += [(70, t, "user", "common " + str(min(t, 3))) for t in range(90)]
    out += [(76, t, "user", "common 0" if t < 50 else "x") for t in range(75)]
    return [(*r, 7, "x") for r in out]


@pytest.mark.parametrize("band", [2, 3, 32])
@pytest.mark.parametrize("rebuild", [False, True])
def test_equals_a_plain_walk(spark, monkeypatch, talks, band, rebuild):
    monkeypatch.setattr(prefix_trie, "BAND", band)
    monkeypatch.setattr(prefix_trie, "SLICE", 7)
    docs = spark.createDataFrame(talks, SCHEMA)
    assert got(prefix_trie.prefix_trie(docs, rebuild)) == plain(talks, rebuild)


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "a"), (2, 0, "", ""), (2, 1, "assistant", "a"),
        (None, 0, "user", "lost"), (3, -1, "user", "late"), (3, None, "user", None), (10, 0, "us", "erx"), (15, 0, "user", "x"), (1, 0, None, "z" * 2_000_000),
    ]
    rows = [(*r, 7, "x") for r in rows]
    for rebuild in (False, True):
        assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), rebuild)) == plain(rows, rebuild)
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA), True).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", 7, "x")], SCHEMA), True).count() == 0


def test_rebuilt_without_turns(spark):
    """A conversation shorter than its head, whose first of five is missing, has no turns."""
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(c, 0, "user", "a", 7, "x")]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), True)) == plain(rows, True) == [(c, 0, None, 1, 0, 1, 0, sha([c]))]


def test_one_conversation_and_one_end_over_many_tasks(spark, monkeypatch):
    """A third of all turns in one conversation, and a third in copies of another, spread over the tasks."""
    monkeypatch.setattr(prefix_trie, "SLICE", 50)
    rows = [(1000, t, "user", f"t{t % 5}", 7, "x") for t in range(600)]
    rows += [(c, t, "user", f"same {t}", 7, "x") for c in range(300) for t in range(2)]
    rows += [(c, 0, "user", f"own {c}", 7, "x") for c in range(2000, 2600)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    turns = prefix_trie.ordered(docs)
    assert turns.where("c = 1000").select("n").distinct().count() == 600
    assert got(prefix_trie.prefix_trie(docs)) == plain(rows, False)
    ends = spark.createDataFrame([(5, 2, c) for c in range(1000)] + [(9, 1, 3)], "owner long, d long, c long")
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    assert {tuple(r) for r in prefix_trie.hashed_ends(ends).collect()} == {(5, 2, sha(range(1000))), (9, 1, sha([3]))}


def test_rounds_and_rows_are_bounded(spark, monkeypatch):
    """A chain of n nodes takes rounds by the logarithm of n, and no node gives more than BAND rows a round."""
    monkeypatch.setattr(prefix_trie, "BAND", 4)
    seen = []
    real = prefix_trie.given

    def watched(nodes, values, unit, sums):
        seen.append((unit, nodes.agg({"line": "count"}).first()[0], max((len(r["line"]) for r in nodes.collect()), default=0)))
        return real(nodes, values, unit, sums)

    monkeypatch.setattr(prefix_trie, "given", watched)
    rows = [(0, t, "user", str(t), 7, "x") for t in range(100)]
    assert got(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == plain(rows, False)
    assert [u for u, _, _ in seen] == [1, 4, 16, 64, 16, 4, 1]
    assert all(most <= 4 for _, _, most in seen)
