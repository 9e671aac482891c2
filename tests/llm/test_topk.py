import math

import numpy as np
import pytest

from netquilt.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, score string"


def plain(rows):
    whole = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in whole:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole if i != q and len(b) == len(a))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found[:10], 1)]
    return sorted(out)


@pytest.mark.parametrize("block", [topk.DATA_BLOCK, 200])
def test_equal_to_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "DATA_BLOCK", block)
    g = np.random.default_rng(5)
    centres = g.normal(size=(6, 16))
    rows = [(i, (centres[i % 6] + 0.1 * g.normal(size=16)).tolist()) for i in range(1200)]
    rows += [(2000 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(-100, rows[3][1]), (3000, [0.0] * 16), (None, rows[0][1]), (3100, None), (3101, []), (3200, [float("nan")] * 16), (3300, [None] * 16), (3400, [float("inf")] * 16), (5, rows[5][1])]
    rows[9] = (9, [3e4] * 16)
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], SCHEMA).repartition(5)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df).collect())
    assert got == plain(rows)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0], 1, 1, "x"), (1, [2.0], 1, 1, "x"), (100, [-1.0], 1, 1, "x")], SCHEMA)
    assert sorted(map(tuple, topk.search(df).select("query_id", "rank", "vec_id", "score").collect())) == [(0, 1, 1, 2 << 20), (0, 2, 100, -(1 << 20)), (100, 1, 0, -(1 << 20)), (100, 2, 1, -(2 << 20))]
    assert topk.search(df.limit(0)).count() == 0


@pytest.mark.parametrize("leaf", [1, topk.LEAF])
def test_cover_tree_invariants(leaf):
    g = np.random.default_rng(1)
    points = np.concatenate([g.normal(size=(500, 8)), np.zeros((300, 8)), np.repeat(g.normal(size=(20, 8)), 10, 0) + 1e-3 * g.normal(size=(200, 8))])
    away = lambda rows, at: np.sqrt(((points[rows] - points[at]) ** 2).sum(1))
    root = topk.cover_tree(points, leaf)
    todo, rows, depth = [root], [], 0
    while todo:
        n = todo.pop()
        assert n.at in n.rows and away(n.rows, n.at).max() <= n.radius + 1e-9 and n.radius <= 2.0**n.level  # covering, by a row
        if not n.children:
            assert len(n.rows) <= leaf or n.radius == 0
            rows += n.rows.tolist()
            continue
        depth += 1
        centres = np.array([c.at for c in n.children])
        assert centres[0] == n.at and len(centres) > 1  # nesting
        assert all(c.level <= n.level - 1 for c in n.children)  # radii halve
        gaps = np.stack([away(centres, c) for c in centres])
        np.fill_diagonal(gaps, np.inf)
        assert gaps.min() > 2.0 ** (n.level - 1)  # separation
        assert sorted(np.concatenate([c.rows for c in n.children])) == sorted(n.rows)
        todo += n.children
    assert sorted(rows) == list(range(1000)) and depth > (10 if leaf == 1 else 1)


def test_pruning_leaves_pairs_out_and_loses_nothing():
    g = np.random.default_rng(2)
    data = np.floor(1024 * (np.repeat(g.normal(size=(20, 8)), 200, 0) + 0.01 * g.normal(size=(4000, 8)))).astype(np.int64)
    find = topk.Search(data[::40], np.arange(0, 4000, 40))
    find.add(data, np.arange(4000))
    assert find.multiplied < 0.5 * find.possible
    q, ids, score = find.found()
    all_ = data[::40] @ data.T
    all_[np.arange(100), np.arange(0, 4000, 40)] = -(1 << 60)
    assert sorted(zip(q.tolist(), score.tolist(), strict=True)) == sorted((i, int(x)) for i, row in enumerate(all_) for x in np.sort(row)[-10:])
    assert len(ids) == 1000


def test_queries_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 4)
    g = np.random.default_rng(7)
    rows = [(i * 10, g.normal(size=4).tolist()) for i in range(300)]
    df = spark.createDataFrame([(i, v, 1, 1, "x") for i, v in rows], SCHEMA)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.search(df).collect()) == plain(rows)
