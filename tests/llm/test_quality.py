import numpy as np
import pytest
from pyspark.sql import functions as F

from netquilt.llm import quality


def poor(rnd, prose):
    kind = rnd.randrange(3)
    text = prose(rnd.randint(20, 80))
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in text.split())
    if kind == 1:
        return " ".join(w + rnd.choice(["***", "$$$", "%%%"]) for w in text.split())
    return " ".join(f"{w} " * 6 for w in text.split()[:12])


@pytest.fixture
def corpus(rnd, prose):
    return [(i, poor(rnd, prose) if i % 5 == 0 else prose(rnd.randint(20, 120)).capitalize() + ".") for i in range(600)]


def test_held_out_accuracy(spark, docs_of, corpus):
    docs = docs_of(corpus)
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, _ in corpus if i % 3 == 0] + [(None, 1, 0), (7, None, 0), (10_000, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["keep"] for r in quality.score(docs, labels).collect()}
    held = [i for i, _ in corpus if i % 3]
    assert sum(got[i] == (i % 5 != 0) for i in held) / len(held) > 0.98
    kept = {r["doc_id"] for r in quality.drop_poor(docs, labels).collect()}
    assert kept == {i for i, k in got.items() if k}
    assert quality.drop_poor(docs, labels).columns == docs.columns


def test_odd_rows(spark, docs_of, corpus):
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i, _ in corpus], "doc_id long, quality int")
    docs = docs_of([*corpus, (None, None), (900, ""), (901, " \n"), (902, "w " * 100_000), (1, corpus[1][1])]).withColumn("keep", F.lit(5))
    rows = quality.score(docs, labels).collect()
    assert len(rows) == 605 and all(r["score"] is not None for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
    assert quality.score(docs.limit(0), labels).count() == 0


def test_without_labels_all_stay(spark, docs_of, corpus):
    docs = docs_of(corpus[:20])
    for rows in ([], [(1, 1), (2, 1)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int")
        assert quality.score(docs, labels).where("keep and score is null").count() == 20
        assert quality.drop_poor(docs, labels).count() == 20


def test_views_help_each_other():
    """Metadata that tells nothing of itself learns from the content view's labels."""
    g = np.random.default_rng(4)
    good = g.integers(0, 2, 3000)

    def doc(y):
        f = [1.0, *([3.0 * y + g.normal()] * 10)]
        return (f, "en", f"src{g.integers(0, 3) + 3 * y}", 100)

    docs = [doc(y) for y in good]
    few = quality.co_train(docs[:60], [float(y) for y in good[:60]], docs[60:2000])
    t, m, both = few.score(docs[2000:])
    want = good[2000:] == 1
    assert ((both >= 0.5) == want).mean() >= max(((t >= 0.5) == want).mean(), ((m >= 0.5) == want).mean()) - 0.01
    assert ((m >= 0.5) == want).mean() > 0.9


def test_labels_without_documents_take_no_place(spark, docs_of, corpus, monkeypatch):
    monkeypatch.setattr(quality, "LABELLED", 250)
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i, _ in corpus[:200]] + [(10_000 + i, i % 2) for i in range(5000)], "doc_id long, quality int")
    got = {r["doc_id"]: r["keep"] for r in quality.score(docs_of(corpus), labels).collect()}
    assert sum(got[i] == (i % 5 != 0) for i in range(200, 600)) / 400 > 0.95


def test_fit_equals_plain_gradient_descent():
    g = np.random.default_rng(6)
    x = g.normal(size=(200, 4)) * [1, 5, 0.1, 2] + [0, 3, 1, -2]
    y = (x[:, 0] + 0.3 * x[:, 1] + g.normal(size=200) > 1).astype(float)
    model = quality.fit(x, y)
    z = np.column_stack([np.ones(200), (x - x.mean(0)) / x.std(0)])
    w, ridge = np.zeros(5), np.array([1e-6, 1, 1, 1, 1])
    for _ in range(30_000):
        w += 0.01 * (z.T @ (y - 1 / (1 + np.exp(-z @ w))) - ridge * w)
    assert np.allclose(model.weight, w, atol=1e-4)
    one = [sum(a * b for a, b in zip(row, w, strict=True)) for row in z]
    assert np.allclose(model.raw(x), np.clip(one, -30, 30), atol=1e-3)


def test_telling_slots_by_counting():
    words = [np.array(sorted({i % 7 + 10, 3 if i % 4 == 0 else 5}), np.uint32).tobytes() for i in range(80)]
    bad = np.array([float(i % 4 == 0) for i in range(80)])
    assert {3, 5} <= set(quality.telling_slots(words, bad).tolist())
    assert quality.shapes("the&&& 12,5!! word |") == {"a&", "0,0!", "|"}


def test_few_labels_see_few_slots(rnd):
    """Six rows of a class leave room for six slots, the one that means it among them."""
    words = [np.array(sorted({7 if i < 6 else 9, *rnd.sample(range(100, 5000), 40)}), np.uint32).tobytes() for i in range(60)]
    slots = quality.telling_slots(words, np.array([float(i < 6) for i in range(60)]))
    assert len(slots) == 6 and {7, 9} <= set(slots.tolist())
