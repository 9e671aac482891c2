import pytest

from netquilt.llm import decontaminate as d


def plain(item, text):
    """Edit distance of the item to the best stretch."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_distance(rnd):
    for _ in range(500):
        item = [rnd.randint(1, 4) for _ in range(rnd.randint(1, 70))]
        text = [rnd.randint(0, 4) for _ in range(rnd.randint(0, 90))]
        assert d.best_stretch(item, text)[0] == plain(item, text)


def edited(rnd, words, n):
    words = list(words)
    for _ in range(n):
        at = rnd.randrange(len(words))
        kind = rnd.randrange(3)
        words[at : at + (kind != 1)] = [] if kind == 0 else ["odd"]
        words = words or ["odd"]
    return words


@pytest.mark.parametrize("block", [d.BLOCK_CHARS, 200])
def test_matches_equal_all_pairs(spark, docs_of, prose, rnd, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_CHARS", block)
    items = [(i, prose(rnd.choice([5, 9, 10, 31, 60]))) for i in range(12)] + [(20, "too few"), (21, None), (22, ""), (0, prose(12))]
    docs = [(i, prose(rnd.randint(0, 150))) for i in range(30)] + [(90, None), (91, ""), (None, items[3][1])]
    for k in range(60):
        item = rnd.choice([t for _, t in items if t and len(t.split()) >= 5]).split()
        body = edited(rnd, item, rnd.randint(0, len(item) // 4 + 1))
        text = f"{prose(rnd.randint(0, 40))}\n{' '.join(body).upper()}!! {prose(rnd.randint(0, 40))}"
        docs.append((100 + k, text))
    docs.append((100, docs[-1][1]))
    docs.append((300, prose(30_000) + " | " + items[2][1].replace(" ", "*** ")))
    want = []
    for i, text in docs:
        for item, t in items:
            a, b = d.words(t), d.words(text)
            if a and (best := plain(a, b)) <= len(a) // 5:
                want.append((i, item, best, len(a)))
    frame, bench = docs_of(docs), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:4] for r in d.leaks(frame, bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    clean = [(i, t) for i, t in docs if not any(d.words(x) and plain(d.words(x), d.words(t)) <= len(d.words(x)) // 5 for _, x in items)]
    left = [(r["doc_id"], r["text"]) for r in d.drop_leaks(frame, bench).collect()]
    assert sorted(map(repr, left)) == sorted(map(repr, clean))


def test_short_items_and_scripts_without_blanks(spark, docs_of):
    items = [(1, "Who wrote Faust?"), (2, "42"), (3, "..."), (4, "水の分子は何からできているか"), (5, "ประเทศไทยมีกี่จังหวัด"), (6, "光速是多少")]
    docs = [(1, "asked: who WROTE, faust - he said"), (2, "who has wrote faust"), (3, "it is 42."), (4, "it is 421"), (5, "では、水の分子は何でできているか、と問う"), (6, "คำถาม ประเทศไทยมีกี่จังหวัด ตอบ"), (7, "问题:光速是多少?答"), (8, "光速多少"), (9, "...")]
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(docs_of(docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, item) for i, t in docs for item, x in items if d.words(x) and plain(d.words(x), d.words(t)) <= len(d.words(x)) // 5}
    assert got == want and {(1, 1), (3, 2), (5, 4), (6, 5), (7, 6)} <= got and not {(2, 1), (4, 2)} & got
    assert d.words("ab漢字cd いえ") == ["ab", "漢", "字", "cd", "い", "え"]


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = docs_of([(1, "a b c d e f")])
    assert d.leaks(docs, none).count() == 0
    assert d.drop_leaks(docs, none).count() == 1
    assert d.leaks(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_blocks_are_bounded_whatever_repeats():
    items = [(i, "the same text of an item") for i in range(500)] + [(501, "x" * 900)]
    cut = list(d.blocks(iter(items), 100))
    assert [x for b in cut for x in b] == items
    assert all(sum(len(t) for _, t in b) <= 100 or len(b) == 1 for b in cut) and max(map(len, cut)) <= 4


def test_items_of_equal_words_and_shared_pieces(prose):
    """Equal items each give a row, and a phrase that thousands of items share costs little."""
    import time

    stock = prose(8)
    items = [(i, f"{stock} {prose(12)}") for i in range(5_000)] + [(9_000, "one two three four five six"), (9_001, "One, two; three four FIVE six")]
    index = d.Index(items)
    text = " ".join(f"{prose(20)} {stock}" for _ in range(25)) + " one two three four five six " + items[77][1]
    began = time.perf_counter()
    found = {item: n for _, item, n, *_ in index.matches([text])}
    assert time.perf_counter() - began < 2
    assert {9_000: 0, 9_001: 0, 77: 0}.items() <= found.items()
