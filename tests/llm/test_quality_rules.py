from collections import Counter

import pytest

from netquilt.llm import quality_rules as R


def plain_repeats(words):
    threes = Counter(zip(words, words[1:], words[2:], strict=False))
    return len({j for i in range(len(words) - 2) if threes[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)})


def test_repeated_words_equal_a_plain_count(rnd):
    for _ in range(300):
        words = [rnd.choice("abcd") * rnd.randint(1, 2) for _ in range(rnd.randint(0, 40))]
        assert R.repeated_words(words) == plain_repeats(words)


def test_counts_of_one_text():
    f = R.Features("# a b\n\na b\n a b\na b\x0bc|d\n")
    assert f["n_words"] == 10 and f["word_chars"] == 12 and f["n_symbols"] == 2
    assert f["n_dup_lines"] == 0  # the third line with words has a blank in front
    assert R.Features("x\nx\n\n\nx")["n_dup_lines"] == 2
    assert R.Features("a\xa0b")["n_words"] == 1


def test_report(docs_of, prose):
    clean, loud = prose(80), prose(80).upper()
    texts = [(1, clean), (2, None), (3, ""), (4, "a b c " * 40), (5, loud), (5, loud), (None, clean), (6, prose(80).replace(" ", " | ")), (7, clean + "\n" + prose(50_000)), (8, "x" * 3_000_000)]
    got = sorted(R.report(docs_of(texts)).collect(), key=lambda r: (r["doc_id"] or 0, r["n_words"]))
    assert R.report(docs_of([])).count() == 0 and len(got) == len(texts)
    want = sorted(((i, t or "") for i, t in texts), key=lambda x: (x[0] or 0, len(x[1].split())))
    for r, (i, t) in zip(got, want, strict=True):
        words = t.split()
        assert (r["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"]) == (i, len(words), sum(map(len, words)), plain_repeats(words))
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert r["kept"] == (i in (1, 7, None))


def test_verdicts_hang_on_no_order(docs_of, prose):
    """Any order of the rules gives the same verdict, and the named rule is one that the text fails."""
    docs = docs_of([(i, prose(60) if i % 3 else prose(20).upper()) for i in range(30)] + [(99, "- a b...\n" * 30)])
    judged = {r["doc_id"]: r["failed_rule"] for r in R.judge(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    named = {r.name: r for r in R.BASE + R.RULES}
    for i, rule in judged.items():
        fails = {n for n, r in named.items() if r.fails(R.Features(texts[i]))}
        assert (rule is None) == (not fails) and (rule is None or rule in fails)
    assert {r["doc_id"] for r in R.keep_good(docs).collect()} == {i for i, r in judged.items() if r is None}


def test_order_is_rejection_per_cost():
    cheap = R.Rule("cheap", ("n_symbols",), lambda f: False)
    dear = R.Rule("dear", ("words", "n_repeat_words"), lambda f: False)
    same = R.Rule("same", ("n_capitals",), lambda f: False)
    seconds = {"n_symbols": 1.0, "words": 4.0, "n_repeat_words": 6.0, "n_capitals": 1.0}
    # masks are bits of (dear, cheap, same): dear rejects 60 alone, cheap 10, same what cheap rejects
    found = R.Estimate(100, {0: 30, 1: 60, 6: 10}, seconds)
    assert [r.name for r in R.ordered((dear, cheap, same), found)] == ["cheap", "dear", "same"]
    assert [r.name for r in R.ordered((dear, cheap, same), found, paid=("n_repeat_words",))] == ["dear", "cheap", "same"]
    assert [r.name for r in R.ordered((dear, cheap, same), R.Estimate(0, {}, {}))] == ["dear", "cheap", "same"]


def test_later_rules_read_nothing():
    """A text that fails the first rule never has the features of the others."""
    f = R.Features("| " * 60)
    assert R.first_failed(f, R.RULES) == "symbols" and "n_capitals" not in f and "lines" not in f


def test_estimate_counts_the_sample(docs_of, prose):
    found = R.estimate(docs_of([(i, prose(60)) for i in range(20)] + [(50, "a b")] * 5), R.BASE)
    assert found.texts == 25 and found.fails == {0: 20, 1: 5} and found.seconds["n_repeat_words"] > 0


@pytest.mark.parametrize("name", ["failed_rule", "odd `name`.x"])
def test_columns_that_clash(spark, name):
    docs = spark.createDataFrame([(1, "a b c", 7)], ["doc_id", "text", name])
    out = R.judge(docs)
    assert out.columns == ["doc_id", "text", "_failed_rule" if name == "failed_rule" else name, "failed_rule"]
    assert R.keep_good(docs).columns == docs.columns and out.first()["failed_rule"] == "short"
