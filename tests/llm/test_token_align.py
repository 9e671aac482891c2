import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from netquilt.llm import bpe, token_align


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.default_vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=token_align.default_pieces())


def plain_ids(text, both):
    """Ids and token bytes of both sides over the whole text at once; None where bytes differ."""
    a, b = both
    byte_of = {c: n for n, c in enumerate(bpe.byte_letters())}
    x = a.encode(" " + text, add_special_tokens=False).ids
    y = b.encode(text)
    xs = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in x]
    ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    whole = (" " + text).encode()
    return (x, xs, y, ys) if text and b"".join(xs) == whole and b"".join(ys) == whole else None


def spans(parts):
    at, out = 0, []
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(text, both):
    """Groups and links by comparing all tokens with all."""
    found = plain_ids(text, both) if text else None
    if not found:
        return [], []
    x, xs, y, ys = found
    p, q = spans(xs), spans(ys)
    ends = sorted({e for _, e in p} & {e for _, e in q})
    inside = lambda ids, where, lo, hi: tuple(i for i, (s, e) in zip(ids, where, strict=True) if lo <= s and e <= hi)
    groups = [(inside(x, p, lo, hi), inside(y, q, lo, hi)) for lo, hi in zip([0, *ends], ends, strict=False)]
    return groups, [(i, j) for i, (s, e) in zip(x, p, strict=True) for j, (u, v) in zip(y, q, strict=True) if s < v and u < e]


WILD = st.text(st.sampled_from(list("aaabcdehinorst    \n\t'.,!-=<|>0123ABéßñ漢字🙂▁\x00\x1c\x85\xa0​́½²ﬁ")) | st.characters(blacklist_categories=["Cs"]), max_size=60)


@settings(max_examples=500, deadline=None)
@given(WILD | st.sampled_from(["<s> a</s> <unk>", "<0x0A> x", "<|endoftext|> b <|endoftext|>", " ", "  ", "a ", "a  ", " a", "\n b", "x\n  b", "a \n b  \n", "a\xa0 b", "a ​b"]))
def test_stretches_align_like_the_whole_text(text):
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(plain, "both"):
        a = Tokenizer.from_file(bpe.default_vocabulary())
        a.encode_special_tokens = True
        plain.both = a, sentencepiece.SentencePieceProcessor(model_file=token_align.default_pieces())
    using = token_align.encoders(bpe.default_vocabulary(), token_align.default_pieces())
    (found,) = using.texts([text])
    groups, links = plain(text, plain.both)
    if found is None:
        assert not groups
        return
    assert [(tuple(g["a"]), tuple(g["b"])) for g in token_align.groups(using.sides, found)] == groups
    assert Counter(token_align.align(using.sides, *found).codes.tolist()) == Counter(a << 32 | b for a, b in links)


def test_align():
    sides = tuple(token_align.Side({i: b"x" * n for i, n in enumerate(lengths)}) for lengths in ((1, 3, 2), (2, 1)))
    found = token_align.align(sides, np.array([0, 1, 2]), np.array([0, 0, 1, 1]))  # ends 1, 4, 6 and 2, 4, 5, 6
    assert found.last_a.tolist() == [1, 2] and found.last_b.tolist() == [1, 3]
    assert [(c >> 32, c & 0xFFFFFFFF) for c in found.codes.tolist()] == [(0, 0), (1, 0), (1, 0), (2, 1), (2, 1)]
    assert found.written()[0].tobytes() == b"0,1|0,0;2|1,1;"
    nothing = token_align.align(sides, np.zeros(0, int), np.zeros(0, int))
    assert not len(nothing.codes) and not len(nothing.last_a)


def brute(texts, both):
    each = [(i, *plain(t, both)) for i, t in texts]
    count = Counter(link for _, _, links in each for link in links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for i, groups, links in each:
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = hashlib.sha256(shown.encode()).hexdigest() if groups else ""
        out.append((i, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), digest))
    return sorted(out, key=repr), count


TEXTS = [(1, "Hello world, the station"), (2, None), (3, ""), (4, "hello  the\n\nstation was the the"), (4, "hello  the\n\nstation was the the"), (None, "a ▁ b"), (5, "漢字テスト" * 30), (6, "<|endoftext|> and <s>"), (7, "été à la gare 🙂🙂 ​"), (8, "x" * 500 + " y"), (9, " \n ")]


@pytest.mark.parametrize("most_sent", [token_align.MOST_SENT, 0])
def test_report_equals_all_pairs(docs_of, both, prose, most_sent):
    texts = TEXTS + [(i, prose(30)) for i in range(20, 40)]
    got = token_align.report(docs_of(texts), most_sent=most_sent)
    assert got.columns == token_align.COLUMNS
    want, count = brute(texts, both)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert {(r["a"], r["b"]): r["n"] for r in token_align.pair_counts(docs_of(texts)).collect()} == count
    assert token_align.report(docs_of([]), most_sent=most_sent).count() == 0


def test_long_texts_come_in_steps(monkeypatch, both, prose):
    """Small blocks and steps and a store that overflows give what large ones give."""
    monkeypatch.setattr(token_align, "AT_ONCE", 200)
    monkeypatch.setattr(token_align, "MEMORY", 40)
    monkeypatch.setattr(token_align, "TOKENS", 5)
    using = token_align.Encoders(bpe.default_vocabulary(), token_align.default_pieces())
    texts = [(1, prose(300)), (2, prose(5)), (3, prose(200) + " ▁ " + prose(50)), (4, "漢字" * 400 + " " + prose(100)), (5, None), (6, prose(30))]
    assert len(list(using.blocks(texts[0][1]))) > 3
    ids = list(using.texts([t for _, t in texts]))
    want, count = brute(texts, both)
    rows = [(i, *token_align._long(using.sides, x, lambda _: [0, 0])) if x else (i, *token_align.NOTHING) for (i, _), x in zip(texts, ids, strict=True)]
    assert sorted((*r[:5], r[7]) for r in rows) == sorted((*w[:5], w[7]) for w in want)
    links = Counter(c for x in ids if x for aligned in token_align.stepwise(using.sides, *x) for c in aligned.codes.tolist())
    assert {(c >> 32, c & 0xFFFFFFFF): n for c, n in links.items()} == count


def test_with_groups(spark, both):
    docs = spark.createDataFrame([(1, "the station", 5), (2, None, 6), (3, "a▁b", 7)], "doc_id long, text string, groups int")
    out = token_align.with_groups(docs)
    assert out.columns == ["doc_id", "text", "_groups", "groups"]
    got = {r["doc_id"]: [(tuple(g["a"]), tuple(g["b"])) for g in r["groups"]] for r in out.collect()}
    assert got == {1: plain("the station", both)[0], 2: [], 3: []}
