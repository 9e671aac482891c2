import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netquilt.llm import bpe

PATH = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bpe.transducer(PATH)


WILD = st.text(st.sampled_from(list("aaabcdehinorst  \n\t'.,!-=<|>0123ABéßñ漢字🙂\x1c\x85\xa0​́½²")) | st.characters(blacklist_categories=["Cs"]), max_size=80)


@settings(max_examples=400, deadline=None)
@given(WILD)
def test_ids_and_text_equal_the_library(text):
    lib, own = Tokenizer.from_file(PATH) if not hasattr(test_ids_and_text_equal_the_library, "lib") else test_ids_and_text_equal_the_library.lib, bpe.transducer(PATH)
    test_ids_and_text_equal_the_library.lib = lib
    ids = lib.encode(text, add_special_tokens=False).ids
    assert own.ids(text) == ids
    assert "".join(own.decode(iter([ids]))) == lib.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", ["a" * 30_000, "-" * 20_000, "ab" * 9_000, " " * 20_000, "漢" * 5_000, "<|endoftext|>" * 3 + "x<|endoftext|", "thetionabc" * 3_000])
def test_long_runs(library, ours, text):
    assert ours.ids(text) == library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=40))
def test_any_ids_decode_like_the_library(ids):
    own = bpe.transducer(PATH)
    lib = Tokenizer.from_file(PATH)
    parts = [ids[:7], ids[7:]]
    assert "".join(own.decode(iter(parts))) == lib.decode(ids, skip_special_tokens=False)


def test_emitted_tokens_never_change(ours):
    """What is stable by the lookahead is what the whole run gives."""
    text = ("the" * 50 + "ationalize" * 40).encode() * 4
    whole = list(ours.stream(text))
    for cut in range(ours.lookahead + 200, len(text), 377):
        part, at, stable = list(ours.stream(text[:cut])), 0, []
        for t in part:
            at += len(ours.bytes[t])
            if at > cut - ours.lookahead:
                break
            stable.append(t)
        assert whole[: len(stable)] == stable


def test_digests(docs_of, library):
    texts = [(1, "Hello world"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "word " * 30_000)]
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(docs_of(texts)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == want
    assert bpe.encode_digests(docs_of([]).limit(0)).count() == 0


def test_pieces_are_forgotten_when_full(monkeypatch, library):
    monkeypatch.setattr(bpe, "MEMORY", 5)
    monkeypatch.setattr(bpe, "PAIRS", 5)
    own = bpe.Transducer(PATH)
    text = "the station was there and antidisestablishmentarianism " * 3
    assert own.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_with_tokens_keeps_columns(docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    out = bpe.with_tokens(docs)
    assert out.columns == [*docs.columns, "n_tokens", "token_ids", "round_trip"]
    assert all(r["round_trip"] and len(r["token_ids"]) == r["n_tokens"] for r in out.collect())


def test_short_pieces_take_the_same_ids_in_fewer_steps():
    """Short pieces go by their longest tokens: the ids of the transducer, without its step for each byte and token end."""
    import random
    import sys

    made = bpe.Transducer(PATH)
    rnd, tokens = random.Random(5), [t for t in made.spelled if len(t) < 12]
    pieces = [bytes(rnd.choice(b"aein rs") for _ in range(rnd.randrange(1, 40))) for _ in range(500)]
    pieces += [b"".join(rnd.choices(tokens, k=rnd.randrange(1, 5))) for _ in range(500)]
    pieces += [(rnd.choice(tokens) * 20)[: rnd.randrange(1, 64)] for _ in range(500)]
    pieces += [bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 20))) for _ in range(300)]
    assert [made.short(p) for p in pieces] == [list(made.stream(p)) for p in pieces]

    def lines(work):
        n = 0

        def count(frame, event, arg):
            nonlocal n
            n += event == "line"
            return count

        before = sys.gettrace()
        sys.settrace(count)
        try:
            work()
        finally:
            sys.settrace(before)
        return n

    words = [f" {w}" for w in ("underestimation", "tionreing", "thermodynamically", "sterreanth", "andofing")]
    assert 4 * lines(lambda: [made.known[w] for w in words]) < 3 * lines(lambda: [list(made.stream(w.encode())) for w in words])
