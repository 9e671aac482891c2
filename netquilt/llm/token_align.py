"""Alignment of two tokenizers' tokens over the same bytes.

A text is encoded twice. Each side has a dictionary from the byte offsets where
its tokens end to the tokens' places; the offsets that both have, in order, cut
the two id lists into groups, and inside a group every token links with those
of the other side whose bytes overlap its own. A table counts how often each
pair of ids is linked in the whole corpus. Offsets are small whole numbers, so
the dictionaries are arrays indexed by offset, filled for many texts at once.

No token of either vocabulary goes on from something else than white space into
a blank, so both encoders start anew where such a blank stands: a text is
encoded stretch by stretch, and workers remember stretches. (With a vocabulary
that has such a token each text is one stretch.)
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .bpe import byte_letters, default_vocabulary
from .common import map_rows, materialise, slices

#: Stretches that a worker remembers; the store starts anew when full. Longer ones than REMEMBERED characters are not kept.
MEMORY, REMEMBERED = 400_000, 64
#: Characters cut into stretches, and tokens aligned, at once, about.
AT_ONCE, TOKENS = 1 << 20, 1 << 19
#: Counted pairs that a task holds before it hands them on.
MOST_HELD = 1_000_000
#: Pairs of ids sent to every task at most, as sorted numbers of 17 bytes a pair; with more, links are joined with them.
MOST_SENT = 4_000_000

# A blank that follows something else and precedes anything at all starts a stretch.
_ODD = re.compile(r"\s | $")
_START = re.compile(r"(?<=\S) (?=.)", re.DOTALL)
_INTO_BLANK = re.compile(r"\S ")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Side:
    """The ids of one tokenizer: their bytes, and their digits as characters."""

    def __init__(self, text: dict[int, bytes]):
        n = max(text) + 1
        self.text = [text.get(i, b"") for i in range(n)]
        self.bytes = np.array(list(map(len, self.text)), np.int64)
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        shown = [str(i).encode() for i in range(n)]
        self.width = np.array(list(map(len, shown)), np.int64)
        wide = len(shown[-1])
        self.digits = np.frombuffer(b"".join(s.ljust(wide, b"\0") for s in shown), np.uint8).reshape(n, wide)


class Encoders:
    """Both tokenizers, and the ids of the stretches met so far."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte_of = {c: n for n, c in enumerate(byte_letters())}
        with open(a_path, encoding="utf-8") as f:
            vocab: dict[str, int] = json.load(f)["model"]["vocab"]
        self.sides = (
            Side({i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}),
            Side({i: bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, self.b.id_to_piece(i)) for i in range(len(self.b)))}),
        )
        #: Whether texts can be cut into stretches.
        self.cuts = not any(_INTO_BLANK.search(t.decode(errors="replace")) for s in self.sides for t in s.text)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.sound = np.zeros(0, bool)
        self.ids = [np.zeros(0, s.kind) for s in self.sides]
        self.first = [np.zeros(1, np.int64) for _ in self.sides]

    def blocks(self, text: str | None) -> Iterator[list[str]]:
        """A blank and the text in stretches, block by block; nothing for no text."""
        if not text:
            return
        text = " " + text
        if not self.cuts:
            yield [text]
            return
        at, n = 0, len(text)
        while at < n:
            end = n
            if n - at > AT_ONCE and (found := _START.search(text, at + AT_ONCE)):
                end = found.start()
            part = text[at:end]
            if _ODD.search(part) is None:
                yield [" " + w for w in part[1:].split(" ")]
            else:
                starts = [0, *(m.start() for m in _START.finditer(part))]
                yield [part[i:j] for i, j in zip(starts, [*starts[1:], len(part)], strict=True)]
            at = end

    def learn(self, new: list[str]) -> None:
        """Encode stretches, each of which begins with a blank; sound are those whose bytes both sides give back."""
        found = ([e.ids for e in self.a.encode_batch_fast(new, add_special_tokens=False)], self.b.encode([s[1:] for s in new], num_threads=1))
        self.known |= zip(new, range(len(self.known), len(self.known) + len(new)), strict=True)
        whole = [s.encode() for s in new]
        sound = np.ones(len(new), bool)
        for k, (side, ids) in enumerate(zip(self.sides, found, strict=True)):
            flat = list(chain.from_iterable(ids))
            text, ends = b"".join(map(side.text.__getitem__, flat)), np.cumsum([len(x) for x in ids])
            if text != b"".join(whole):  # rare: look for the stretches that differ
                sound &= [b"".join(map(side.text.__getitem__, x)) == w for x, w in zip(ids, whole, strict=True)]
            self.ids[k] = np.concatenate([self.ids[k], np.array(flat, side.kind)])
            self.first[k] = np.concatenate([self.first[k], self.first[k][-1] + ends])
        self.sound = np.concatenate([self.sound, sound])

    def encode(self, texts: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each list of stretches; None where a side's bytes differ."""
        new = list({s for t in texts for s in t} - self.known.keys())
        short, long = [s for s in new if len(s) <= REMEMBERED], [s for s in new if len(s) > REMEMBERED]
        if len(self.known) + len(short) > MEMORY:
            self.clear()
            met = {s for t in texts for s in t}
            short = [s for s in met if len(s) <= REMEMBERED]
        if short:
            self.learn(short)
        kept = (len(self.known), [len(x) for x in self.ids])
        if long:
            self.learn(long)
        at = np.fromiter((self.known[s] for t in texts for s in t), np.int64)
        ends = np.cumsum([0, *map(len, texts)])
        sound = np.concatenate([[0], np.cumsum(~self.sound[at])])[ends]
        sides = []
        for ids, first in zip(self.ids, self.first, strict=True):
            sizes = first[at + 1] - first[at]
            upto = np.concatenate([[0], np.cumsum(sizes)])
            sides.append(np.split(ids[np.repeat(first[at] - upto[:-1], sizes) + np.arange(upto[-1])], upto[ends[1:-1]]))
        if long:
            n, sizes = kept
            for s in long:
                del self.known[s]
            self.sound, self.first = self.sound[:n], [f[: n + 1] for f in self.first]
            self.ids = [x[:k] for x, k in zip(self.ids, sizes, strict=True)]
        return [(a, b) if x == y and len(a) else None for a, b, x, y in zip(*sides, sound, sound[1:], strict=False)]

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both sides for each whole text; None if it has no tokens."""
        held: list[list[str]] = []
        chars = 0
        for text in texts:
            if text and len(text) > AT_ONCE:
                yield from self.encode(held) if held else ()
                held, chars = [], 0
                parts = [self.encode([block])[0] for block in self.blocks(text)]
                yield None if None in [p and 1 for p in parts] else tuple(np.concatenate(x) for x in zip(*parts, strict=True))
                continue
            held.append(next(self.blocks(text), []))
            chars += len(text or "")
            if chars > AT_ONCE:
                yield from self.encode(held)
                held, chars = [], 0
        yield from self.encode(held) if held else ()


@lru_cache(maxsize=1)
def encoders(a_path: str, b_path: str) -> Encoders:
    """The encoders of this worker; they last from task to task."""
    return Encoders(a_path, b_path)


@dataclass
class Alignment:
    """Tokens ``a`` and ``b`` over the same bytes; ``last_a`` and ``last_b`` are the places of the last token of each group."""

    sides: tuple[Side, Side]
    a: np.ndarray
    b: np.ndarray
    end_a: np.ndarray
    end_b: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray

    @cached_property
    def fans(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token of A the place of the first token of B that it links with, and how many it does."""
        start = self.end_a - self.sides[0].bytes[self.a]
        lo, hi = np.searchsorted(self.end_b, start, "right"), np.searchsorted(self.end_b, self.end_a, "left")
        return lo, hi - lo + 1

    @cached_property
    def codes(self) -> np.ndarray:
        """All links, in the order of A's tokens: A's id in the upper and B's in the lower half of a number."""
        lo, n = self.fans
        upto = np.cumsum(n)
        at = np.repeat(lo - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)
        return np.repeat(self.a.astype(np.int64) << 32, n) | self.b[at].astype(np.int64)

    def written(self) -> tuple[np.ndarray, np.ndarray]:
        """Groups as digits, ``a1,a2|b1;`` each, and where each group ends."""
        groups = np.arange(len(self.last_a))
        size_a, size_b = np.diff(self.last_a, prepend=-1), np.diff(self.last_b, prepend=-1)
        n = len(self.a) + len(self.b)
        wide = max(s.digits.shape[1] for s in self.sides) + 1
        chars, widths = np.zeros((n, wide), np.uint8), np.zeros(n, np.int64)
        before_a, before_b = np.cumsum(size_a), np.cumsum(size_b) - size_b
        for side, ids, size, shift, last, mark in ((self.sides[0], self.a, size_a, before_b, self.last_a, b"|"), (self.sides[1], self.b, size_b, before_a, self.last_b, b";")):
            at = np.arange(len(ids)) + shift[np.repeat(groups, size)]
            chars[at, : side.digits.shape[1]] = side.digits[ids]
            width = side.width[ids]
            chars[at, width] = ord(",")
            chars[at[last], width[last]] = ord(mark)
            widths[at] = width + 1
        return chars[chars > 0], np.cumsum(widths)[self.last_a + self.last_b + 1] if n else widths


def align(sides: tuple[Side, Side], a: np.ndarray, b: np.ndarray) -> Alignment:
    """Align the ids of two tokenizers over the same bytes."""
    end_a, end_b = (np.cumsum(s.bytes[x]) for s, x in zip(sides, (a, b), strict=True))
    at_a, at_b = (np.full(int(end_a[-1]) + 1 if len(end_a) else 1, -1, np.int32) for _ in "ab")  # from end to place
    at_a[end_a], at_b[end_b] = np.arange(len(a)), np.arange(len(b))
    shared = np.flatnonzero((at_a >= 0) & (at_b >= 0))
    return Alignment(sides, a, b, end_a, end_b, at_a[shared], at_b[shared])


def stepwise(sides: tuple[Side, Side], a: np.ndarray, b: np.ndarray) -> Iterator[Alignment]:
    """``align`` for id lists of any length, some groups after others."""
    i, j, step = 0, 0, TOKENS
    while i < len(a):
        x, y = a[i : i + step], b[j : j + step]
        if i + step >= len(a) and j + step >= len(b):
            yield align(sides, x, y)
            return
        # up to the last end that both have
        end_x, end_y = np.cumsum(sides[0].bytes[x]), np.cumsum(sides[1].bytes[y])
        _, u, v = np.intersect1d(end_x, end_y, assume_unique=True, return_indices=True)
        if not len(u):
            step *= 2
            continue
        yield align(sides, x[: u[-1] + 1], y[: v[-1] + 1])
        i, j, step = i + int(u[-1]) + 1, j + int(v[-1]) + 1, TOKENS


class Texts:
    """Several whole texts aligned together; a number for each text comes out of any running total."""

    def __init__(self, sides: tuple[Side, Side], texts: list[tuple[np.ndarray, np.ndarray]]):
        a, b = (np.concatenate(x) for x in zip(*texts, strict=True))
        self.aligned = align(sides, a, b)
        self.n = [np.array([len(t[k]) for t in texts]) for k in (0, 1)]
        self.upto_a = np.cumsum(self.n[0])
        self.groups = np.searchsorted(self.aligned.last_a, self.upto_a - 1, "right")
        self.links = np.concatenate([[0], np.cumsum(self.aligned.fans[1])])[self.upto_a]

    def each(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value for each link, text by text."""
        return np.diff(np.concatenate([[0], np.cumsum(values)])[self.links], prepend=0)

    def digests(self) -> list[str]:
        chars, ends = self.aligned.written()
        data, cuts = chars.tobytes(), [0, *ends[self.groups - 1].tolist()]
        return [hashlib.sha256(data[i : j - 1]).hexdigest() for i, j in zip(cuts, cuts[1:], strict=False)]


def together(sides: tuple[Side, Side], rows: list[tuple]) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]]]]:
    """Ids of rows ``(.., a, b)`` that have tokens, with the rows' places, about ``TOKENS`` at once."""
    held, where, n = [], [], 0
    for at, row in enumerate(rows):
        if not row[-1]:
            continue
        held.append(tuple(np.frombuffer(x, s.kind) for x, s in zip(row[-2:], sides, strict=True)))
        where.append(at)
        n += len(held[-1][0])
        if n > TOKENS:
            yield where, held
            held, where, n = [], [], 0
    if held:
        yield where, held


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``doc_id, a, b``: ids as packed numbers; null for texts without tokens."""

    def work(rows: list[tuple], using: Encoders) -> list[tuple]:
        return [(i, *((x.tobytes() for x in found) if found else (None, None))) for (i, _), found in zip(rows, using.texts([t for _, t in rows]), strict=True)]

    return map_rows(docs, ["doc_id", "text"], "doc_id long, a binary, b binary", work, lambda: encoders(a_path, b_path))


def counted(ids: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``a, b, n``: how many links of all ``encoded`` rows together link two ids; each task adds up its own first."""

    def merged(parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts)
        order = np.argsort(rows[:, 0], kind="stable")
        rows = rows[order]
        edge = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
        return np.stack([rows[edge, 0], np.add.reduceat(rows[:, 1], edge)], axis=1) if len(rows) else rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = encoders(a_path, b_path).sides
        parts = [np.zeros((0, 2), np.int64)]

        def rows() -> pa.RecordBatch:
            found = merged(parts)
            del parts[1:]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (found[:, 0] >> 32, found[:, 0] & 0xFFFFFFFF, found[:, 1])], names=["a", "b", "n"])

        for batch in batches:
            for part in slices(batch):
                for _, texts in together(sides, part):
                    for aligned in stepwise(sides, *(np.concatenate(x) for x in zip(*texts, strict=True))):
                        parts.append(np.stack(np.unique(aligned.codes, return_counts=True), axis=1))
                    if sum(map(len, parts)) > MOST_HELD:
                        parts[1:] = [merged(parts)]
                        if len(parts[1]) > MOST_HELD // 2:
                            yield rows()
        yield rows()

    return ids.select("a", "b").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``a, b, n``: how many links of all texts together link the two ids.

    Texts that are null or empty or whose bytes a tokenizer changes have no
    links; repeated rows count each time; an empty table gives no rows; texts
    are read whole; other columns are ignored.
    """
    a_path, b_path = a_path or default_vocabulary(), b_path or default_pieces()
    return counted(encoded(docs, a_path, b_path), a_path, b_path)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
SCHEMA = ", ".join(f"{c} {'string' if c == COLUMNS[-1] else 'long'}" for c in COLUMNS)
#: What a text without tokens has.
NOTHING = (0, 0, 0, 0, 0, 0, "")


def report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most_sent: int = MOST_SENT) -> DataFrame:
    """``COLUMNS`` for each row of ``docs``: sizes of its alignment, and how its links stand in the corpus.

    The ids are written once; one pass over them counts pairs, another looks
    the links up. Up to ``most_sent`` pairs go to every task; with more, each
    text's links are joined with the table of pairs. A text that is null or
    empty or whose bytes a tokenizer changes has zeros and an empty digest; a
    null doc_id stays null; repeated rows give equal rows and count each time;
    an empty table gives an empty result; texts are read whole, a very long one
    in steps; ties for the best count all count as best; extra columns are
    ignored.
    """
    a_path, b_path = a_path or default_vocabulary(), b_path or default_pieces()
    ids = materialise(encoded(docs, a_path, b_path), "ids")
    pairs = materialise(counted(ids, a_path, b_path), "pairs")
    best = pairs.groupBy("b").agg(F.max("n").alias("most"))  # a row an id at most
    pairs = pairs.join(F.broadcast(best), "b").select((F.shiftleft("a", 32) + F.col("b")).alias("code"), "n", (F.col("n") == F.col("most")).alias("best"))
    if pairs.count() > most_sent:
        return _joined(ids, pairs, a_path, b_path)
    held = pairs.toArrow()
    code, n, is_best = (held.column(i).to_numpy() for i in range(3))
    order = np.argsort(code)
    sent = docs.sparkSession.sparkContext.broadcast((code[order], n[order], is_best[order].astype(np.int8)))

    def work(rows: list[tuple], sides: tuple[Side, Side]) -> list[tuple]:
        code, n, best = sent.value
        out = [(r[0], *NOTHING) for r in rows]
        for where, texts in together(sides, rows):
            if len(texts) == 1 and len(texts[0][0]) > TOKENS:
                out[where[0]] = (rows[where[0]][0], *_long(sides, texts[0], lambda x: (at := np.searchsorted(code, x), [int(best[at].sum()), int(n[at].sum())])[1]))
                continue
            found = Texts(sides, texts)
            at = np.searchsorted(code, found.aligned.codes)
            cols = (*found.n, np.diff(found.groups, prepend=0), np.diff(found.links, prepend=0), found.each(best[at].astype(np.int64)), found.each(n[at]))
            for i, *numbers, digest in zip(where, *(c.tolist() for c in cols), found.digests(), strict=True):
                out[i] = (rows[i][0], *numbers, digest)
        return out

    return map_rows(ids, ["doc_id", "a", "b"], SCHEMA, work, lambda: encoders(a_path, b_path).sides)


def _long(sides: tuple[Side, Side], text: tuple[np.ndarray, np.ndarray], look: Callable) -> tuple:
    """The row of one long text, in steps; ``look`` gives two sums over codes."""
    groups, links, sums, sha = 0, 0, np.zeros(2, object), hashlib.sha256()
    for aligned in stepwise(sides, *text):
        data = aligned.written()[0].tobytes()
        sha.update((b";" if groups else b"") + data[:-1])
        groups += len(aligned.last_a)
        links += len(aligned.codes)
        sums += look(aligned.codes)
    return len(text[0]), len(text[1]), groups, links, *map(int, sums), sha.hexdigest()


def _joined(ids: DataFrame, pairs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """``report`` with the links of every text joined with ``pairs(code, n, best)``."""
    numbered = materialise(ids.withColumn("row", F.monotonically_increasing_id()), "numbered")

    def codes(rows: list[tuple], sides: tuple[Side, Side]) -> list[tuple]:
        out = []
        for where, texts in together(sides, rows):
            for i, text in zip(where, texts, strict=True):
                for aligned in stepwise(sides, *text):
                    out += [(rows[i][0], *x) for x in zip(*(c.tolist() for c in np.unique(aligned.codes, return_counts=True)), strict=True)]
        return out

    def sizes(rows: list[tuple], sides: tuple[Side, Side]) -> list[tuple]:
        out = [(*r[:2], *NOTHING[:4], "") for r in rows]
        for where, texts in together(sides, rows):
            for i, text in zip(where, texts, strict=True):
                *numbers, _, _, digest = _long(sides, text, lambda _: [0, 0])
                out[i] = (*rows[i][:2], *numbers, digest)
        return out

    setup = lambda: encoders(a_path, b_path).sides
    links = map_rows(numbered, ["row", "a", "b"], "row long, code long, times long", codes, setup)
    sums = links.join(pairs.hint("merge"), "code").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    rows = map_rows(numbered, ["row", "doc_id", "a", "b"], "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string", sizes, setup)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return rows.join(sums.hint("merge"), "row", "left").withColumns({c: zero(c) for c in ("n_best", "count_sum")}).select(*COLUMNS)


def with_groups(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``docs`` with ``groups``: the ids of both tokenizers between the offsets where tokens of both end.

    A column ``groups`` that is there already gets underscores in front. Texts
    without tokens, as in ``report``, have an empty list; other cases as there.
    """
    a_path, b_path = a_path or default_vocabulary(), b_path or default_pieces()
    side = ArrayType(IntegerType())
    taken, fields = {*docs.columns, "groups"}, []
    for f in docs.schema:
        name = f.name
        while name == "groups" or name != f.name and name in taken:
            name = f"_{name}"
        taken.add(name)
        fields.append(StructField(name, f.dataType, f.nullable))
    made = StructField("groups", ArrayType(StructType([StructField("a", side), StructField("b", side)])))
    where = docs.columns.index("text")

    def work(rows: list[tuple], using: Encoders) -> list[tuple]:
        return [(*r, groups(using.sides, found)) for r, found in zip(rows, using.texts([r[where] for r in rows]), strict=True)]

    return map_rows(docs, docs.columns, StructType([*fields, made]), work, lambda: encoders(a_path, b_path))


def groups(sides: tuple[Side, Side], found: tuple[np.ndarray, np.ndarray] | None) -> list[dict[str, list[int]]]:
    """The groups of one text as lists of ids."""
    out = []
    for x in stepwise(sides, *found) if found else ():
        cuts = zip(np.split(x.a, x.last_a[:-1] + 1), np.split(x.b, x.last_b[:-1] + 1), strict=True)
        out += [{"a": a.tolist(), "b": b.tolist()} for a, b in cuts]
    return out
