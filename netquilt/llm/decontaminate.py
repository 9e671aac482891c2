"""Benchmark decontamination by pigeonhole pieces and Myers' bit-parallel distance.

Texts and test items become word sequences (lower case, letters, digits and
``_`` only), so marks and line breaks don't hide a passage; in scripts that are
written without blanks each character counts as a word. An item of m words may
differ in k = m // 5 of them and is cut into k + 1 pieces: whatever k edits do,
one piece stays. An item of fewer than five words must stand in the text as it
is. Pieces are looked up in every text by hash and compared
word by word; around each hit, the edit distance of the item to the best
stretch of the text is computed with one machine-like word operation a text
word. The test items are read in blocks of bounded size.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: An item matches a stretch that differs in at most one word of five.
PER_EDIT = 5
#: Characters of test items that a task holds at once.
BLOCK_CHARS = 16_000_000
#: Letters written without blanks: Thai, Lao, Burmese, Khmer, kana and Han.
_SINGLE = "\u0e01-\u0e30\u0e40-\u0e46\u0e81-\u0eb0\u0ec0-\u0ec6\u1000-\u102a\u1780-\u17b3\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(rf"[{_SINGLE}]|(?:(?![{_SINGLE}])\w)+")
_MIX, _TABLE = np.uint64(0x9E3779B97F4A7C15), 20


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def budget(n_words: int) -> int:
    return n_words // PER_EDIT


def best_stretch(item: list[int], text: Iterable[int]) -> tuple[int, int]:
    """Least edit distance of ``item`` to a stretch of ``text``, and how many words of ``text`` precede its first such end."""
    masks: dict[int, int] = defaultdict(int)
    for i, w in enumerate(item):
        masks[w] |= 1 << i
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for at, w in enumerate(text, 1):
        x = masks.get(w, 0) | minus
        diag = (((x & plus) + plus) ^ plus) | x
        up, down = (minus | ~(diag | plus)) & full, plus & diag
        score += bool(up & top) - bool(down & top)
        up = up << 1 & full
        minus, plus = up & diag, (down << 1 | ~(up | diag)) & full
        if score < best:
            best, end = score, at
    return best, end


class Index:
    """Pieces of test items by hash."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        self.items: list[tuple[list[int], list[int]]] = []
        self.held: list[frozenset[int]] = []
        same: dict[tuple[int, ...], int] = {}
        self.pieces: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = {}
        for item_id, text in items:
            found = words(text)
            if not found:
                continue
            seq = [self.ids.setdefault(w, len(self.ids) + 1) for w in found]
            at = same.setdefault(tuple(seq), len(self.items))
            if at < len(self.items):  # items of equal words are looked for once
                self.items[at][0].append(item_id)
                continue
            cuts = [len(seq) * i // (budget(len(seq)) + 1) for i in range(budget(len(seq)) + 2)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                self.pieces.setdefault(hi - lo, {}).setdefault(tuple(seq[lo:hi]), []).append((len(self.items), lo))
            self.items.append(([item_id], seq))
            self.held.append(frozenset(seq))
        self.marks = {}
        for n, known in self.pieces.items():
            mark = self.marks[n] = np.zeros(1 << _TABLE, bool)
            mark[self._slots(np.array(list(known), np.uint64).T)] = True

    @staticmethod
    def _slots(columns: Iterable[np.ndarray]) -> np.ndarray:
        with np.errstate(over="ignore"):
            return reduce(lambda h, c: (h ^ c) * _MIX + (c << np.uint64(7)), columns, np.uint64(7)) * _MIX >> np.uint64(64 - _TABLE)

    def matches(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, int]]:
        """``(text number, item id, distance, item words, first word)`` of each text and item that match."""
        get, found, begin = self.ids.get, [], []
        for t in texts:
            begin.append(len(found))
            found += [get(w, 0) for w in words(t)]
            found.append(0)  # no piece has the number 0, so none spans two texts
        begin.append(len(found))
        seq = np.array(found, np.uint64)
        spans: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        starts = np.array(begin)
        for n, known in self.pieces.items():
            if len(seq) < n:
                continue
            slots = self._slots(seq[j : len(seq) - n + 1 + j] for j in range(n))
            for at in np.flatnonzero(self.marks[n][slots]).tolist():
                for item, offset in known.get(tuple(found[at : at + n]), ()):
                    doc = int(np.searchsorted(starts, at, side="right")) - 1
                    m = len(self.items[item][1])
                    first, k = at - offset, budget(m)
                    spans[doc, item].append((max(begin[doc], first - k), min(begin[doc + 1] - 1, first + m + k)))
        last, words_there = None, frozenset()
        for (doc, item), where in sorted(spans.items(), key=lambda s: (s[0][0], s[1][0], s[0][1])):
            ids, wanted = self.items[item]
            where.sort()
            best, at = len(wanted), 0
            lo, hi = where[0]
            for a, b in [*where[1:], (1 << 62, 0)]:
                if a <= hi:
                    hi = max(hi, b)
                    continue
                if (lo, hi) != last:
                    last, words_there = (lo, hi), frozenset(found[lo:hi])
                # a word that isn't there costs an edit, so most items that only share a piece end here
                if len(self.held[item] - words_there) <= budget(len(wanted)):
                    score, end = best_stretch(wanted, found[lo:hi])
                    if score < best:
                        best, at = score, lo + end - begin[doc]
                lo, hi = a, b
            if best <= budget(len(wanted)):
                for item_id in ids:
                    yield doc, item_id, best, len(wanted), max(0, at - len(wanted))


def blocks(items: Iterable[tuple[int, str]], most: int) -> Iterator[list[tuple[int, str]]]:
    """The test items one after another, in lists of ``most`` characters; an item of more than that stands alone."""
    held, chars = [], 0
    for item in items:
        if held and chars + len(item[1]) > most:
            yield held
            held, chars = [], 0
        held.append(item)
        chars += len(item[1])
    if held:
        yield held


def _blocks(items: DataFrame) -> Iterator[Broadcast]:
    """The test items in blocks of ``BLOCK_CHARS`` characters; the driver holds one block and one partition at a time."""
    items = items.select("item_id", "text").where("text is not null")
    some = False
    for block in blocks(map(tuple, items.toLocalIterator()), BLOCK_CHARS):
        some = True
        yield items.sparkSession.sparkContext.broadcast(block)
    if not some:
        yield items.sparkSession.sparkContext.broadcast([])


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, distance, n_words, at_word``: one row for each document row and test item that match.

    ``distance`` is the edit distance in words of the item to its best stretch
    of the text, ``at_word`` about where that begins, the first of equally good
    stretches. Documents without a match have no row. Null and empty texts match
    nothing, and so do items without a word; repeated rows and items each give
    their own rows; a null id stays null; extra columns are ignored; an empty
    table of documents or items gives an empty result. Texts are searched whole,
    some megabytes of them at a time.
    """

    def search(block: Broadcast) -> DataFrame:
        def work(rows: list[tuple], index: Index) -> list[tuple]:
            return [(rows[d][0], *rest) for d, *rest in index.matches([t for _, t in rows])]

        return map_rows(docs, ["doc_id", "text"], "doc_id long, item_id long, distance long, n_words long, at_word long", work, lambda: Index(block.value))

    return reduce(DataFrame.unionAll, map(search, _blocks(items)))


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` that match no test item, unchanged.

    Null and empty texts stay; repeated rows fare alike; without items all stay;
    an empty table gives an empty result.
    """
    names = docs.columns
    where = names.index("text")
    schema = docs.schema

    for block in _blocks(items):

        def work(rows: list[tuple], index: Index) -> list[tuple]:
            bad = {d for d, *_ in index.matches([r[where] for r in rows])}
            return [r for i, r in enumerate(rows) if i not in bad]

        docs = map_rows(docs, names, schema, work, lambda block=block: Index(block.value))
    return docs
