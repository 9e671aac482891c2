"""Secret scans with one deterministic automaton for all rules.

The rules are built from a few combinators, joined into one automaton with no
choice left (subset construction), minimised, and laid out as transition
arrays over classes of bytes. A batch of texts is one run of bytes; it is cut
into lanes behind byte pairs that bring every state back to the start, and all
lanes take a step at a time, so that each byte is read once for all rules. The
pass gives the ends of matches; the reversed rule finds each match's start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import map_rows

ALL = (1 << 256) - 1


def one_of(spec: str) -> tuple:
    """One byte out of ``spec``; ``a-z`` is a range."""
    mask, i = 0, 0
    while i < len(spec):
        lo, hi = spec[i], spec[i + 2] if spec[i + 1 : i + 2] == "-" and i + 2 < len(spec) else spec[i]
        for b in range(ord(lo), ord(hi) + 1):
            mask |= 1 << b
        i += 3 if lo != hi else 1
    return ("byte", mask)


def seq(*parts: tuple) -> tuple:
    return ("seq", parts)


def alt(*parts: tuple) -> tuple:
    return ("alt", parts)


def rep(part: tuple, least: int = 0, most: int | None = None) -> tuple:
    return ("rep", part, least, most)


def word(text: str, any_case: bool = False) -> tuple:
    return seq(*(one_of(c.lower() + c.upper() if any_case and c.isalpha() else c) for c in text))


def opt(part: tuple) -> tuple:
    return rep(part, 0, 1)


@dataclass(frozen=True)
class Rule:
    """Matches of ``form`` are leftmost and longest; those of fewer than ``least`` characters are dropped.

    With ``after``, only what follows its first character counts, less blanks
    and one quote.
    """

    kind: str
    form: tuple
    least: int = 1
    after: bytes = b""


_VALUE = "A-Za-z0-9+/_.=-"
_QUOTE, _BLANKS = opt(one_of("\"'")), rep(one_of(" "))
#: The rules that every scan has.
BASE = (
    Rule("assign", seq(alt(word("password", True), word("passwd", True), word("secret", True), word("token", True), seq(word("api", True), opt(one_of("_")), word("key", True))), _QUOTE, _BLANKS, one_of(":="), _BLANKS, _QUOTE, rep(one_of(_VALUE), 1)), 6, b":="),
    Rule("access", seq(word("AKIA"), rep(one_of("A-Z0-9"), 1)), 20),
    Rule("hex", rep(one_of("0-9a-f"), 24), 24),
)
#: Rules that this scan adds.
ADDED = (
    Rule("forge", seq(word("gh"), one_of("pousr"), word("_"), rep(one_of("A-Za-z0-9"), 1)), 40),
    Rule("chat", seq(word("xox"), one_of("abprs"), word("-"), rep(one_of("A-Za-z0-9-"), 1)), 15),
    Rule("private", seq(word("-----BEGIN "), rep(one_of("A-Z ")), word("PRIVATE KEY-----"))),
)
RULES = BASE + ADDED


class _Nfa:
    """States with free moves; sets of states are bit masks."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.move: list[tuple[int, int] | None] = []

    def state(self) -> int:
        self.free.append([])
        self.move.append(None)
        return len(self.free) - 1

    def add(self, form: tuple, at: int, back: bool = False) -> int:
        """Add ``form`` from state ``at``, reversed if ``back``; the state where it ends."""
        kind = form[0]
        if kind == "byte":
            end = self.state()
            self.move[at] = (form[1], end)
            return end
        if kind == "seq":
            for part in reversed(form[1]) if back else form[1]:
                at = self.add(part, at, back)
            return at
        if kind == "alt":
            end = self.state()
            for part in form[1]:
                begin = self.state()
                self.free[at].append(begin)
                self.free[self.add(part, begin, back)].append(end)
            return end
        _, part, least, most = form
        for _ in range(least):
            at = self.add(part, at, back)
        if most is None:
            loop = self.state()
            self.free[at].append(loop)
            begin, end = self.state(), self.state()
            self.free[loop] += [begin, end]
            self.free[self.add(part, begin, back)].append(loop)
            return end
        end = self.state()
        for _ in range(most - least):
            self.free[at].append(end)
            begin = self.state()
            self.free[at].append(begin)
            at = self.add(part, begin, back)
        self.free[at].append(end)
        return end

    def close(self) -> None:
        """Precompute what each state reaches by free moves."""
        self.reach = []
        for s in range(len(self.free)):
            seen, todo = {s}, [s]
            while todo:
                for n in self.free[todo.pop()]:
                    if n not in seen:
                        seen.add(n)
                        todo.append(n)
            self.reach.append(sum(1 << x for x in seen if self.move[x] or not self.free[x]))

    def masks(self) -> set[int]:
        return {m[0] for m in self.move if m}

    def step(self, states: int, byte: int) -> int:
        out = 0
        while states:
            low = states & -states
            states ^= low
            if (m := self.move[low.bit_length() - 1]) and m[0] >> byte & 1:
                out |= self.reach[m[1]]
        return out


def byte_classes(masks: set[int]) -> tuple[np.ndarray, list[int]]:
    """The class of each byte, and one byte of each class; the bytes of a class are in the same masks."""
    seen: dict[tuple, int] = {}
    of = [seen.setdefault(tuple(m >> b & 1 for m in sorted(masks)), len(seen)) for b in range(256)]
    return np.array(of, np.uint8), [of.index(c) for c in range(len(seen))]


class Automaton:
    """All rules in one minimal deterministic automaton."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        nfa = _Nfa()
        root = nfa.state()
        ends = []
        for rule in rules:
            begin = nfa.state()
            nfa.free[root].append(begin)
            ends.append(nfa.add(rule.form, begin))
        nfa.close()
        self.of, sample = byte_classes(nfa.masks())
        width, start = len(sample), nfa.reach[root]
        number, order, rows = {start: 0}, [start], []
        for states in order:  # grows while it runs
            row = []
            for b in sample:
                to = nfa.step(states, b) | start  # a match may begin anywhere
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        table = np.array(rows, np.int64)
        flags = np.array([sum(1 << k for k, e in enumerate(ends) if s >> e & 1) for s in order], np.uint16)
        part = np.zeros(len(table), np.int64)
        while True:  # states are equal until a step, or what it accepts, tells them apart
            finer = np.unique(np.column_stack([part, part[table], flags[table]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        pick = np.unique(part, return_index=True)[1]
        small = part[table[pick]]
        self.size, self.width = small.shape
        self.next = (small * width).astype(np.int32).ravel()
        self.flag = flags[table[pick]].ravel()  # what a step accepts
        self.root = int(part[0]) * width
        home = small.reshape(self.size, width)
        #: pairs of classes after which every state is the first one
        self.sync = np.array([[bool((home[home[:, a], b] == part[0]).all()) for b in range(width)] for a in range(width)])
        self.table = bytes(self.of.tolist())
        self.back = []
        for rule in rules:
            r = _Nfa()
            at = r.state()
            end = r.add(rule.form, at, True)
            r.close()
            self.back.append((r, r.reach[at], end, {}))

    def ends(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Positions just past a match, and the kinds whose match ended there, in one pass over ``data``.

        ``data`` ends with two newlines.
        """
        cls = np.frombuffer(data.translate(self.table), np.uint8)
        n = len(cls)
        safe = np.flatnonzero(self.sync[cls[:-1], cls[1:]]) + 2
        lanes = max(1, min(8192, n // 2048))
        want = np.arange(1, lanes) * (n // lanes)
        at = np.searchsorted(safe, want)
        begin = np.unique(np.r_[0, safe[at[at < len(safe)]]])
        begin = begin[begin < n]
        length = np.diff(np.r_[begin, n])
        order = np.argsort(-length, kind="stable")
        begin, length = begin[order], length[order]
        live = np.searchsorted(-length, -np.arange(length[0]), side="left")  # lanes longer than t
        state = np.full(len(begin), self.root, np.int32)
        was = np.zeros(len(begin), np.uint16)
        where, kinds = [], []
        for t, m in enumerate(live.tolist()):
            key = state[:m] + cls[begin[:m] + t]
            state[:m] = self.next[key]
            now = self.flag[key]
            over = was[:m] & ~now
            if over.any():
                hit = np.flatnonzero(over)
                where.append(begin[hit] + t)
                kinds.append(over[hit])
            was[:m] = now
        if not where:
            return np.empty(0, np.int64), np.empty(0, np.uint16)
        where, kinds = np.concatenate(where), np.concatenate(kinds)
        by = np.argsort(where, kind="stable")
        return where[by], kinds[by]

    def begin(self, kind: int, data: bytes, end: int, floor: int) -> int | None:
        """The leftmost start, at ``floor`` or later, of a match of ``kind`` that ends at ``end``."""
        nfa, states, accept, memo = self.back[kind]
        found = None
        for at in range(end - 1, floor - 1, -1):
            key = (states, data[at])
            if (to := memo.get(key)) is None:
                to = memo[key] = nfa.step(states, data[at])
            if not (states := to):
                break
            if states >> accept & 1:
                found = at
        return found


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...] = RULES) -> Automaton:
    return Automaton(rules)


def _long_enough(rule: Rule, match: bytes) -> bool:
    if rule.after:
        match = match[next(i for i, b in enumerate(match) if b in rule.after) + 1 :].lstrip(b" ")
        match = match[1:] if match[:1] in (b"'", b'"') else match
    return len(match) >= rule.least


def find_spans(texts: list[str | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its spans ``(start, end, kind)`` in code points, by start and then kind."""
    dfa = automaton(rules)
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n\n"
    offset = np.cumsum([0, *(len(r) + 1 for r in raw)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in raw]
    done: dict[tuple[int, int], int] = {}
    where, kinds = dfa.ends(data)
    for end, bits, doc in zip(where.tolist(), kinds.tolist(), (np.searchsorted(offset, where, side="left") - 1).tolist(), strict=True):
        base = int(offset[doc])
        for k in range(len(rules)):
            if bits >> k & 1:
                start = dfa.begin(k, data, end, done.get((doc, k), base))
                if start is None:
                    continue  # all its starts lie in the match before
                done[doc, k] = end
                if _long_enough(rules[k], data[start:end]):
                    out[doc].append((start - base, end - base, k))
    for doc, spans in enumerate(out):
        if spans and not raw[doc].isascii():
            at = sorted({p for s in spans for p in s[:2]})
            count, last, points = 0, 0, {}
            for p in at:
                count += len(raw[doc][last:p].decode("utf-8", "surrogatepass"))
                points[p], last = count, p
            spans[:] = [(points[s], points[e], k) for s, e, k in spans]
        spans.sort(key=lambda s: (s[0], s[2]))
    return out


def _named(spans: list[tuple[int, int, int]], rules: tuple[Rule, ...]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs``.

    A null text counts as empty and has no spans; a null doc_id stays null;
    repeated rows give equal rows; extra columns are ignored.
    """

    def work(rows: list[tuple]) -> list[tuple]:
        out = []
        for (i, _), spans in zip(rows, find_spans([t for _, t in rows]), strict=True):
            base = [s for s in spans if s[2] < len(BASE)]
            n = [sum(s[2] == k for s in base) for k in range(len(BASE))]
            out.append((i, *n, hashlib.sha256(_named(base, RULES).encode()).hexdigest(), _named(spans, RULES)))
        return out

    return map_rows(docs, ["doc_id", "text"], "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string", work)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for s, e, _ in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked and ``n_chars``, if there, brought up to date.

    Texts without secrets, null texts and all other columns stay as they are;
    repeated rows give equal rows; spans that overlap are masked as one; an
    empty table gives an empty result; texts are scanned whole.
    """
    names = docs.columns
    where, count = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def work(rows: list[tuple]) -> Iterator[tuple]:
        out = []
        for row, spans in zip(rows, find_spans([r[where] for r in rows]), strict=True):
            if spans:
                row = list(row)
                row[where] = masked(row[where], spans)
                if count is not None:
                    row[count] = len(row[where])
            out.append(tuple(row))
        return out

    return map_rows(docs, names, docs.schema, work)
