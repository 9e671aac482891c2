"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

Reading bytes from left to right, the transducer keeps, for each position, the
last token of the prefix that ends there. A token may end a prefix only if it
is compatible with the last token before it, that is if the two encode to
themselves side by side; exactly one is. Bytes further on can change a token
only through a chain of earlier merges, and the merge list bounds how far such
a chain reaches (``lookahead``). A token that ends that far back is stable and
is emitted, so a run of any length needs memory for the lookahead only.

Decoding maps ids to bytes and bytes to text with an incremental state
machine that carries at most three bytes of an unfinished character.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, islice

import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import map_rows

# How byte-level vocabularies split text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""

# The same split for texts whose characters are all in SIMPLE, where letters, digits and white space are short ranges.
_LETTER, _SPACE = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", r" \t-\r"
SIMPLE = re.compile(r"[^\x00-\x7f\u00c0-\u024f]")
SIMPLE_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[0-9]+| ?[^{_SPACE}{_LETTER}0-9]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")

#: Pieces whose ids a worker remembers; the store starts anew when full.
MEMORY = 400_000
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 500_000
#: Bytes of a piece that is encoded by its longest tokens.
SHORT = 64
#: Bytes read between two emissions of a long run.
STRIDE = 4_096


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Transducer:
    """Encoder and decoder of one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.text = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text |= {i: t.encode() for t, i in self.special.items()}
        self.bytes = [self.text.get(i, b"") for i in range(max(self.text) + 1)]
        self.first = [vocab[c] for c in byte_letters()]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (vocab[t] for t in (pair.split(" ") if isinstance(pair, str) else pair))
            made = vocab[(pair.replace(" ", "") if isinstance(pair, str) else "".join(pair))]
            self.rank[a, b] = (r, made)
            self.parts.setdefault(made, (a, b))
        self.born = [-1] * len(self.bytes)
        for r, made in self.rank.values():
            self.born[made] = r
        self.spelled = {self.text[made]: made for made in {*self.first, *self.parts}}
        self.reach: dict[bytes, int] = {}  # longest token that begins with three bytes
        for data in self.spelled:
            self.reach[data[:3]] = max(len(data), self.reach.get(data[:3], 0))
        self.longest = max(map(len, self.text.values()))
        self.lookahead = self._lookahead()
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = _Pieces(self)
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}

    @cached_property
    def trie(self) -> dict:
        """Tokens by their bytes from the last to the first; only long pieces take it."""
        top: dict = {}
        for data, made in self.spelled.items():
            node = top
            for b in reversed(data):
                node = node.setdefault(b, {})
            node[-1] = made
        return top

    def _lookahead(self) -> int:
        """How many bytes after a token can decide whether it stays.

        A merge (u, v) is undone only by an earlier merge (y, x) whose y ends
        where v ends, so y is v or lies on its right edge; that merge in turn
        depends on what may happen at the right edge of x. Going through the
        merges by rank, ``reach[y]`` is the most bytes that a merge of y with
        its right neighbour takes or depends on.
        """
        reach: dict[int, int] = {}

        def edge(token: int) -> Iterator[int]:
            yield token
            while token in self.parts:
                token = self.parts[token][1]
                yield token

        for (y, x), _ in sorted(self.rank.items(), key=lambda kv: kv[1][0]):
            far = len(self.text[x]) + max(reach.get(z, 0) for z in edge(x))
            if far > reach.get(y, 0):
                reach[y] = far
        return max((max(reach.get(z, 0) for z in edge(t)) for t in self.parts), default=0)

    def merged(self, tokens: list[int]) -> list[int]:
        """Apply the merges by rank until none applies; for a few tokens only."""
        rank = self.rank
        while len(tokens) > 1:
            best = min((rank.get(p, (1 << 60, 0)) for p in zip(tokens, tokens[1:], strict=False)), default=(1 << 60, 0))
            if best[0] == 1 << 60:
                break
            out, i = [], 0
            while i < len(tokens):
                if i + 1 < len(tokens) and rank.get((tokens[i], tokens[i + 1])) == best:
                    out.append(best[1])
                    i += 2
                else:
                    out.append(tokens[i])
                    i += 1
            tokens = out
        return tokens

    def _compatible(self, a: int, b: int) -> bool:
        """Whether ``a`` then ``b`` encode to themselves.

        Goes back in time from the finished pair: ``y`` and ``x`` are what
        touches at the border, each until the merge that takes it into its
        token. A merge of the two that comes first spoils the pair; of equal
        merges the one on the left comes first.
        """
        if (got := self.fits.get((a, b))) is None:
            if len(self.fits) >= PAIRS:
                self.fits.clear()
            rank, born, parts = self.rank, self.born, self.parts
            y, x, y_end, x_end, got = a, b, 1 << 60, 1 << 60, True
            while True:
                if (over := rank.get((y, x))) and over[0] < y_end and over[0] <= x_end:
                    got = False
                    break
                if born[y] > born[x]:
                    y, y_end = parts[y][1], born[y]
                elif born[x] >= 0:
                    x, x_end = parts[x][0], born[x]
                else:
                    break
            self.fits[a, b] = got
        return got

    def _alone(self, a: int) -> bool:
        if (got := self.whole.get(a)) is None:
            got = self.whole[a] = self.merged([self.first[c] for c in self.bytes[a]]) == [a]
        return got

    def short(self, data: bytes) -> list[int]:
        """Ids of a short piece, the same as those of ``stream``.

        Takes the longest token that is compatible with the last one. Where
        none is, no encoding goes through that place, and the last token
        gives way to a shorter one.
        """
        spelled, fits, reach, n = self.spelled, self.fits, self.reach, len(data)
        out, starts, closed = [], [], set()
        before, at, end = -1, 0, min(n, reach.get(data[:3], 2))
        while at < n:
            while end > at:
                if (token := spelled.get(data[at:end])) is not None and end not in closed:
                    if (fit := fits.get((before, token))) is None:
                        fit = self._compatible(before, token) if before >= 0 else self._alone(token)
                    if fit:
                        break
                end -= 1
            if end > at:
                out.append(token)
                starts.append(at)
                before, at = token, end
                end = min(n, at + reach.get(data[at : at + 3], 2))
            else:
                closed.add(at)
                out.pop()
                before, at, end = out[-1] if out else -1, starts.pop(), at - 1
        return out

    def stream(self, data: bytes) -> Iterator[int]:
        """Ids of one piece of text, each emitted once it is stable.

        ``last[i - base]`` is the last token of the prefix of i bytes. Positions
        before the emitted part and the longest token are forgotten.
        """
        base, done, last = 0, 0, [-1]
        trie, bytes_, n = self.trie, self.bytes, len(data)
        fits = self.fits
        for end in range(1, n + 1):
            node, at, found = trie, end, []
            while at > done and (node := node.get(data[at - 1])) is not None:
                at -= 1
                if -1 in node:
                    found.append((node[-1], at))
            while found:
                token, at = found.pop()
                before = last[at - base]
                if before < 0:
                    fit = self._alone(token)
                elif (fit := fits.get((before, token))) is None:
                    fit = self._compatible(before, token)
                if fit:
                    last.append(token)
                    break
            else:
                last.append(-2)  # no encoding ends here
            if end % STRIDE == 0 and end < n:
                # what ends further back than the lookahead can't change any more
                chain, at = [], end
                while at > done:
                    token = last[at - base]
                    if at <= end - self.lookahead:
                        chain.append(token)
                    at -= len(bytes_[token])
                yield from reversed(chain)
                if chain:
                    done += sum(len(bytes_[t]) for t in chain)
                    if done - base > self.longest:
                        keep = done - self.longest
                        last, base = last[keep - base :], keep
        chain, at = [], n
        while at > done:
            chain.append(last[at - base])
            at -= len(bytes_[chain[-1]])
        yield from reversed(chain)

    def encode(self, text: str) -> Iterator[list[tuple[str, tuple[int, ...]]]]:
        """Ids of a whole text, in blocks of pieces; each piece also has its ids as digits."""
        known = self.known
        for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if i % 2:
                yield [(str(self.special[part]), (self.special[part],))]
                continue
            split = self.split if SIMPLE.search(part) else SIMPLE_SPLIT
            if len(part) < 1 << 16:
                if part:
                    yield [known[p] for p in split.findall(part)]
            else:
                found = (m.group() for m in split.finditer(part))
                while block := [known[p] for p in islice(found, 4096)]:
                    yield block

    def ids(self, text: str) -> list[int]:
        return [i for block in self.encode(text) for _, ids in block for i in ids]

    def decode(self, blocks: Iterator[list[int]]) -> Iterator[str]:
        """Text of the ids; a byte that is no character becomes U+FFFD."""
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in blocks:
            yield state.decode(b"".join(map(self.bytes.__getitem__, ids)))
        yield state.decode(b"", True)


class _Pieces(dict):
    """Pieces met before, each with its ids as digits and as numbers; long pieces aren't remembered."""

    def __init__(self, bpe: Transducer):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, text: str) -> tuple[str, tuple[int, ...]]:
        data = text.encode("utf-8", "surrogatepass")
        ids = tuple(self.bpe.short(data) if len(data) <= SHORT else self.bpe.stream(data))
        made = (",".join(map(str, ids)), ids)
        if len(text) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[text] = made
        return made


@lru_cache(maxsize=2)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_digest(text: str | None, bpe: Transducer) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text."""
    n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

    def counted() -> Iterator[list[int]]:
        nonlocal n
        for block in bpe.encode(text or ""):
            ids = list(chain.from_iterable([p[1] for p in block]))
            ids_hash.update((("," if n else "") + ",".join([p[0] for p in block])).encode())
            n += len(ids)
            yield ids

    for decoded in bpe.decode(counted()):
        text_hash.update(decoded.encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest()


def encode_digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row of ``docs``.

    A null text counts as empty: no ids, digests of the empty string. Rows that
    repeat give equal rows; a null doc_id stays null; extra columns are ignored.
    """
    path = vocabulary or default_vocabulary()
    return map_rows(
        docs,
        ["doc_id", "text"],
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
        lambda rows, bpe: [(i, *token_digest(t, bpe)) for i, t in rows],
        lambda: transducer(path),
    )


def with_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``, ``token_ids`` and whether decoding gives the text back.

    Columns of these names that are there already get an underscore in front.
    A null text counts as empty and stays null; repeated rows give equal rows;
    an empty table gives an empty result; texts are encoded whole.
    """
    path = vocabulary or default_vocabulary()
    made = [StructField("n_tokens", LongType()), StructField("token_ids", ArrayType(IntegerType())), StructField("round_trip", BooleanType())]
    names, taken = docs.columns, {*docs.columns, *(f.name for f in made)}
    fields = []
    for f in docs.schema:
        name = f.name
        while name != f.name and name in taken or name in {m.name for m in made}:
            name = f"_{name}"
        taken.add(name)
        fields.append(StructField(name, f.dataType, f.nullable))
    where = names.index("text")

    def work(rows: list[tuple], bpe: Transducer) -> list[tuple]:
        out = []
        for row in rows:
            ids = bpe.ids(row[where] or "")
            out.append((*row, len(ids), ids, "".join(bpe.decode(iter([ids]))) == (row[where] or "")))
        return out

    return map_rows(docs, names, StructType([*fields, *made]), work, lambda: transducer(path))
