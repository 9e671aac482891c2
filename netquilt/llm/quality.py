"""Quality classifier by co-training of two views.

One logistic model sees the content of a text: its surface (capitals, marks,
repeats and so on) and those of its words and word shapes, hashed, that tell
the classes apart best. Another sees only its metadata (language, source,
stated length). Over some rounds each labels those documents of an unlabelled
pool that it is sure of and hands them to the other, which is then fitted anew.
Both are calibrated on labelled rows that they weren't fitted to, and a
document's score joins the two calibrated views. Toxicity has a pair of models
of its own, made in the same way from the toxic labels.

The models are fitted on bounded samples: at most ``LABELLED`` labelled
documents and about ``POOL`` unlabelled ones. Every document is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Labelled documents to fit and calibrate on; the first by a hash of their id.
LABELLED = 10_000
#: Unlabelled documents to exchange labels on, drawn by a hash of their id.
POOL = 10_000
ROUNDS = 4
#: How sure a calibrated view must be to hand on a label.
SURE = 0.95
#: Labels handed on in a round, for each class and view.
GROW = 1_000
#: Documents of a lower score are rejected.
THRESHOLD = 0.5
SLOTS = 16
#: Slots that words and shapes are hashed to, and how many of them a content view sees at most.
WORD_SLOTS, TELLING = 1 << 20, 128
#: Stated lengths are told apart by their power of two, up to this one.
LENGTHS = 24
_MARKS = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,'-" for b in range(256)])

_LETTERS, _DIGITS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")

#: Content features, language, source and stated length.
Doc = tuple[list[float] | np.ndarray, str | None, str | None, int | None]


def content(text: str | None) -> list[float]:
    """Features of the content; all zero for a null or empty text."""
    words = (text or "").split()
    n = len(words)
    if not n:
        return [0.0] * 9
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    chars = len(text)
    lines = [x for x in text.split("\n") if x]
    kinds = len(set(words))
    return [
        1.0,
        np.log1p(n),
        min(chars / n, 30.0),
        upper / max(1, upper + lower),
        float(counts[_MARKS].sum()) / n,
        int(counts[48:58].sum()) / chars,
        sum(map(eq, words, words[1:])) / n,
        np.log(kinds) / np.log(n) if n > 1 else 1.0,
        1 - len(set(lines)) / max(1, len(lines)),
    ]


def shapes(text: str) -> set[str]:
    """What the tokens of a text look like: runs of letters as ``a``, of digits as ``0``, other characters once each run."""
    return {_RUN.sub(r"\1", s) for s in {*_DIGITS.sub("0", _LETTERS.sub("a", text)).split()}} - {"a"}


def word_slots(text: str | None) -> bytes:
    """The sorted hash slots of the words and word shapes of a text as packed numbers."""
    found = {*re.findall(r"\w+", (text or "").lower()), *(f" {s}" for s in shapes(text or ""))}
    return np.unique(np.array([crc32(w.encode("utf-8", "surrogatepass")) for w in found], np.uint32) % WORD_SLOTS).tobytes()


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Features of the metadata: language, source, both together, and stated length; a null counts as a value of its own."""
    out = [0.0] * (3 * SLOTS + LENGTHS + 2)
    for i, value in enumerate((repr(lang), repr(source), repr((lang, source)))):
        out[i * SLOTS + crc32(value.encode("utf-8", "surrogatepass")) % SLOTS] = 1.0
    out[3 * SLOTS + min(LENGTHS - 1, max(0, n_chars or 0).bit_length())] = 1.0
    out[-2:] = float(n_chars is None), np.log1p(max(0, n_chars or 0))
    return out


def views(docs: list[Doc]) -> tuple[np.ndarray, np.ndarray]:
    """Both feature matrices."""
    meta = np.empty((len(docs), 3 * SLOTS + LENGTHS + 2), np.float32)  # row by row: the driver holds no lists of numbers
    for i, d in enumerate(docs):
        meta[i] = metadata(*d[1:])
    return np.array([d[0] for d in docs], np.float32), meta


@dataclass
class Logistic:
    """A logistic model on standardised features, with its calibration."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight[1:] + self.weight[0], -30, 30)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * self.raw(x) + self.shift


def _newton(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of a logistic fit, the intercept first and without penalty."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(x: np.ndarray, y: np.ndarray) -> Logistic:
    mean, scale = x.mean(0, dtype=float), x.std(0, dtype=float)
    scale[scale < 1e-9] = 1.0
    return Logistic(mean, scale, _newton((x - mean) / scale, y, 1.0))


def calibrate(model: Logistic, x: np.ndarray, y: np.ndarray) -> Logistic:
    """Fit slope and shift of the log-odds on rows that the model hasn't seen."""
    if 0 < y.sum() < len(y):
        shift, slope = _newton(model.raw(x)[:, None], y, 0.1)
        # a view that tells nothing must not turn the other's order round
        model.slope, model.shift = (float(slope), float(shift)) if slope > 0 else (0.0, float(np.log(y.mean() / (1 - y.mean()))))
    return model


@dataclass
class CoTrained:
    """Both views; ``handed`` counts the labels that content and metadata gave each other."""

    text: Logistic
    meta: Logistic
    prior: float
    handed: tuple[int, int] = (0, 0)

    def score(self, docs: list[Doc]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of the class by content, by metadata, and by both."""
        a, b = views(docs)
        t, m = self.text.logit(a), self.meta.logit(b)
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (t, m, t + m - self.prior))


def co_train(docs: list[Doc], good: list[float], pool: list[Doc]) -> CoTrained | None:
    """Fit both views; ``None`` if the labels don't hold both classes."""
    y = np.array(good, float)
    held = np.arange(len(y)) % 4 == 0  # calibration rows
    if not (0 < y[~held].sum() < (~held).sum()):
        return None
    sides = views(docs)
    pools = views(pool) if pool else tuple(np.empty((0, s.shape[1])) for s in sides)
    given = [(s[~held], y[~held]) for s in sides]
    free = np.ones(len(pool), bool)
    models, handed = [], [0, 0]
    for turn in range(ROUNDS + 1):
        models = [calibrate(fit(*g), s[held], y[held]) for g, s in zip(given, sides, strict=True)]
        if turn == ROUNDS or not free.any():
            break
        for i, model in enumerate(models):
            p = 1 / (1 + np.exp(-np.clip(model.logit(pools[i]), -30, 30)))
            for label, sure in ((1.0, p), (0.0, 1 - p)):
                best = np.flatnonzero(free & (sure >= SURE))
                best = best[np.argsort(-sure[best], kind="stable")][:GROW]
                free[best] = False
                handed[i] += len(best)
                x, z = given[1 - i]
                given[1 - i] = (np.vstack([x, pools[1 - i][best]]), np.r_[z, np.full(len(best), label)])
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    return CoTrained(*models, float(np.log(share / (1 - share))), (handed[0], handed[1]))


@dataclass
class Worded:
    """A pair of models and the word slots that its content view sees."""

    model: CoTrained
    slots: np.ndarray

    def score(self, docs: list[Doc], words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.model.score(with_words(docs, words, self.slots))


def train_words(docs: list[Doc], words: list[bytes], labels: list[float], pool: list[Doc], pool_words: list[bytes]) -> Worded | None:
    """Choose the telling slots on the rows that are fitted to, then co-train; ``None`` if the labels don't hold both classes."""
    y = np.array(labels, float) >= 0.5
    fitted = np.arange(len(y)) % 4 != 0  # the rest calibrates
    if not 0 < y[fitted].sum() < fitted.sum():
        return None
    slots = telling_slots([w for w, f in zip(words, fitted, strict=True) if f], y[fitted].astype(float))
    model = co_train(with_words(docs, words, slots), y.astype(float).tolist(), with_words(pool, pool_words, slots))
    return model and Worded(model, slots)


def with_words(docs: list[Doc], words: list[bytes], slots: np.ndarray) -> list[Doc]:
    """``docs`` whose content also tells which of ``slots`` their words have."""
    place = np.full(WORD_SLOTS, -1, np.int32)
    place[slots] = np.arange(len(slots))
    first = len(docs[0][0]) if docs else 0
    rows = np.zeros((len(docs), first + len(slots)), np.float32)
    for row, d, w in zip(rows, docs, words, strict=True):
        row[:first] = d[0]
        at = place[np.frombuffer(w, np.uint32)]
        row[first + at[at >= 0]] = 1
    return [(row, *d[1:]) for row, d in zip(rows, docs, strict=True)]


def telling_slots(words: list[bytes], bad: np.ndarray) -> np.ndarray:
    """The word slots whose presence tells most of the class, by the likelihood ratio of their counts.

    No more of them than the smaller class has rows: on few labels most slots
    tell the classes apart by luck only, and would outweigh those that mean it.
    """
    counts = [np.zeros(WORD_SLOTS), np.zeros(WORD_SLOTS)]
    for w, y in zip(words, bad, strict=True):
        counts[int(y)][np.frombuffer(w, np.uint32)] += 1
    sizes = [len(bad) - bad.sum(), bad.sum()]
    share, told = (counts[0] + counts[1]) / len(bad), np.zeros(WORD_SLOTS)
    for seen, n in zip(counts, sizes, strict=True):
        for found, expected in ((seen, share), (n - seen, 1 - share)):
            told += np.where(found > 0, found * np.log(np.maximum(found, 1e-12) / np.maximum(n * expected, 1e-12)), 0)
    return np.sort(np.argsort(-told, kind="stable")[: min(TELLING, *map(int, sizes))])


def train(docs: DataFrame, labels: DataFrame) -> tuple[Worded | None, Worded | None]:
    """Fit quality and toxicity on the bounded samples of ``docs`` and ``labels(doc_id, quality, toxic)``.

    A document with several labels counts by their mean; null labels and labels
    without a document don't count, and ``toxic`` may be absent.
    """
    if "toxic" not in labels.columns:
        labels = labels.withColumn("toxic", F.lit(None).cast("int"))
    rated = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy("doc_id").agg(F.avg("quality").alias("good"), F.avg("toxic").alias("bad"))
    there = rated.join(docs.select("doc_id"), "doc_id", "left_semi")
    chosen = there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)  # bounded, so it may be broadcast
    own = docs.select("doc_id", "text", "lang", "source", "n_chars")

    def drawn(rows: DataFrame, most: int) -> list[tuple[int, float | None, float | None, bytes, Doc]]:
        """The features of at most ``most`` rows; texts stay in the tasks."""
        small = map_rows(
            rows,
            ["doc_id", "good", "bad", "text", "lang", "source", "n_chars"],
            "doc_id long, good double, bad double, words binary, content array<double>, lang string, source string, n_chars long",
            lambda rows: [(i, good, bad, word_slots(text), content(text), *rest) for i, good, bad, text, *rest in rows],
        )
        return [(r[0], r[1], r[2], bytes(r[3]), (np.array(r[4], np.float32), *r[5:])) for r in small.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).toLocalIterator()]

    known = drawn(own.join(F.broadcast(chosen), "doc_id"), LABELLED)
    if not known:
        return None, None
    every = max(1, docs.count() // POOL)
    pool = drawn(own.where(F.pmod(F.xxhash64(F.lit("pool"), "doc_id"), F.lit(every)) == 0).withColumn("good", F.lit(None).cast("double")).withColumn("bad", F.lit(None).cast("double")), 2 * POOL)
    ids = {i for i, *_ in known}
    pool = [r for r in pool if r[0] not in ids]

    def fitted(label: int) -> Worded | None:
        mine = [r for r in known if r[label] is not None]
        return train_words([r[4] for r in mine], [r[3] for r in mine], [r[label] for r in mine], [r[4] for r in pool], [r[3] for r in pool])

    return fitted(1), fitted(2)


def judge(models: tuple[Worded | None, Worded | None], rows: list[tuple]) -> list[tuple[float | None, float | None, float | None, float | None, bool]]:
    """Content, metadata, joined and toxic score of each ``(text, lang, source, n_chars)``, and whether it is kept."""
    docs, words = [(content(r[0]), *r[1:]) for r in rows], [word_slots(r[0]) for r in rows]
    good, bad = models
    scores = [*map(np.ndarray.tolist, good.score(docs, words))] if good else [[None] * len(rows)] * 3
    toxic = bad.score(docs, words)[2].tolist() if bad else [None] * len(rows)
    return [(t, m, p, x, (p is None or p >= THRESHOLD) and (x is None or x < THRESHOLD)) for t, m, p, x in zip(*scores, toxic, strict=True)]


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, content_score, metadata_score, score, toxic_score, keep`` for each row of ``docs``.

    ``keep`` is false where the joined score is under ``THRESHOLD`` or the toxic
    score isn't; a score that ties with ``THRESHOLD`` counts as reaching it.
    Null and empty texts have neutral content features and are judged like
    others; null metadata is a value of its own; texts are read whole; repeated
    rows get equal scores; extra columns are ignored; an empty table gives an
    empty result. Without labels of both classes nothing is known: scores are
    null and no row is rejected for them.
    """
    models = train(docs, labels)

    def work(rows: list[tuple]) -> list[tuple]:
        return [(r[0], *found) for r, found in zip(rows, judge(models, [r[1:] for r in rows]), strict=True)]

    return map_rows(docs, ["doc_id", "text", "lang", "source", "n_chars"], "doc_id long, content_score double, metadata_score double, score double, toxic_score double, keep boolean", work)


def drop_poor(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, unchanged; what it does with odd rows is said at ``score``."""
    models = train(docs, labels)
    if models == (None, None):
        return docs
    names = docs.columns
    at = [names.index(c) for c in ("text", "lang", "source", "n_chars")]

    def work(rows: list[tuple]) -> list[tuple]:
        return [r for r, found in zip(rows, judge(models, [tuple(r[i] for i in at) for r in rows]), strict=True) if found[-1]]

    return map_rows(docs, names, docs.schema, work)
