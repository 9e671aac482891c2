"""Quality rules as a cascade that stops at the first rule a text fails.

Rules read features of a text, and a feature is worked out when a rule first
asks for it. A sample of the documents shows which texts each rule rejects and
what each feature costs; the cascade then takes, again and again, the rule that
rejects most of what is still left for the time that its missing features take.
The order decides the cost only: a text stays if it passes every rule.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_rows

#: Documents that the costs and the selectivities are estimated on, about.
SAMPLE = 2_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = re.compile(r"[#*$%&|<>]")
BULLET = re.compile(r"[\x20\x09-\x0D]*[-*•]")
LETTER, CAPITAL = regex.compile(r"\p{L}"), regex.compile(r"\p{Lu}")


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    if len(words) < 4:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    two = np.unique(ids[:-2] * len(seen) + ids[1:-1], return_inverse=True)[1]
    _, which, times = np.unique(two * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    again = times[which] > 1
    covered = np.zeros(len(words), bool)
    for at in range(3):
        covered[at : at + len(again)] |= again
    return int(covered.sum())


#: How each feature is worked out of the text and of other features.
FEATURES: dict[str, Callable[[Features], object]] = {
    "words": lambda f: WORD.findall(f["text"]),
    "n_words": lambda f: len(f["words"]),
    "word_chars": lambda f: sum(map(len, f["words"])),
    "n_symbols": lambda f: len(SYMBOLS.findall(f["text"])),
    "lines": lambda f: [x for x in f["text"].split("\n") if WORD.search(x)],
    "n_dup_lines": lambda f: len(f["lines"]) - len(set(f["lines"])),
    "n_repeat_words": lambda f: repeated_words(f["words"]),
    "n_capitals": lambda f: len(CAPITAL.findall(f["text"])),
    "n_letters": lambda f: len(LETTER.findall(f["text"])),
    "n_plain_words": lambda f: sum(1 for w in f["words"] if not w.isalpha() and not LETTER.search(w)),
    "n_bullets": lambda f: sum(1 for x in f["lines"] if BULLET.match(x)),
    "n_open_ends": lambda f: sum(1 for x in f["lines"] if x.endswith(("...", "…"))),
}


class Features(dict):
    """The features of a text; each is worked out once, when it is first asked for."""

    def __init__(self, text: str | None):
        super().__init__(text=text or "")

    def __missing__(self, name: str) -> object:
        self[name] = made = FEATURES[name](self)
        return made


class Timed(Features):
    """The same, noting the seconds that each feature took without those it asked for."""

    def __init__(self, text: str | None, seconds: Counter):
        super().__init__(text)
        self.seconds, self.inner = seconds, 0.0

    def __missing__(self, name: str) -> object:
        outer, self.inner, began = self.inner, 0.0, time.perf_counter()
        made = super().__missing__(name)
        took = time.perf_counter() - began
        self.seconds[name] += took - self.inner
        self.inner = outer + took
        return made


@dataclass(frozen=True)
class Rule:
    """A text fails if ``fails`` holds, which reads no features but ``needs``."""

    name: str
    needs: tuple[str, ...]
    fails: Callable[[Features], bool]


#: The rules that every verdict has; they stand for themselves in ``base_failed``.
BASE = (
    Rule("short", ("n_words",), lambda f: f["n_words"] < 50),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"]),
)
#: Shares are of words, or of lines with a word.
RULES = (
    Rule("symbols", ("n_words", "n_symbols"), lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("word_length", ("n_words", "word_chars"), lambda f: not 3 * f["n_words"] <= f["word_chars"] <= 10 * f["n_words"]),
    Rule("dup_lines", ("lines", "n_dup_lines"), lambda f: 10 * f["n_dup_lines"] > 4 * len(f["lines"])),
    Rule("no_letters", ("n_words", "n_plain_words"), lambda f: 10 * f["n_plain_words"] > 2 * f["n_words"]),
    Rule("capitals", ("n_letters", "n_capitals"), lambda f: 10 * f["n_capitals"] > 5 * f["n_letters"]),
    Rule("bullets", ("lines", "n_bullets"), lambda f: 10 * f["n_bullets"] > 9 * len(f["lines"])),
    Rule("open_ends", ("lines", "n_open_ends"), lambda f: 10 * f["n_open_ends"] > 3 * len(f["lines"])),
)
#: Columns of the report that come straight from the features.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Estimate:
    """What a sample shows: ``fails`` has the number of texts by the rules they fail, ``seconds`` by feature."""

    texts: int
    fails: dict[int, int]
    seconds: dict[str, float]


def estimate(docs: DataFrame, rules: tuple[Rule, ...], sample: int = SAMPLE) -> Estimate:
    """Apply all ``rules`` to about ``sample`` rows, in tasks; only sums reach the driver.

    Those are at most one number for each feature and for each set of rules
    that some text of the sample fails.
    """

    def work(rows: list[tuple]) -> list[tuple]:
        seconds, fails = Counter(), Counter()
        for (text,) in rows:
            found = Timed(text, seconds)
            for name in {n for r in rules for n in r.needs}:
                found[name]
            fails[sum(1 << i for i, r in enumerate(rules) if r.fails(found))] += 1
        return [(None, mask, float(n)) for mask, n in fails.items()] + [(name, None, s) for name, s in seconds.items()]

    some = docs.sample(min(1.0, sample / max(1, docs.count())), seed=11)
    sums = map_rows(some, ["text"], "feature string, mask long, total double", work).groupBy("feature", "mask").agg(F.sum("total").alias("total")).collect()
    fails = {r["mask"]: round(r["total"]) for r in sums if r["feature"] is None}
    return Estimate(sum(fails.values()), fails, {r["feature"]: r["total"] for r in sums if r["feature"] is not None})


def all_needs(names: Iterable[str]) -> set[str]:
    """The features of these names and those that they ask for in turn."""
    seen: set[str] = set()

    class Asked(Features):
        def __missing__(self, name: str) -> object:
            seen.add(name)
            return super().__missing__(name)

    probe = Asked("a b c d")
    for name in names:
        probe[name]
    return seen


def ordered(rules: tuple[Rule, ...], found: Estimate, paid: Iterable[str] = ()) -> list[Rule]:
    """``rules`` by rejection per cost among what the rules before them leave; ``paid`` features cost nothing.

    Every rule costs a little besides its features. Ties, as on an empty
    sample, keep the order of ``rules``.
    """
    have, left, rest, out = all_needs(paid), dict(found.fails), list(enumerate(rules)), []
    least = max(1e-9, sum(found.seconds.values()) / 1000)

    def worth(item: tuple[int, Rule]) -> tuple[float, float]:
        i, rule = item
        cost = least + sum(found.seconds.get(n, 0.0) for n in all_needs(rule.needs) - have)
        return sum(n for mask, n in left.items() if mask >> i & 1) / cost, -cost

    while rest:
        best = max(rest, key=worth)
        rest.remove(best)
        out.append(best[1])
        have |= all_needs(best[1].needs)
        left = {mask: n for mask, n in left.items() if not mask >> best[0] & 1}
    return out


def first_failed(found: Features, cascade: Iterable[Rule]) -> str | None:
    """The name of the first rule that the text fails; the rules behind it are not tried."""
    return next((r.name for r in cascade if r.fails(found)), None)


def judge(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``failed_rule``: the first rule of the cascade that the text fails, null where it passes all.

    Which of several failed rules is named depends on the order that the sample
    suggests; whether one is named doesn't. A column ``failed_rule`` that is
    there already gets underscores in front. A null text counts as empty; an
    empty table gives an empty result; repeated rows give equal rows; texts are
    read whole, however long; other nulls pass through.
    """
    cascade = ordered(rules, estimate(docs, rules, sample))
    taken, fields = {*docs.columns, "failed_rule"}, []
    for f in docs.schema:
        name = f.name
        while name == "failed_rule" or name != f.name and name in taken:
            name = f"_{name}"
        taken.add(name)
        fields.append(StructField(name, f.dataType, f.nullable))
    where = docs.columns.index("text")
    schema = StructType([*fields, StructField("failed_rule", StringType())])
    return map_rows(docs, docs.columns, schema, lambda rows: [(*r, first_failed(Features(r[where]), cascade)) for r in rows])


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that pass all rules, columns unchanged; cases as in ``judge``."""
    cascade, where = ordered(rules, estimate(docs, rules, sample)), docs.columns.index("text")
    return map_rows(docs, docs.columns, docs.schema, lambda rows: [r for r in rows if first_failed(Features(r[where]), cascade) is None])


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, the counts of ``COUNTS``, ``base_failed`` and ``kept`` for each row of ``docs``.

    The counts are wanted for every text, so what they need costs the cascade
    nothing; it runs over the texts that pass the base rules. A null text counts
    as empty: all counts 0, base failed. A null doc_id stays null; repeated rows
    give equal rows; an empty table gives an empty result; texts are read
    whole, however long; extra columns are ignored.
    """
    cascade = ordered(rules, estimate(docs, rules, sample), paid=COUNTS)

    def work(rows: list[tuple]) -> list[tuple]:
        out = []
        for doc_id, text in rows:
            found = Features(text)
            counts = [found[c] for c in COUNTS]
            base = first_failed(found, BASE) is not None
            out.append((doc_id, *counts, base, not base and first_failed(found, cascade) is None))
        return out

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean"
    return map_rows(docs, ["doc_id", "text"], schema, work)


ORACLE = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, [l FOR l IN string_split(x, chr(10)) IF regexp_matches(l, '[^\x20\x09-\x0D]')] AS lines FROM t),
threes AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
again AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM threes) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
f AS (
  SELECT doc_id, x, words, lines, len(words) AS n_words, CAST(coalesce(list_sum([length(v) FOR v IN words]), 0) AS BIGINT) AS word_chars,
    length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN covered USING (r)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_dup_lines > 4 * len(lines)
    OR 10 * len([v FOR v IN words IF NOT regexp_matches(v, '\p{L}')]) > 2 * n_words
    OR 10 * len(regexp_extract_all(x, '\p{Lu}')) > 5 * len(regexp_extract_all(x, '\p{L}'))
    OR 10 * len([l FOR l IN lines IF regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]')]) > 9 * len(lines)
    OR 10 * len([l FOR l IN lines IF ends_with(l, '...') OR ends_with(l, '…')]) > 3 * len(lines)) AS kept
FROM b
"""
