"""Main text of web pages by a maximum-scoring run of tokens.

A page becomes a row of tokens: tags, and stretches of words. Tags score below
zero. Words score by the block that they stand in (its element, its length,
whether they are link text) and by the strongest sign of side matter among the
elements around them (their names, and the words of their class, id and role).
One linear scan finds the run of the greatest total; inside it, blocks whose
surroundings pull them below zero are left out.

All weights are log-odds counted on labelled pages: a sample of the given
pages that mark their article, and the few skeletons in ``EXAMPLES``, whose
counts matter only where the given pages are silent. An element around the
article, or around most words of a page that marks none, is no sign.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: About how many pages the weights are learnt from, drawn by a hash of the url.
SAMPLE_PAGES = 4_000
#: Features kept, the most frequent first.
MOST_FEATURES = 20_000
#: Bounds of the weight of a block and of a sign; a block without a sign around it is never worse than ``LEAST``.
BLOCK, LEAST, SIGN = 4.0, -2.0, 6.0
#: What side matter that a sign shows costs a run, whatever its length: it is left out, so it must not part an article.
BRIDGE = -0.5
#: Pages that each skeleton counts as.
EXAMPLE_PAGES = 25
WORD, TAG = 1.0, -0.2  # weights of what no labelled page had

#: A quote opens a value only behind an equals sign.
_ATTRIBUTES = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|</?([a-zA-Z][\w:-]*){_ATTRIBUTES}>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>", re.S)
_NAME = re.compile(r"</?([a-zA-Z][\w:-]*)")
_LABELS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Elements whose content is not text of the page; of those that stay open only the first two swallow the rest.
_SWALLOW = ("script", "style")
_RAW = frozenset((*_SWALLOW, *"template noscript textarea title svg math iframe object select canvas audio video".split()))
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose name tells nothing beyond the blocks in them.
_PLAIN = frozenset("html body div span p ul ol li dl dt dd table tbody thead tfoot tr td th main article section a b i em strong font center h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text rather than other blocks: half a compound name counts half there.
_TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre span a b i em strong figcaption caption blockquote".split())
SPACE = "#space"
#: The sign of what lies outside an article that holds a third of the page's words at least.
OUTSIDE = "a:#outside"

_SIDE = "data-side"
_PROSE = "Some words of the story stand here, and then it goes on with more of them until the paragraph is done and the next one begins to tell what came after that."
#: Labelled skeletons of pages: what is in ``article`` and not in an element marked ``data-side`` is main text.
EXAMPLES = (
    f"""<body><div class="cookie consent notice gdpr banner popup modal overlay">We use cookies on this site. <button>Accept</button></div>
<header class="masthead header site"><div class="logo">The site</div><form class="search form" role="search">Search this site <button>Go</button></form></header>
<nav class="nav navbar navigation menu breadcrumb breadcrumbs" role="navigation"><ul><li><a href="/">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<article><header class="header entry"><h1>A heading of the story</h1></header><h2>What it says</h2><h3>Then</h3><p>{_PROSE}</p><p>Short line.</p><p>This paragraph has a few words.</p>
<div class="ad ads adv advert adverts advertisement sponsor sponsored promo" {_SIDE}>Buy this now</div><ul><li>one thing of the list</li><li>Another</li></ul><ol><li>{_PROSE}</li></ol>
<blockquote>{_PROSE}</blockquote><pre>some code here</pre><table><tr><th>Year</th><td>Sum</td><td>{_PROSE}</td></tr></table><dl><dt>term</dt><dd>what it means</dd></dl>
<figure><figcaption>What the picture shows</figcaption></figure><div>{_PROSE}</div><div>Plain words in a block</div><aside class="aside complementary related recommended" {_SIDE}>More stories like this one</aside></article>
<section class="comments comment disqus reply replies respond" id="comments"><h2>Comments</h2><p>{_PROSE}</p><p>I agree.</p></section>
<div class="sidebar widget" role="complementary"><p>{_PROSE}</p><p>Popular</p></div>
<div class="share sharing social toolbar">Share this</div><div class="pagination pager skip">Next page</div>
<form class="login signup newsletter subscribe">Get our letter {_PROSE}</form><div class="notice notices">{_PROSE}</div>
<footer class="footer contentinfo" role="contentinfo">All rights reserved</footer></body>""",
    f"""<body><div><a href="/">Home</a> <a href="/a">News and views</a></div><ul><li><a href="/">Home</a></li><li><a href="/c">All of the topics</a></li></ul><p><a href="/d">Up</a></p><menu><li>Open</li></menu><article><h1>Words of a heading</h1><div>{_PROSE}<br>{_PROSE}</div><p>{_PROSE}</p><p><a href="/x">a link</a></p><h4>Part</h4><h5>Part of it</h5><h6>Last part</h6>
<p>{_PROSE}</p></article><dialog>Sign in</dialog><div>Copyright of the site</div></body>""",
)


class Page:
    """The tokens of a page in order, and the elements that they stand in.

    ``tokens`` are ``(name, words, text, element, link)``: a tag has no words, and
    bare white space is ``SPACE``. ``elements`` are ``(around, name, label words,
    half label words)``; the first stands for the page itself.
    """

    def __init__(self, page: str):
        self.tokens: list[tuple[str, int, str, int, bool]] = []
        self.elements: list[tuple[int, str, tuple[str, ...], tuple[str, ...]]] = [(-1, "", (), ())]
        self.marked: list[bool] = [False]
        self._read(page)
        self.words = [0] * len(self.elements)
        for name, n, _, at, _ in self.tokens:
            self.words[at] += n
        for at in range(len(self.elements) - 1, 0, -1):  # inner elements come behind those around them
            self.words[self.elements[at][0]] += self.words[at]

    def _read(self, page: str) -> None:
        open_: list[tuple[str, int, str, bool]] = [("", 0, "", False)]  # name, element, block around, whether in a link
        depth: Counter = Counter()  # open elements by name, so that no tag searches a deep stack in vain
        out, at, unclosed = self.tokens, 0, set()

        def close() -> str:
            name = open_.pop()[0]
            depth[name] -= 1
            return name

        def text(upto: int) -> None:
            if upto > at:
                part = page[at:upto]
                _, element, block, link = open_[-1]
                n = len(part.split())
                out.append((block, n, part, element, link) if n else (SPACE, 0, "", element, link))

        for m in _TOKEN.finditer(page):
            if m.start() < at:
                continue  # inside a raw element
            text(m.start())
            at = m.end()
            tag = m.group()
            if not (found := _NAME.match(tag)):
                continue
            name = found.group(1).lower()
            if tag[1] == "/":
                if depth[name]:
                    out.append((name, 0, "", open_[-1][1], False))
                    while close() != name:
                        pass
                elif name == "p":
                    out.append((name, 0, "", open_[-1][1], False))
                continue
            empty = tag.endswith("/>")
            if name in _RAW and not (empty and name not in _SWALLOW):
                end = None if name in unclosed else re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if end:
                    at = end.end()
                elif name in _SWALLOW:
                    at = len(page)
                else:
                    unclosed.add(name)
                continue
            if name in _BLOCK:
                while depth["p"] and open_[-1][0] not in _BLOCK:
                    close()  # an inline element left open ends with its paragraph
                if open_[-1][0] == "p" or name == "li" and open_[-1][0] == "li":
                    close()
            _, element, block, link = open_[-1]
            out.append((name, 0, "", element, False))
            if name in _VOID or empty:
                continue
            labelled = "=" in tag
            if labelled or name not in _PLAIN or name in ("article", "main"):
                whole = [x.lower() for m in _LABELS.findall(tag) for x in "".join(m).split()] if labelled else []
                parts = {w for x in whole for w in re.split(r"[\W_]+", x) if w and w != x}
                full, half = tuple(f"c:{w}" for w in whole), tuple(f"c:{w}" for w in parts)
                if name not in _TEXTUAL:
                    full, half = (*full, *half), ()
                if name not in _PLAIN:
                    full = (f"a:{name}", *full)
                if full or half or name in ("article", "main"):
                    self.elements.append((element, name, full, half))
                    self.marked.append(labelled and _SIDE in tag)
                    element = len(self.elements) - 1
            open_.append((name, element, name if name in _BLOCK else block, link or name == "a"))
            depth[name] += 1
        text(len(page))

    def blocks(self) -> Iterator[list[int]]:
        """The numbers of the text tokens of each block."""
        now: list[int] = []
        for i, (name, n, *_) in enumerate(self.tokens):
            if n:
                now.append(i)
            elif name in _BLOCK and now:
                yield now
                now = []
        if now:
            yield now

    def features(self) -> Iterator[tuple[list[int], tuple[str, str, str]]]:
        """Text tokens of a block, link text and other apart, with the features of the block from the sharpest on."""
        for block in self.blocks():
            total = sum(self.tokens[i][1] for i in block)
            size = (total > 3) + (total > 8) + (total > 20) + (total > 50)
            for link in (False, True):
                if mine := [i for i in block if self.tokens[i][4] == link]:
                    name = self.tokens[mine[0]][0]
                    # a link among other words counts as words of its block
                    only = link and 2 * sum(self.tokens[i][1] for i in mine) > total
                    yield mine, (f"b:{name}|{only:d}|{size}", f"e:{name}|{only:d}", f"n:{only:d}|{size}")

    def article(self) -> int | None:
        """The page's largest ``article``, or else ``main``."""
        marks = (at for at, e in enumerate(self.elements) if e[1] in ("article", "main"))
        return max(marks, key=lambda at: (self.elements[at][1] == "article", self.words[at], -at), default=None)

    def telling(self) -> list[bool]:
        """Which elements can be a sign: not what holds the article, or most of its words, or most of the page's if it marks none."""
        best = self.article()
        if best is None:
            return [2 * n <= self.words[0] for n in self.words]
        within = [False] * len(self.elements)
        out = [True] * len(self.elements)
        for at, (around, *_) in enumerate(self.elements):
            within[at] = at == best or at > 0 and within[around]
            out[at] = not within[at] or 2 * self.words[at] <= self.words[best]
        at = best
        while at >= 0:
            out[at], at = False, self.elements[at][0]
        return out

    def side(self, weights: dict[str, float]) -> list[float]:
        """The strongest sign of side matter around each element, at most 0."""
        out, telling, best = [0.0], self.telling(), self.article()
        marked = best is not None and 3 * self.words[best] >= self.words[0]
        if marked:
            out = [weights.get(OUTSIDE, 0.0)]
        for at, (around, _, full, half) in enumerate(self.elements[1:], 1):
            sign = 0.0 if marked and at == best else out[around]
            if telling[at]:
                sign = min([sign, *(weights.get(f, 0.0) for f in full), *(weights.get(f, 0.0) / 2 for f in half)])
            out.append(sign)
        return out

    def signed(self) -> list[bool]:
        """Which elements lie in a part of the page that has a sign of any kind."""
        out, telling = [False], self.telling()
        for at, (around, _, full, half) in enumerate(self.elements[1:], 1):
            out.append(out[around] or telling[at] and bool(full or half))
        return out

    def inside(self) -> list[bool] | None:
        """Which elements lie in the article and in no marked side matter; ``None`` without an article."""
        best = self.article()
        if best is None:
            return None
        out = [False]
        for at, (around, *_) in enumerate(self.elements[1:], 1):
            out.append((at == best or out[around]) and not self.marked[at])
        return out


def count_labels(pages: list[str | None]) -> list[tuple[str, int, int]]:
    """``(feature, inside, outside)`` counts over the pages that mark an article: words by feature, tags by name."""
    counts: tuple[Counter, Counter] = Counter(), Counter()
    for text in pages:
        page = Page(text or "")
        within = page.inside()
        if within is None:
            continue
        for name, n, _, at, _ in page.tokens:
            if n:
                counts[not within[at]]["all"] += n
                counts[1][OUTSIDE] += n * (not within[at])
            elif name != SPACE:
                counts[not within[at]][f"t:{name}"] += 1
        signed = page.signed()
        for mine, found in page.features():
            for i in mine:
                for f in found if not signed[page.tokens[i][3]] else ():  # what signs explain tells nothing of blocks
                    counts[not within[page.tokens[i][3]]][f] += page.tokens[i][1]
        telling = page.telling()
        for at, (_, _, full, half) in enumerate(page.elements):
            if at and telling[at]:
                for f in {*full, *half}:
                    counts[not within[at]][f] += page.words[at]
    return [(k, counts[0][k], counts[1][k]) for k in sorted({*counts[0], *counts[1]})]


def weigh(counts: dict[str, tuple[int, int]]) -> dict[str, float]:
    """Log-odds of each feature: of blocks as they are, of signs against the share of all words."""
    a_all, b_all = counts.get("all", (0, 0))
    base = math.log((a_all + 1) / (b_all + 1))
    out = {}
    for f, (a, b) in counts.items():
        odds = math.log((a + 0.5) / (b + 0.5))
        if f[:2] in ("b:", "e:", "n:"):
            out[f] = max(LEAST, min(BLOCK, odds))
        elif f.startswith("t:"):  # tags lie below zero in any case, least so where articles have them
            out[f] = min(-0.05, (max(-BLOCK, min(BLOCK, odds)) - BLOCK) / BLOCK)
        elif f != "all":
            out[f] = max(-SIGN, min(SIGN, odds - base))
    return out


def learn(pages: DataFrame) -> dict[str, float]:
    """Weights from a bounded sample of ``pages`` and the skeletons; the pages' texts stay in the tasks."""
    every = max(1, pages.count() // SAMPLE_PAGES)
    sample = pages.where(F.pmod(F.xxhash64(F.lit("learn"), "page_id", "url"), F.lit(every)) == 0)
    found = map_rows(sample, ["html"], "feature string, inside long, outside long", lambda rows: count_labels([r for (r,) in rows]))
    most = found.groupBy("feature").agg(F.sum("inside").alias("a"), F.sum("outside").alias("b")).orderBy(F.desc(F.col("a") + F.col("b")), "feature").limit(MOST_FEATURES)
    counts = {f: (a, b) for f, a, b in most.collect()}
    for f, a, b in count_labels([*EXAMPLES]):
        x, y = counts.get(f, (0, 0))
        counts[f] = x + EXAMPLE_PAGES * a, y + EXAMPLE_PAGES * b
    return weigh(counts)


def best_run(scores: list[float]) -> tuple[int, int]:
    """The slice of the greatest sum, the first and longest of equals; empty if no score is above zero."""
    best, run, start, span = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):
        if run < 0:
            run, start = 0.0, i
        run += s
        if run > best or run == best > 0 and start == span[0]:
            best, span = run, (start, i + 1)
    return span


def token_scores(page: Page, weights: dict[str, float]) -> tuple[list[float], list[bool]]:
    """The score of each token, and whether its surroundings make it side matter."""
    scores = [0.0 if name == SPACE else weights.get(f"t:{name}", TAG) for name, *_ in page.tokens]
    dropped, side = [False] * len(scores), page.side(weights)
    for mine, (sharp, by_name, by_size) in page.features():
        if (base := weights.get(sharp)) is None:
            known = [weights[f] for f in (by_name, by_size) if f in weights]
            base = sum(known) / len(known) if known else WORD
        for i in mine:
            _, n, _, at, _ = page.tokens[i]
            dropped[i] = side[at] < 0 and base + side[at] < 0
            scores[i] = BRIDGE if dropped[i] else (base + side[at]) * n
    return scores, dropped


def main_text(text: str | None, weights: dict[str, float]) -> str:
    """The blocks of the page's main text, joined by line ends."""
    page = Page(text or "")
    scores, dropped = token_scores(page, weights)
    lo, hi = best_run(scores)
    blocks, now = [], []
    for i in range(lo, hi):
        name, n, part, *_ = page.tokens[i]
        if n:
            if not dropped[i]:
                now.append(html.unescape(part))
        elif name in _BLOCK:
            blocks.append(now)
            now = []
        elif name in ("br", SPACE):
            now.append(" ")
    blocks.append(now)
    return "\n".join(x for b in blocks if (x := " ".join("".join(b).split())))


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``.

    A null or empty html, and a page without a block that scores above zero,
    gives an empty text. Repeated rows give equal rows; null ids and urls stay
    null; extra columns are ignored; an empty table gives an empty result. Of
    runs that tie the first and longest counts. Pages are read whole, in time
    that grows with their length. Where no page marks its article, only the
    skeletons are learnt from.
    """
    weights = learn(pages)
    return map_rows(
        pages,
        ["page_id", "url", "html"],
        "page_id long, url string, text string, n_chars long",
        lambda rows: [(i, u, text := main_text(h, weights), len(text)) for i, u, h in rows],
    )
