import random
from itertools import accumulate

import pytest

from netquilt.llm import html_text as h


def weights(pages=()):
    counts = {f: (a, b) for f, a, b in h.count_labels([*pages])}
    for f, a, b in h.count_labels([*h.EXAMPLES]):
        x, y = counts.get(f, (0, 0))
        counts[f] = x + h.EXAMPLE_PAGES * a, y + h.EXAMPLE_PAGES * b
    return h.weigh(counts)


W = weights()
LINE = "<p>some words of the story go here and on</p>"
BODY = "<h1>A heading here</h1>" + LINE * 4
MENU = '<nav><a href="/">home</a></nav>'


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>a  b\n c</p>", "a b c"),
        ("<p>one<p>two<br>three", "one\ntwo three"),
        ("<div>x &amp; y&nbsp;z &#233;</div>", "x & y z é"),
        ("<html><head><title>t</title></head><body><p>text</p></body></html>", "text"),
        ('<script>var t="</p>";track(0);</script><p>a</p><style>p{}</style>', "a"),
        ("<p>a<!-- <p>no</p> -->b</p>", "ab"),
        ("<p>in<i>line</i> <b>bold</b></p>", "inline bold"),
        ("<p><b>open<br><p>next</p>", "open\nnext"),
        ("<ul><li>a<li>b</ul>", "a\nb"),
        ("<nav>menu</nav><article><h1>T</h1><p>body</p></article><footer>f</footer>", "T\nbody"),
        (f'<article>{LINE}<div class="ad top">buy</div><aside>x</aside><form>f</form>{LINE}<section id="comments"><p>c</p></section></article>', "some words of the story go here and on\nsome words of the story go here and on"),
        ('<header>site</header><article><header><h1>T</h1></header><p>a</p></article><div class="cookie-notice">ok</div>', "T\na"),
        ('<article><p>a</p></article><article class="comment"><p>reader</p></article>', "a"),
        ("a < b and c > d", "a < b and c > d"),
        ('<p title="a > b">x</p>', "x"),
        ("""<p data-x">first words</p><p title="a > b" '>second words</p>""", "first words\nsecond words"),
        ("<article><h1>Short.</h1></article><footer>much more than the article has in it</footer>", "Short."),
    ],
)
def test_pages(page, want):
    assert h.main_text(page, W) == want


def best_by_force(scores):
    sums = [0, *accumulate(scores)]
    best = max((sums[j] - sums[i], -i, j) for i in range(len(sums)) for j in range(i, len(sums)))
    return (-best[1], best[2]) if best[0] > 0 else (0, 0)


def test_best_run():
    assert h.best_run([]) == (0, 0)
    assert h.best_run([-1, -2]) == (0, 0)
    rnd = random.Random(3)
    for _ in range(300):
        scores = [rnd.randint(-4, 4) for _ in range(rnd.randint(1, 25))]
        lo, hi = h.best_run(scores)
        want = best_by_force(scores)
        assert sum(scores[lo:hi]) == sum(scores[slice(*want)])


def test_whole_pages_by_brute_force():
    rnd = random.Random(4)
    parts = [LINE, MENU, "<div>short</div>", '<div class="ad">buy now</div>', "<ul><li><a href=x>go there</a></li></ul>", "<h2>Part of it</h2>", "<footer>end</footer>", "loose words", "<form>name</form>"]
    for _ in range(60):
        text = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 14)))
        page = h.Page(text)
        scores, dropped = h.token_scores(page, W)
        lo, hi = best_by_force(scores)
        want = " ".join(t[2] for t, d in list(zip(page.tokens, dropped, strict=True))[lo:hi] if t[1] and not d).split()
        assert h.main_text(text, W).split() == want


@pytest.mark.parametrize("label", ["layout no-sidebar", "content no-sidebar", "post has-social-share", "with-comments", "related", "form", "header"])
@pytest.mark.parametrize("inner", [BODY, f"<article>{BODY}</article>"])
def test_a_label_around_the_article(label, inner):
    got = h.main_text(f'<body>{MENU}<div class="{label}">{inner}</div><div class="sidebar"><p>other things</p></div></body>', W)
    assert got.startswith("A heading here\nsome words") and got.count("story") == 4 and "other" not in got and "home" not in got


@pytest.mark.parametrize("page", [f"<form id='aspnetForm'>{MENU}{BODY}</form>", f'<div class="entry-header"><h1>A heading here</h1></div>{LINE * 4}', f'<div class="article-header"><h1>A heading here</h1></div>{LINE * 4}', f'<article><header class="entry-header"><h1>A heading here</h1></header>{LINE * 4}<div class="share">share this</div></article>'])
def test_headings_and_forms(page):
    assert h.main_text(page, W) == "A heading here" + "\nsome words of the story go here and on" * 4


def test_a_paragraph_with_a_compound_label_stays():
    assert "notice period" in h.main_text(f'{BODY}<p class="notice-period">the notice period is a month</p>{BODY}', W)


@pytest.mark.parametrize("name", ["svg", "math", "object", "iframe", "canvas", "select"])
@pytest.mark.parametrize("end", ["/>", ">"])
def test_elements_that_stay_open_swallow_nothing(name, end):
    got = h.main_text(f'<p>first words of it</p><{name} class="i"{end}<p>second words of it</p>', W)
    assert got == "first words of it\nsecond words of it"
    assert h.main_text(f"<p>first words</p><{name}><b>drawn</b></{name}><p>third words</p>", W) == "first words\nthird words"


def test_unlabelled_menus_and_footers_need_the_scan(monkeypatch):
    page = '<body><ul class="col-3">' + "".join(f"<li><a href=/{i}>Item {i}</a></li>" for i in range(24)) + f'</ul>{BODY}<ul><li><a href="/x">More of it</a></li></ul></body>'
    want = "A heading here" + "\nsome words of the story go here and on" * 4
    assert h.main_text(page, W) == want
    monkeypatch.setattr(h, "best_run", lambda s: (0, len(s)))
    assert h.main_text(page, W) != want
    monkeypatch.undo()
    assert h.main_text(page, {}) != want


def test_learnt_weights_find_held_out_articles_without_their_marks(prose, rnd):
    def page(marked):
        chrome = '<div class="zz1">' + "".join(f"<a href=x>{w}</a> " for w in prose(6).split()) + "</div>"
        story = [prose(rnd.randint(3, 8)), *(prose(rnd.randint(5, 60)) for _ in range(rnd.randint(2, 6)))]
        inner = f"<h1>{story[0]}</h1>" + "".join(f"<p>{s}</p>" for s in story[1:])
        mark = "article" if marked else "div"
        return f'<body>{chrome}<div class="zz2 q"><p>{prose(12)}</p></div><{mark}>{inner}</{mark}><div class="zz3"><p>{prose(9)}</p></div></body>', "\n".join(story)

    learnt = weights([page(True)[0] for _ in range(60)])
    got = [(set(h.main_text(p, learnt).split()), set(want.split())) for p, want in (page(False) for _ in range(40))]
    assert sum(len(a & b) / len(b) for a, b in got) / 40 >= 0.95
    assert sum(len(a & b) / max(1, len(a)) for a, b in got) / 40 >= 0.95
    blind = [(set(h.main_text(p, W).split()), set(want.split())) for p, want in (page(False) for _ in range(40))]
    assert sum(len(a & b) / max(1, len(a)) for a, b in blind) / 40 < 0.95  # what the given pages mark decides


def test_a_table_of_pages(spark, prose):
    chrome = "<div><a>home</a> <a>about</a></div>" * 5
    marked = [(i, f"u{i}", f"<body>{chrome}<article><h1>{prose(4)}</h1><p>{prose(40)}</p><p>{prose(30)}</p></article>{chrome}</body>", "t", 1) for i in range(40)]
    a, b = prose(40), prose(20)
    bare = [(100, "u", f"<body>{chrome}<section><p>{a}</p><p>{b}</p></section>{chrome}</body>", "t", 1), (101, None, None, "t", 1), (None, "v", "", "t", 1), (100, "u", f"<p>{a}", "t", 1)]
    df = spark.createDataFrame(marked + bare, "page_id long, url string, html string, text string, n_chars int")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in h.extract(df).collect() if r["page_id"] == 100)
    assert got == sorted([(100, f"{a}\n{b}", len(a) + len(b) + 1), (100, a, len(a))])
    assert h.extract(df).count() == 44
    assert h.extract(df.limit(0)).count() == 0


def test_deep_pages_take_linear_time():
    assert "x" in h.main_text("<div>" * 60_000 + "x" + "</span>" * 60_000 + "<i>" * 60_000 + "y" + "</p>" * 1_000, W)
    assert h.main_text("<svg>" * 60_000 + "<p>some words", W) == "some words"
    assert "x" in h.main_text("".join(f'<div class="c{i}">' for i in range(60_000)) + "x", W)


def test_long_page():
    assert h.main_text("<p>" + "word " * 200_000, W).count("word") == 200_000
