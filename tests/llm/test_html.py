"""Main text of pages (10)."""

import html
import re

import pytest
from conftest import SF01
from faultline.llm import html_blocks
from faultline.llm.html_text import extract_text

LONG = "the quick brown fox jumps over the lazy dog and then it walks all the way home again to sleep until noon"


@pytest.mark.parametrize("page,want", [
    ("", ""), ("<p", ""), ("a &lt;b&gt; &amp; &eacute;&#x41;", "a <b> & éA"),
    ("<p>one<br>two  \n three</p><!-- no -->", "one two three"),
    (f"<div>{LONG}<script>var a = '<p>x</p>';</script> end</div>", f"{LONG} end"),
    (f"<nav><a href='a>b'>Home</a></nav><article><h1>Title</h1><p>{LONG}<p>Short.</article><footer>&copy; us</footer>", f"Title {LONG} Short."),
    (f"<header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>{LONG}</p><aside>no</aside>"
     "<section id='comments'><p>I think so too, dear author, and I hope you write much more of it soon</p></section></article></main>", f"T {LONG}"),
    (f"<div class='cookie-notice'>{LONG}</div><div id=x><p>{LONG}</p></div><div class='sidebar'>{LONG}</div><form>{LONG}</form>", LONG),
    (f"<article><p>{LONG} <b>bold</b>er <a href=x>link</a></p><p class=ad>{LONG}</p><p>cut o", f"{LONG} bolder link cut o"),
])
def test_cases(page, want):
    assert html_blocks.main_texts([page]) == [want]


NAV = "<ul class=menu><li><a href=a>Home</a><li><a href=b>About us</a></ul>"
BODY = f"<h1>Some title</h1><p>{LONG}</p><p>{LONG} {LONG}</p><p>{LONG}</p>"
SIDE = f"<div class=sidebar><p>{LONG}</p><p>{LONG}</p></div>"
TEXT = f"Some title {LONG} {LONG} {LONG} {LONG}"


@pytest.mark.parametrize("page", [
    f"<body class='has-sidebar'>{NAV}<article>{BODY}</article>{SIDE}</body>",
    f"<body class='home has-sidebar sticky-header'>{NAV}<div id=x>{BODY}</div>{SIDE}</body>",
    f"<html class='no-cookie-notice'><body>{NAV}<main class='with-sidebar'>{BODY}</main>{SIDE}</body>",
    f"<div class='right-sidebar single-post'>{NAV}<article>{BODY}</article>{SIDE}</div>",
    f"<div class='right-sidebar single-post'>{NAV}{BODY}{SIDE}</div>",
    f"<div class='sticky-header'>{NAV}<div>{BODY}</div>{SIDE}</div>",
    f"<body><form action=/ method=post>{NAV}<div>{BODY}</div>{SIDE}</form></body>",
    f"<body><form action=/ method=post><div class='layout-sidebar'>{NAV}<article>{BODY}</article>{SIDE}</div></form></body>",
    f"<body>{NAV}<div>{BODY.replace('<h1>', '<h1 class=post-title>')}</div>{SIDE}</body>",
    f"<body>{NAV}<div>{BODY}</div><div id=comments>{f'<p>{LONG}</p>' * 9}</div></body>",
    f"<body>{NAV}<article>{BODY}</article><ol class=comment-list>{f'<li><article>{LONG} {LONG}</article>' * 9}</ol></body>",
    f"<body>{NAV}<article>{BODY}</article><form>{f'<p>{LONG}</p>' * 99}</form><div hidden>{f'<p>{LONG}</p>' * 99}</div></body>",
])
def test_names_of_the_layout_do_not_hide_the_article(page):
    assert html_blocks.main_texts([page]) == [TEXT]


@pytest.mark.parametrize("linked", [(4, 4, 4), (6, 3, 9), (0, 8, 5), (2, 16, 12), (16, 10, 4)])
@pytest.mark.parametrize("words", [(12, 40, 30), (24, 60, 41), (27, 45, 90), (40, 40, 40)])
@pytest.mark.parametrize("title", ["Cat", "A somewhat longer title of the page"])
def test_linked_paragraphs_and_titles_after_menus_are_kept(linked, words, title):
    linked = [max(0, min(k, n * 2 // 5)) for k, n in zip(linked, words, strict=True)]
    text = [" ".join(f"w{i}" for i in range(n)) for n in words]
    paras = "".join(f"<p><a href=x>{' '.join(t.split()[:k])}</a> {' '.join(t.split()[k:])}</p>" for t, k in zip(text, linked, strict=True))
    menu, foot = (f"<ul>{''.join(f'<li><a href=a>{x}</a>' for x in xs)}</ul>" for xs in (["Home", "About us", "All pages"], ["Some other page", "Next one"]))
    page = f"<body><div id=top>{menu}</div><div id=content><h1>{title}</h1>{paras}</div><div>{foot}</div></body>"
    assert html_blocks.main_texts([page]) == [" ".join([title, *text])]


def test_tree_fits_its_table():
    x, y = html_blocks.labelled()
    assert ((html_blocks.share(html_blocks.tree(), x) >= 0.5) == (y > 0)).all()


def test_pages_of_the_test_data(spark):
    rows = spark.read.parquet(f"{SF01}/pages.parquet")
    got = {r.page_id: r for r in extract_text(rows).collect()}
    for r in rows.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", inner).replace("<b>", "").replace("</b>", "")).split())
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


def test_edges(spark):
    df = spark.createDataFrame([(1, None, None, 1), (None, "u", "<p>&#xD800;x</p>", 2), (2, "u", "", 3), (2, "u", "", 3)],
                               "page_id long, url string, html string, text int")
    got = sorted((str(r.page_id), str(r.url), r.n_chars) for r in extract_text(df).collect())
    assert got == [("1", "None", 0), ("2", "u", 0), ("2", "u", 0), ("None", "u", 2)]
    assert extract_text(df.where("false")).count() == 0


@pytest.mark.parametrize("page,want", [
    ('<p class=lead">one</p><p class="x">two</p><p class=y">three</p>', "one two three"),
    ("<p title=Bob's>one</p><p>two it's</p>", "one two it's"),
    ("<p a=it's b=o'c>one</p><p c='>'>two</p>", "one two"),
    ('<p "x" y">one</p><p z="a>b" w=\'c>d\'>two</p><p "">three</p>', "one two three"),
    ('<p title="never closed>one</p><p>two</p>', "one two"),
    ("<p title = 'a > b' >one</p><p title = >two</p><p =>three</p>", "one two three"),
    ("<p href=a=\"b>one</p><p>two</p>", "one two"),
])
def test_stray_quotes_lose_no_text(page, want):
    body = f"<p>{LONG}</p>"
    assert html_blocks.main_texts([body + page + body]) == [f"{LONG} {want} {LONG}"]


@pytest.mark.parametrize("page,want", [
    (f"<article><h1>T</h1><p>{LONG}</p><ul><li><a href=a>One link</a><li><a href=b>Other linked item</a><li><a href=c>Third one</a></ul><p>{LONG}</p></article>",
     f"T {LONG} One link Other linked item Third one {LONG}"),
    ("<ul><li><a href=a>Home</a><li><a href=b>About</a></ul><p>Four words stand here</p>", "Four words stand here"),
    (f"<main><h1>T</h1><p>{LONG}</p><p>{LONG}</p><section class=reviews>" + "".join(
        f"<div class=r><b>{n}</b><p><time>{i} May</time></p><p>{LONG[:30 + 20 * i]}</p></div>" for i, n in enumerate(["Ann", "Bo", "Cy"])) + "</section></main>",
     f"T {LONG} {LONG}"),
    (f"<div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div>" + "".join(f"<div><span>{n}</span><p>2020-05-0{i + 1}</p><p>{LONG[:40]}</p></div>" for i, n in enumerate("abc")) + "</div>",
     f"T {LONG} {LONG}"),
    (f"<main><div role=dialog class=cc-window>We use cookies here, so please accept.</div><h1>T</h1><p>{LONG}</p></main>", f"T {LONG}"),
    (f"<article><h1>T</h1>" + f"<section><h2>Part</h2><p>{LONG}</p></section>" * 4 + "</article>", "T" + f" Part {LONG}" * 4),
])
def test_lists_comments_and_notices(page, want):
    assert html_blocks.main_texts([page]) == [want]


def test_nesting_takes_linear_time():
    import time
    for page in ('<div class="nav">a b' * 30_000, '<article>a <div class="ad">b' * 15_000, "<b>x</p>" * 100_000, "<div><p>x" * 30_000,
                 "<p a='" + '<p a="b">' * 50_000):
        t = time.process_time()
        html_blocks.main_texts([page])
        assert time.process_time() - t < 3


def plain_place(blocks):
    """Places and marks from each block's own lists of elements around it, sums taken anew for every question.

    A block: (words, linked, heading, mains, parts), an element: (number, kind, numbers of the parts around it).
    """
    live = [b for b in blocks if all(k < 2 for _, k, _ in b[4])]
    own = lambda n: sum(b[0] - b[1] for b in live if (b[4][-1][0] if b[4] else None) == n)                 # noqa: E731
    whole = lambda n: sum(b[0] - b[1] for b in live if any(p[0] == n for p in b[4]))                      # noqa: E731
    held = {m: sum(b[0] - b[1] for b in live if m in b[3]) for b in live for m in b[3] if m[1] == 2}
    held = {m: n for m, n in held.items() if n}
    free = [m for m in held if not m[2]]
    best = max(free or held, key=lambda m: (held[m], -m[0]), default=None)
    layout = set(best[2]) if best and (not best[2] or 2 * held[best] >= sum(b[0] - b[1] for b in blocks)) else set()
    around = {p[0]: p[2] for b in blocks for p in b[4]}

    def mark(b):
        if any(k == 2 for _, k, _ in b[4]):
            return 0.0
        if not b[4]:
            return 1.0
        n, _, up = b[4][-1]
        if n in layout:
            return 1.0
        if whole(n) < max(whole(o) for o in around if around[o] == up):
            return 0.0
        return own(n) / max(own(n) + own(None) + sum(own(u) for u in up), 1)

    marks = [mark(b) for b in blocks]
    good = [b for b, k in zip(blocks, marks, strict=True) if k >= 0.5]
    inside, outside = (sum(b[0] - b[1] for b in good if bool(b[3]) == x) for x in (True, False))
    ones = {b[3][0][:2] for b in good if b[3]}
    tells = bool(ones) and (inside >= outside or (any(b[3] and not b[2] for b in good) and len(ones) == 1 and all(k == 2 for _, k in ones)))
    return [(b[0], b[1], b[2], 2 if b[3] else 0 if tells else 1, k) for b, k in zip(blocks, marks, strict=True)]


def test_blocks_and_places_equal_a_plain_version():
    import random
    rng = random.Random(7)
    kinds = [("div", "", 0, 0), ("section", " class=x", 0, 0), ("article", "", 2, 0), ("main", "", 2, 0), ("div", " class='post'", 1, 0), ("div", " id=sidebar", 0, 1),
             ("aside", "", 0, 2), ("form", "", 0, 1), ("div", " hidden", 0, 2), ("div", " class='post promo'", 1, 1), ("footer", "", 0, 2)]
    for _ in range(300):
        texts, blocks, count = [], [], [0]

        def build(depth, mains, parts):
            out = ""
            for _ in range(rng.randint(1, 3)):
                if depth < 5 and rng.random() < 0.6:
                    tag, attrs, main, part = rng.choice(kinds)
                    count[0] += 1
                    n = count[0]
                    m = (*mains, (n, main, tuple(p[0] for p in parts))) if main else mains
                    p = (*parts, (n, part, tuple(p[0] for p in parts))) if part else parts
                    out += f"<{tag}{attrs}>{build(depth + 1, m, p)}</{tag}>"
                else:
                    tag, words, linked = rng.choice(["p", "h2", "div"]), rng.randint(1, 30), rng.choice([0, 0, 1, 5])
                    linked = min(linked, words)
                    ws = [f"w{rng.randint(0, 99)}" for _ in range(words)]
                    texts.append(" ".join(ws))
                    blocks.append((words, linked, tag == "h2", mains, parts))
                    link = f"<a href=x>{' '.join(ws[:linked])}</a> " if linked else ""
                    out += f"<{tag}>{link}{' '.join(ws[linked:])}</{tag}>"
            return out

        got_texts, outline = html_blocks.blocks(build(0, (), ()))
        assert got_texts == texts
        got = [(w, li, h, pl, pytest.approx(k)) for w, li, h, pl, k, *_ in outline.place()]
        assert plain_place(blocks) == got
