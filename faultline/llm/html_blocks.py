"""Flat text blocks of HTML pages, and a decision tree that tells article blocks.

Features of a block are its words and the share of them in links, the same of
the blocks before and after it, and a few facts on where it stands: in the
article's element or not, how far the element named as something else that
holds it can be believed, in a paragraph's element or not, and whether equal
elements that each have a date stand side by side, as readers' comments do.  A
name on what holds nearly all text of a page is one of its layout.  The tree is
trained on ``LABELLED``, a small table of pages given block by block.

A page is read once, in time linear in its length however deep its elements nest.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html import unescape

import numpy as np

# A quote delimits a value right after "="; anywhere else it is part of a name or value.
ATTRIBUTE = r"""[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]*))?"""
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:{ATTRIBUTE}|[\s/=])*))(?:>|\Z)""", re.S)
NAMED = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
DATE = re.compile(r"\b\d{4}-\d\d?-\d\d?\b|\b\d\d?[./]\d\d?[./]\d{2,4}\b|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?\s+\d{1,4}\b"
                  r"|\b\d+\s+(?:min|minute|hour|day|week|month|year)s?\s+ago\b", re.I)
PIECES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Names in HTML, and words that page authors use for parts of a page.
SKIPPED = {"head", "script", "style", "title", "textarea", "select", "button", "iframe", "svg", "template", "object", "canvas", "noscript", "math", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label",
          "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_ITSELF = {"p": {"p"}, "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "td", "th", "tr"},
                 "td": {"p", "td", "th"}, "th": {"p", "td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ASIDE_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "fieldset", "address"}
EQUALS = 3                        # equal elements side by side that can be readers' comments
ASIDE_WORDS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored",
               "cookie", "cookies", "consent", "gdpr", "notice", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe",
               "subscription", "signup", "sidebar", "sidebars", "aside", "widget", "widgets", "related", "recommended", "recommendations", "share",
               "sharing", "social", "comment", "comments", "commentlist", "discussion", "replies", "reply", "respond", "disqus", "menu", "nav",
               "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "toolbar", "pagination", "pager", "login", "search",
               "form", "copyright", "disclaimer", "complementary", "contentinfo", "dialog", "alertdialog"}
SURE_TAGS = ASIDE_TAGS - {"form", "fieldset"} | {"header"}            # a page can stand in one form
PAGE_TAGS, MAIN_TAGS = {"html", "body"}, {"article", "main"}       # their classes name the layout of the page
MAIN_WORDS = {"article", "articlebody", "main", "post", "entry", "story"}

# Fixed values, the labelled table: pages as blocks "words/linked words kind", + for article text.
# kind: m inside the article's element, b inside a part named as something else, B inside one that wraps the page, h heading,
# p paragraph's element, r in one of equal dated elements.
LABELLED = [
    "1/1b 1/1b 1/1b 7/0b +12/0mh +60/0m +2/0m +25/0m +8/0m +1/0m 9/0b",
    "1/1 2/2 1/1 8/0 +9/0mh +35/1m +5/0m +90/6m +3/0m 12/0 14/2",
    "30/0 3/0h 1/1 +7/0mh +4/0m +120/10m 8/0mb 25/0mb +44/0m 6/6mb 40/0mb 33/1mb 10/0",
    "5/0b 1/1b +11/0mh +1/0m 20/0b 45/0b 60/0b 6/1b",
    "1/1 1/1 2/2 1/1 +8/0h +45/0 +70/2 +3/0 +52/1 +9/0h +80/4 +38/0 5/5 6/6 4/4 7/1",
    "2/2 3/3 2/2 1/0 +10/0h +33/0 +6/0 +64/0 +20/1 +41/0 3/0h 7/7 8/8 6/6 9/2 5/0",
    "4/4 2/1 6/0 +9/0h +110/3 +95/0 +130/9 +12/0 +85/0 2/0 4/3 3/3 8/0",
    "3/3 3/3 12/11 15/9 +40/0 +55/2 +28/0 +60/0 10/8 9/9 2/2 4/0",
    "1/1b 9/0b 26/0b +7/0h +50/0 +2/0 +75/1 +19/0 34/0b 28/0b 48/3b 6/0b",
    "1/1 1/1 22/0b 35/0b +6/0h +31/0 +44/0 +58/3 18/0b 3/0h 5/5 5/5 9/0",
    "2/0b +14/0mh +200/0m +7/0m +15/15m +30/2m 50/0b 70/0b 8/8b 3/0b",
    "6/1 2/2 2/2 5/0h 6/6 7/7 5/0h 8/8 7/6 6/6 5/1",
    "3/0b 2/2 2/2 +5/0mh +3/0m +4/0m 55/0 62/1 47/0 10/0",
    "1/1 1/1 2/2 +4/0h +12/2 +40/6 +55/12 +30/4 +24/9 8/8 6/6 9/2 5/0",
    "1/1 4/4 +8/0h +27/0 +60/23 +19/5 +18/0 6/6 14/2",
    "3/3 +6/0h +24/0 +34/4 +52/19 8/8 2/2",
    "+15/0",
    "+1/0",
    "+4/0 +6/0",
    "+6/0h +2/0 +30/0",
    "+3/0h +1/0",
    "3/0 1/1B 2/2B +8/0Bh +45/0B +60/3B +12/0B +38/1B 30/0b 25/0b 4/4B 6/0",
    "1/1B 1/1B +6/0Bh +28/0B +90/4B 5/5B 6/6B 3/0B",
    "2/0 +7/0Bh +20/0B +55/0B 12/0b 40/0b 35/1b 3/2B",
    "+5/0h +40/0 +30/0 60/0b 45/0b 50/1b 80/0b 65/0b 70/2b 30/0b",
    "1/1b 1/1b +7/0mh +40/0mp +4/4m +5/5m +3/3m +60/1mp 9/0b",
    "2/2 2/2 +8/0mh +25/0mp +6/6m +2/2m +4/3m +7/7m +30/0mp +55/2mp 10/3",
    "+6/0mh +12/0mp +5/5m +5/5m +44/0mp",
    "1/1 +8/0mh +60/0mp +80/1mp 3/0mr 30/0mr 4/0mr 25/1mrp 3/0mr 45/0mrp 2/0b",
    "1/1 2/2 +8/0h +60/0p +80/1p 3/0r 30/0rp 4/0r 25/1rp 3/0r 45/0rp 4/2",
    "+5/0mh +90/0mp 2/0mrp 14/0mrp 2/0mrp 60/0mrp 3/1mr 9/0mr",
    "1/1mb 2/2mb 1/1mb +6/0mh +30/0mp +4/4m +50/1mp 3/3mb 2/2mb",
    "2/2mb +5/0mh +20/0m +60/0m +5/5m +6/6m +45/0m 7/7mb 9/9mb",
    "+7/0mh +22/0mp +1/0mp",
    "1/1b +5/0mh +40/0m +3/0m",
    "2/2b 1/1b +3/0mh +90/2mp +8/0mp +2/0mp 6/0b 3/3b",
    "1/1 +6/0mh +33/0mp +12/0mp +3/0m",
    "+40/1m +2/0m",
    "2/2 1/1 +1/0mh +2/0m +5/0m +1/0m",
    "1/1 1/1 2/2 +4/0p",
    "1/1b 2/2b 1/1b +4/0p",
    "3/3 1/1 +6/0p +3/0p 2/2",
    "2/2 1/1 1/1 +3/0h +4/0p",
    "2/2 +9/0h +35/0 +50/2 40/0b 90/0b 120/0b 75/0b 60/1b 85/0b 70/0b 44/0b 21/0b 10/0b 35/0b",
]


def _facts(tag: str, attrs: str, main: bool) -> tuple[int, int]:
    """Whether this element is the article's (1 by its name, 2 by its tag), and whether it is another part (1 by its name, 2 for sure)."""
    words, hidden = set(), False
    if attrs and ("=" in attrs or "hidden" in attrs):
        for name, *v in NAMED.findall(attrs):
            name, value = name.lower(), v[0] or v[1] or v[2]
            if name in ("hidden", "aria-hidden"):
                hidden |= value.lower() != "false"
            elif name in ("class", "id", "role", "itemprop"):
                words.update(x.lower() for x in PIECES.findall(value))
    if tag in PAGE_TAGS:
        return 0, 0
    if tag in MAIN_TAGS:
        return 2, 2 * hidden
    sure = hidden or (tag in SURE_TAGS and not (main and tag == "header"))
    named = tag in ASIDE_TAGS or bool(words & ASIDE_WORDS) or (not main and "header" in words) or any(w.startswith("cookie") for w in words)
    return int(bool(words & MAIN_WORDS)), 2 if sure else int(named)


class Outline:
    """A page's blocks and the marked elements around them; an element is a number and points to the one around it.

    ``parts``: (part around, 1 or 2 as in ``_facts``), ``mains``: (main around, 1 or 2, part around), with -1 for none.
    ``blocks``: (words, linked words, heading, innermost main, innermost part, paragraph, equal dated elements).
    """

    def __init__(self):
        self.parts: list[tuple[int, int]] = []
        self.mains: list[tuple[int, int, int]] = []
        self.blocks: list[tuple] = []

    def place(self) -> list[tuple[int, int, bool, int, float, bool, bool]]:
        """(words, linked words, heading, place, mark, paragraph, equal dated elements) of the blocks.

        Place: 2 in the article's element, 0 outside it, 1 where that says nothing.
        Mark: 0 in a part that is something else for sure, 1 in none, else the
        share of the innermost part in the unlinked words that are its own or of no
        part but those around it; 0 beside a part of more words.
        """
        parts, mains = self.parts, self.mains
        sure = []
        for up, kind in parts:
            sure.append(kind == 2 or (up >= 0 and sure[up]))
        own, held, free_own, total = [0] * len(parts), [0] * len(mains), 0, 0
        for words, linked, _, main, part, *_ in self.blocks:
            total += words - linked
            if part >= 0 and sure[part]:
                continue
            if part >= 0:
                own[part] += words - linked
            else:
                free_own += words - linked
            if main >= 0:
                held[main] += words - linked
        # Elements come after those around them: sums go up from the last, sums of what is around go down from the first.
        whole, above, most = list(own), [0] * len(parts), {}
        for n in range(len(parts) - 1, -1, -1):
            if parts[n][0] >= 0:
                whole[parts[n][0]] += whole[n]
        for n in range(len(mains) - 1, -1, -1):
            if mains[n][0] >= 0:
                held[mains[n][0]] += held[n]
        for n, (up, _) in enumerate(parts):
            above[n] = free_own if up < 0 else above[up] + own[up]
            most[up] = max(most.get(up, 0), whole[n])
        # Parts around the article's element are layout: the largest one that stands in no part, or holds half of the page.
        tagged = [n for n, (_, kind, _) in enumerate(mains) if kind == 2 and held[n]]
        best = max((n for n in tagged if mains[n][2] < 0), key=held.__getitem__, default=max(tagged, key=held.__getitem__, default=None))
        layout = set()
        if best is not None and (mains[best][2] < 0 or 2 * held[best] >= total):
            up = mains[best][2]
            while up >= 0:
                layout.add(up)
                up = parts[up][0]
        mark = [1.0 if n in layout else own[n] / max(own[n] + above[n], 1) if whole[n] == most[parts[n][0]] else 0.0 for n in range(len(parts))]
        marks = [1.0 if part < 0 else 0.0 if sure[part] else mark[part] for *_, part, _, _ in self.blocks]
        # The article's element tells what is outside it if it holds most text, or is the only one by its tag and more than a heading.
        outer = []
        for n, (up, _, _) in enumerate(mains):
            outer.append(n if up < 0 else outer[up])
        inside = outside = 0
        ones, body = set(), False
        for (words, linked, heading, main, *_), k in zip(self.blocks, marks, strict=True):
            if k < 0.5:
                continue
            if main >= 0:
                inside += words - linked
                ones.add(outer[main])
                body |= not heading
            else:
                outside += words - linked
        tells = bool(ones) and (inside >= outside or (body and len(ones) == 1 and all(mains[n][1] == 2 for n in ones)))
        return [(words, linked, heading, 2 if main >= 0 else 0 if tells else 1, k, para, equal)
                for (words, linked, heading, main, _, para, equal), k in zip(self.blocks, marks, strict=True)]


class _Elements:
    """Elements of a page that hold blocks: which of them are one of several equal ones that each have a date."""

    def __init__(self):
        self.up, self.group, self.sizes, self.dated, self.words = [], [], {}, {}, {}
        self.has_date: set[int] = set()

    def open(self, up: int, tag: str, attrs: str) -> int:
        n = len(self.up)
        key = None if tag in NOT_EQUAL or up < 0 else (up, tag, attrs.strip())
        self.up.append(up)
        self.group.append(key)
        if key is not None:
            self.sizes[key] = self.sizes.get(key, 0) + 1
        return n

    def date(self, n: int) -> None:
        """A date stands in element n: so it does in those around it, each told once."""
        while n >= 0 and n not in self.has_date:
            self.has_date.add(n)
            if self.group[n] is not None:
                self.dated[self.group[n]] = self.dated.get(self.group[n], 0) + 1
            n = self.up[n]

    def equal(self, held: list[tuple[int, int]]) -> list[bool]:
        """Whether each of the blocks ``held`` (element, unlinked words) is in one of equal dated elements, which hold less than most of the text."""
        inside = [0] * len(self.up)
        for n, words in held:
            if n >= 0:
                inside[n] += words
        for n in range(len(self.up) - 1, -1, -1):
            if self.up[n] >= 0:
                inside[self.up[n]] += inside[n]
        for n, key in enumerate(self.group):
            if key is not None:
                self.words[key] = self.words.get(key, 0) + inside[n]
        total = sum(words for _, words in held)
        flag = []
        for n, key in enumerate(self.group):
            own = key is not None and self.sizes[key] >= EQUALS and self.dated.get(key, 0) >= 0.6 * self.sizes[key] and self.words[key] < 0.7 * total
            flag.append(own or (self.up[n] >= 0 and flag[self.up[n]]))
        return [n >= 0 and flag[n] for n, _ in held]


NOT_EQUAL = {"p", "td", "th", "tr", "dt", "dd", "tbody", "table", "br"} | HEADINGS


def blocks(html: str) -> tuple[list[str], Outline]:
    """The texts of a page's blocks, in its order, and its outline."""
    texts, page, elements, held = [], Outline(), _Elements(), []
    text, linked = [], [0]
    stack: list[tuple[str, int, int, int]] = []               # (tag, innermost main, innermost part, element)
    open_tags: dict[str, int] = {}
    heading = link = dated = False
    link_text: list[str] = []

    def end_link() -> None:
        if link_text:
            linked[0] += len("".join(link_text).split())
            link_text.clear()

    def flush() -> None:
        nonlocal dated
        end_link()
        if text:
            words = unescape("".join(text)).split()
            if words:
                tag, main, part, element = stack[-1] if stack else ("", -1, -1, -1)
                texts.append(" ".join(words))
                n = min(linked[0], len(words))
                page.blocks.append((len(words), n, heading, main, part, tag in ("p", "blockquote", "pre")))
                held.append((element, len(words) - n))
                if dated or (len(words) <= 12 and DATE.search(texts[-1])):
                    elements.date(element)
            text.clear()
        linked[0], dated = 0, False

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        raw = html[at:m.start() if m else n]
        if raw:
            text.append(raw)
            if link:
                link_text.append(raw)
        if not m:
            break
        at = m.end()
        close, tag, attrs = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag in SKIPPED:
            if not close and not attrs.endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                body = re.compile(r"<body[\s>]", re.I).search(html, at) if tag == "head" and not stop else None
                at = stop.end() if stop else body.start() if body else n
            if tag not in ("script", "style"):
                text.append(" ")
        elif tag == "a":
            end_link()
            link = not close
        elif tag in INLINE:
            dated |= tag == "time"
        elif tag in VOID:
            text.append(" ")
        else:
            flush()
            heading = tag in HEADINGS and not close
            if close:
                if open_tags.get(tag):
                    while True:
                        last = stack.pop()[0]
                        open_tags[last] -= 1
                        if last == tag:
                            break
            else:
                while stack and stack[-1][0] in CLOSES_ITSELF.get(tag, {"p"}):
                    open_tags[stack.pop()[0]] -= 1
                if not attrs.endswith("/") or tag not in ("p", "div", "li"):
                    _, main, part, up = stack[-1] if stack else ("", -1, -1, -1)
                    is_main, is_part = _facts(tag, attrs, main >= 0)
                    if is_main:
                        page.mains.append((main, is_main, part))
                        main = len(page.mains) - 1
                    if is_part:
                        page.parts.append((part, is_part))
                        part = len(page.parts) - 1
                    stack.append((tag, main, part, elements.open(up, tag, attrs)))
                    open_tags[tag] = open_tags.get(tag, 0) + 1
    flush()
    page.blocks = [(*b, e) for b, e in zip(page.blocks, elements.equal(held), strict=True)]
    return texts, page


def features(page: Outline) -> np.ndarray:
    """One row for each block of a page."""
    x = np.array(page.place(), float).reshape(-1, 7)
    own = np.stack([x[:, 0], x[:, 1] / np.maximum(x[:, 0], 1)], 1)
    edge = np.zeros((1, 2))
    before, after = np.concatenate([edge, own])[:len(x)], np.concatenate([own, edge])[1:]
    return np.column_stack([own, before, after, x[:, 2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 14):
    """A decision tree by Gini impurity: (feature, threshold, low, high), or the share of label 1."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return float(y.mean()) if len(y) else 0.0
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        if len(cut):
            a, b = ones[cut - 1], ones[-1] - ones[cut - 1]
            cost = 2 * a * (1 - a / cut) + 2 * b * (1 - b / (len(y) - cut))
            k = int(cost.argmin())
            if cost[k] < best[0] - 1e-12:
                best = (float(cost[k]), f, float((v[cut[k] - 1] + v[cut[k]]) / 2))
    if best[0] == np.inf:
        return float(y.mean())
    low = x[:, best[1]] <= best[2]
    return best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def share(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    low = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = share(tree[2], x[low]), share(tree[3], x[~low])
    return out


def labelled() -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for line in LABELLED:
        page, fresh = Outline(), True
        page.mains.append((-1, 2, -1))
        outer = -1
        if "B" in line:
            page.parts.append((-1, 1))
            outer = 0
        for b in line.split():
            w, linked, kind = re.fullmatch(r"\+?(\d+)/(\d+)([mbBhpr]*)", b).groups()
            if "b" in kind and fresh:                            # neighbours of kind b are in one part
                page.parts.append((outer, 1))
            fresh = "b" not in kind
            page.blocks.append((int(w), int(linked), "h" in kind, 0 if "m" in kind else -1,
                                len(page.parts) - 1 if "b" in kind else outer if "B" in kind else -1, "p" in kind, "r" in kind))
            ys.append(b[0] == "+")
        xs.append(features(page))
    return np.concatenate(xs), np.array(ys, float)


@lru_cache(1)
def tree():
    return grow(*labelled())


def main_texts(pages: list[str]) -> list[str]:
    """The article's text of each page."""
    found = [blocks(p) for p in pages]
    x = np.concatenate([np.zeros((0, 11)), *[features(page) for texts, page in found if texts]])
    keep = share(tree(), x) >= 0.5
    out, at = [], 0
    for texts, _ in found:
        out.append(" ".join(t for t, k in zip(texts, keep[at:at + len(texts)].tolist(), strict=True) if k))
        at += len(texts)
    return out
