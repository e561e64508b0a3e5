"""Main text of web pages: flat text blocks, classified by a decision tree.

A page is cut into flat blocks at block-level tags.  A block's features are its word count and link density, those of the two
blocks before and the two after it, whether it is a heading, and what surrounds it: an article (or none on the page), page furniture
(navigation, headers, footers, asides, forms) and class, id or role names that say so.  A small decision tree (Gini, trained
here on `labelled_pages`, some thousand labelled blocks made by a rule) says which blocks are main text.  On pages whose mark-up says
nothing, half of the labelled ones, word counts and link densities alone decide.

A name counts only if it is a whole class, id or role and all its parts are telling or neutral ones ("comment-list", not
"comment-policy-study"), or one other part before a telling one ("reader-comments", not on headings, whose names are anchors) or related matter
("related-posts"), and never on an article itself.  A form is furniture, but not one that holds most of the page's words and a long block: it wraps the page.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page order by
one space.  Scripts, styles, templates, comments, the head and hidden elements are not text.

Edge cases: a null or empty page gives the empty string; pages of any length are taken whole; unclosed and misnested tags
are closed like a browser does for paragraphs and list items; an unclosed script or style ends with the element around it; a tag cut off by
the end of the page is dropped; repeated rows are treated alike; an empty table gives an empty result; an existing column of the output's
name is replaced.
"""
from __future__ import annotations

import html
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_arrow

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/"']++)(?:\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s>"']*+)))?+|.""", re.S)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

#: Elements whose content is no mark-up and no text of the page (fixed names of HTML).
RAW = {"script", "style", "noscript", "iframe", "textarea", "title"}
#: Elements that end a block.
BLOCK = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section select summary table tbody td template tfoot th thead tr ul".split())
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element of these is closed by the opening of the others.
CLOSED_BY = {"p": BLOCK - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}}
FURNITURE = {"nav", "footer", "aside", "menu", "button", "dialog", "search", "label", "fieldset", "select"}
FURNITURE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form", "toolbar", "tablist"}
#: Parts of class and id names that tell furniture, that tell main text, and that tell nothing.
TELLING = set("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments consent cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup privacy promo promoted promotion related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toc toolbar topbar".split())
CONTENT = set("article articlebody content entry maincontent maintext post prose story".split())
NEUTRAL = set("area bar body block bottom box button buttons col column container group inner item items left link links list main middle outer page panel right row section site slot text top unit widget wrap wrapper".split())
#: Parts that tell furniture before the others: names of lists of other pages.
RELATED, OTHERS = {"related", "recommended", "similar", "popular", "trending"}, {"posts", "post", "articles", "article", "stories", "story", "content", "news", "reading", "pages"}
#: Words of a block that is long, for forms.
LONG_BLOCK = 20
FEATURES = ("words", "link_density", "words_before_2", "link_density_before_2", "words_before", "link_density_before", "words_after", "link_density_after", "words_after_2", "link_density_after_2", "heading", "in_article", "in_named_content", "in_furniture", "in_telling", "page_has_article")


def tells(value: str, parts: set[str]) -> bool:
    """Whether a name, of several in an attribute, has such a part and otherwise only neutral ones and numbers."""
    for name in value.split():
        found = {x.lower() for x in _NAMES.findall(name)}
        if name.lower() in parts or found & parts and all(x in parts or x in NEUTRAL or x.isdigit() for x in found):
            return True
    return False


def ends_telling(value: str) -> bool:
    """Whether a name is one part and then a telling one, or related matter, neutral parts and numbers after them aside."""
    for name in value.split():
        found = [x.lower() for x in _NAMES.findall(name)]
        while len(found) > 1 and (found[-1] in NEUTRAL or found[-1].isdigit()):
            found.pop()
        if len(found) == 2 and (found[1] in TELLING or found[0] in RELATED and found[1] in OTHERS):
            return True
    return False


class Page:
    """Blocks of a page: lists of texts and of feature rows."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.rows: list[list[float]] = []
        self.parts: list[str] = []
        self.stack: list[tuple[str, tuple]] = []
        self.flags = (False,) * 5 + (0,)  # in an article, in named content, in furniture, in something telling, hidden; the number of the form
        self.forms, self.form_of = 0, []
        self.link_words, self.link, self.heading = 0, False, False
        self._walk(source)
        self._flush()
        words = [0] * (self.forms + 1)
        for r, form in zip(self.rows, self.form_of):
            words[form] += r[0]
        wraps = {form for r, form in zip(self.rows, self.form_of) if r[0] >= LONG_BLOCK and 2 * words[form] > sum(words)}
        for r, form in zip(self.rows, self.form_of):
            r[5] = r[5] or bool(form) and form not in wraps
        none = [[0.0, 0.0]] * 2
        around, has_article = [*none, *[r[:2] for r in self.rows], *none], any(r[3] for r in self.rows)
        self.rows = [[*r[:2], *around[i], *around[i + 1], *around[i + 3], *around[i + 4], *r[2:], has_article] for i, r in enumerate(self.rows)]

    def _walk(self, source: str) -> None:
        at, end = 0, len(source)
        while at < end:
            m = _TAG.search(source, at)
            self._text(source[at : m.start() if m else end])
            if not m:
                return
            at = m.end()
            name = (m[2] or m[5] or "").lower()
            if not name:
                continue
            closing, inside = m[1] or m[4], m[3] or m[6] or ""
            if name in RAW and not closing and not inside.endswith("/"):
                found = re.compile(f"</{name}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
                if not found and self.stack:  # not closed: it ends with what it stands in
                    found = re.compile(f"(?=</{re.escape(self.stack[-1][0])}[\\s/>])", re.I).search(source, at)
                at = found.end() if found else end
            elif closing:
                self._close(name)
            else:
                self._open(name, inside)

    def _text(self, text: str) -> None:
        if not text or self.flags[4]:
            return
        if "&" in text:
            text = html.unescape(text)
        self.parts.append(text)
        if self.link:
            self.link_words += len(text.split())

    def _open(self, name: str, inside: str) -> None:
        if name in BLOCK:
            self._flush()
            self.link = False
            while self.stack and name in CLOSED_BY.get(self.stack[-1][0], ()):
                self._pop()
        if name == "a":
            self.link = True
        if name in VOID:
            return
        flags = self._flags(name, inside)
        if name in BLOCK or flags != self.flags:
            if name not in BLOCK:
                self._flush()
            self.stack.append((name, self.flags))
            self.flags = flags
        self.heading |= name in HEADINGS

    def _flags(self, name: str, inside: str) -> tuple:
        article, named, furniture, telling, hidden, form = self.flags
        if name == "form":
            self.forms += 1
            form = self.forms
        own = name in ("article", "main")
        if name == "head" or name in FURNITURE or name == "header" and not article:
            furniture = True
        hidden |= name == "template"
        if "=" in inside or "hidden" in inside:
            for m in _ATTRIBUTE.finditer(inside):
                key, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
                if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    hidden = True
                elif key == "role":
                    furniture |= value.lower() in FURNITURE_ROLES
                    own |= value.lower() in ("main", "article")
                elif key in ("class", "id") and name not in ("html", "body", "article", "main"):
                    about = tells(value, TELLING) or name not in HEADINGS and ends_telling(value)
                    telling |= about
                    named |= not about and tells(value, CONTENT)
        return article or own, named, furniture, telling, hidden, form

    def _close(self, name: str) -> None:
        if name == "a":
            self.link = False
        if name in BLOCK:
            self._flush()
            self.link = False
        if any(n == name for n, _ in self.stack):
            while self.stack[-1][0] != name:
                self._pop()
            self._pop()

    def _pop(self) -> None:
        self._flush()
        self.flags = self.stack.pop()[1]

    def _flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        self.parts = []
        if text:
            words = text.count(" ") + 1
            self.texts.append(text)
            self.rows.append([words, min(1.0, self.link_words / words), self.heading, *self.flags[:4]])
            self.form_of.append(self.flags[5])
        self.link_words, self.heading = 0, False


class Tree:
    """A binary decision tree, as nested tuples (feature, threshold, low, high) with booleans as leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 2):
        self.root = self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int):
        if depth == 0 or y.all() or not y.any() or len(y) < 2 * least:
            return bool(y.mean() >= 0.5)
        best = None
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, good = x[order, j], np.cumsum(y[order])
            n = np.arange(1, len(y))
            cut = (v[1:] > v[:-1]) & (n >= least) & (len(y) - n >= least)
            if not cut.any():
                continue
            a, b = good[:-1] / n, (good[-1] - good[:-1]) / (len(y) - n)
            gini = np.where(cut, n * a * (1 - a) + (len(y) - n) * b * (1 - b), np.inf)
            k = int(gini.argmin())
            if best is None or gini[k] < best[0] - 1e-12:
                best = (gini[k], j, float(v[k] + v[k + 1]) / 2)
        if best is None:
            return bool(y.mean() >= 0.5)
        _, j, t = best
        low = x[:, j] <= t
        return (j, t, self._grow(x[low], y[low], depth - 1, least), self._grow(x[~low], y[~low], depth - 1, least))


def is_main(root, row: list[float]) -> bool:
    while root is not True and root is not False:
        j, t, low, high = root
        root = low if row[j] <= t else high
    return root


#: Marks main text in the labelled pages.
LABEL = "⁂"


def labelled_pages(n: int = 400, seed: int = 7) -> Iterator[str]:
    """The labelled table: small pages in several layouts; words of main text bear LABEL.

    On every other page elements and names say nothing (nested div elements with arbitrary names, some of them misleading): long
    paragraphs with few links, and what stands between them, are main text; links, and short blocks beside them, are furniture.
    """
    rnd = random.Random(seed)
    vocabulary = "stone river mild harbour candle seven orchard winter paper lantern copper field quiet ladder market salt window garden thread ferry".split()
    words = lambda a, b: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(a, b)))
    main = lambda a, b: " ".join(LABEL + w for w in words(a, b).split())
    link = lambda a, b: f'<a href="/{rnd.randint(1, 99)}">{words(a, b)}</a>'
    links = lambda k: "<ul>" + "".join(f"<li>{link(1, 3)}</li>" for _ in range(rnd.randint(2, k))) + "</ul>"
    named = lambda tag, names, body: f'<{tag} {rnd.choice(("class", "id"))}="{rnd.choice(names)}">{body}</{tag}>'
    some = lambda parts: "".join(x for x in parts if rnd.random() < 0.5)

    def paragraphs(least: int) -> list[str]:
        out = []
        for _ in range(rnd.randint(1, 9)):
            kind = rnd.random()
            if kind < 0.6:
                out.append(f"<p>{main(least, max(least + 5, rnd.choice((3, 12, 60, 200))))}</p>")
            elif kind < 0.7:
                out.append(f'<p>{main(max(2, least), 30)} <a href="/x">{main(1, 3)}</a> {main(2, 20)}</p>')
            elif kind < 0.8:
                out.append(f"<h2>{main(1, 6)}</h2>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{main(max(1, least // 2), 15)}</li>" for _ in range(3)) + "</ul>")
            else:
                out.append(f"<blockquote>{main(max(3, least), 30)}</blockquote>")
        return out

    def by_mark_up() -> str:
        body = paragraphs(1)
        # Furniture may stand inside the article, too.
        body += [x for x in (f'<p><a href="/x">{main(4, 40)}</a></p>', f'<h3><a href="/x">{main(1, 6)}</a></h3>', "<ul>" + "".join(f'<li><a href="/x">{main(1, 9)}</a></li>' for _ in range(4)) + "</ul>") if rnd.random() < 0.15]
        rnd.shuffle(body)
        for x in [named("div", ["ad", "promo-box", "share", "related"], words(2, 25)), f"<aside>{words(1, 40)}</aside>", f"<nav>{links(4)}</nav>", f"<form><p>{words(2, 20)}</p></form>", f"<footer>{words(2, 20)}</footer>", named("div", ["comments", "comment-list"], "".join(f"<p>{words(3, 80)}</p>" for _ in range(3)))]:
            if rnd.random() < 0.15:
                body.insert(rnd.randint(0, len(body)), x)
        whole = f"<h1>{main(1, 9)}</h1>" + "".join(body)
        kind = rnd.random()
        if kind < 0.55:
            whole = named("article", ["ad", "share-list", "x1"], whole) if rnd.random() < 0.2 else f"<article>{whole}</article>"
        elif kind < 0.75:
            whole = f"<main>{whole}</main>"
        else:
            whole = named("div", ["content", "post-body", "entry", "article-text", "story"], whole)
        before = [f"<nav>{links(7)}</nav>", f"<header>{words(1, 12)}</header>", named("div", ["ad", "ads", "banner", "x2", "sponsored"], words(2, 60)), named("div", ["cookie-bar", "notice", "x3"], f"<p>{words(5, 40)}</p>"), named("div", ["menu", "topbar", "x4"], link(1, 3) + " " + link(1, 3)), links(6)]
        after = [f"<aside><p>{words(2, 60)}</p>{links(4)}</aside>", f"<footer>&copy; {words(2, 12)}</footer>", named("div", ["comments", "discussion", "x5"], "".join(f"<p>{words(3, 80)}</p>" for _ in range(3))), f"<form><label>{words(1, 4)}</label><p>{words(2, 20)}</p></form>", named("section", ["sidebar", "related", "x6"], f"<p>{words(2, 50)}</p>"), named("div", ["footer", "x7"], words(2, 15)), links(8)]
        return some(before) + whole + (some(after) if rnd.random() < 0.6 else "")  # main text may end the page

    def by_density() -> str:
        names = ["x1", "c-2", "box", "row", "left", "ads-free-2", "menu-of-the-day"]
        if rnd.random() < 0.15:  # a page of a few words
            return "".join(f"<p>{main(1, 12)}</p>" for _ in range(rnd.randint(1, 3)))
        body = [f"<p>{main(20, 200)}</p>", *paragraphs(12), f"<p>{main(15, 120)}</p>"]
        lines = lambda k: "".join(named("div", names, link(1, 5)) if rnd.random() < 0.75 else named("div", names, words(1, 6)) for _ in range(rnd.randint(3, k)))
        whole = (f"<h1>{main(2, 9)}</h1>" if rnd.random() < 0.8 else "") + "".join(body)
        return named("div", names, lines(9)) + named("div", names, whole) + named("div", names, lines(9))

    for k in range(n):
        yield f"<html><body>{by_density() if k % 2 else by_mark_up()}</body></html>"


def train(pages: Iterable[str] | None = None, depth: int = 12) -> Tree:
    rows, labels = [], []
    for source in labelled_pages() if pages is None else pages:
        page = Page(source)
        rows += page.rows
        labels += [LABEL in x for x in page.texts]
    return Tree(np.array(rows, float), np.array(labels, bool), depth)


def main_text(root, source: str | None) -> str:
    page = Page(source or "")
    return " ".join(x for x, row in zip(page.texts, page.rows) if is_main(root, row))


def extract(pages: DataFrame, html_col: str = "html", out: str = "text", tree: Tree | None = None) -> DataFrame:
    """pages with a column of their main texts."""
    root = (tree or train()).root
    pages = pages.drop(out) if out != html_col and out in pages.columns else pages
    at = pages.columns.index(html_col)
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(root, x.as_py()) for x in batch.column(at)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=schema.names)

    return map_arrow(pages, run, schema)
