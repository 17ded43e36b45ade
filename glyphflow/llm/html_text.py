"""HTML extraction by a tree-structured graphical model over the DOM.

Each block element is a binary node (content or not). A node's features give
its own potential, parent and child share a potential, and sum-product message
passing, upward from the leaves and downward from the root, gives exact content
marginals. Text of blocks whose marginal is at least one half is the main text.

The potentials are learned by exact maximum likelihood from labelled pages
(labelled_pages(): generated layouts of many kinds, a bounded, fixed set). Pages
are parsed and scored per Arrow batch, all trees of a batch at once, without a
shuffle; the model is a few hundred floats.

Defined cases: a null page is the empty text; a page without any text gives
the empty text; unclosed or stray tags follow HTML's rules for optional ends; a
control that is never closed (button, select, svg, ...) hides nothing, while a
script, style or comment that is never closed hides the rest, as in a browser;
elements nested deeper than DEPTH lie beside each other; very long pages take
linear time; a marginal of exactly one half counts as content; rows repeat as
they come; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What ends a tag, or begins a quoted value in it.
_STOP = re.compile(r">|=\s*([\"'])")
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_MARKS = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Their content is markup or controls, never text of the page.
_SKIPPED = set("script style noscript template title textarea select button svg canvas object iframe audio video math datalist".split())
#: Of these, those whose content isn't markup: the first end tag ends them.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe"}
#: Unclosed, these last to the end of the page; others are then taken as if their tag weren't there.
_TO_THE_END = {"script", "style"}
#: Open elements at most; what is nested deeper lies beside, not within.
DEPTH = 400
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag closes an open element of these, up to the given container.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
_WORDS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc pagination pager tabs",
    "footer": "footer foot copyright colophon legal contentinfo bottom",
    "header": "header masthead banner topbar branding logo site-header",
    "side": "sidebar side aside related widget rail secondary complementary recommended trending popular",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promoted promotion banner-ad",
    "notice": "cookie cookies consent notice alert popup modal gdpr warning message overlay paywall",
    "comment": "comment comments reply replies discussion disqus respond commentlist feedback",
    "form": "form login signin subscribe subscription newsletter search signup contact",
    "share": "share sharing social follow byline author-box tags tag meta tools",
    "content": "content article post entry main story text body prose article-body post-content entry-content",
}
_GROUP = {w: g for g, ws in _WORDS.items() for w in ws.split()}
_TAGS = "article main section div p h1 h2 li ul nav header footer aside form td blockquote pre body figcaption".split()
FEATURES = [*(f"tag:{t}" for t in _TAGS), *(f"mark:{g}" for g in _WORDS), "heading", "own", "words", "links", "sentence", "all_words", "all_links", "depth", "first", "last", "copyright", "bias"]


@dataclass
class Page:
    parent: list[int] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    marks: list[set] = field(default_factory=list)
    labels: list[int] = field(default_factory=list)
    #: Text blocks in page order: (node, text, characters inside links).
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


class Tags:
    """The tags of a page from left to right, as (start, end, name, closing, attributes).

    Comments and declarations have no name. Linear in the text: the end of a
    tag is looked for from where it begins, a quote that never closes is looked
    for once, and each stretch is passed once. ``at`` may be moved on.
    """

    def __init__(self, source: str):
        self.source, self.at = source, 0
        self._last, self._unclosed = source.rfind(">"), set()

    def next(self):
        source = self.source
        while (start := source.find("<", self.at)) >= 0:
            at = start + 1
            c = source[at : at + 1]
            closing = c == "/"
            name = _NAME.match(source, at + closing)
            if not name and not closing and c not in ("!", "?") or not c:
                self.at = at  # a mere less-than sign
                continue
            if source.startswith("!--", at):
                end = source.find("-->", at + 1)
                self.at = len(source) if end < 0 else end + 3
                return start, self.at, "", False, ""
            end = self._end(name.end() if name else at, bool(name)) if at <= self._last else -1
            self.at = len(source) if end < 0 else end  # else the page is cut short within a tag
            if end < 0 or not name:
                return start, self.at, "", False, ""
            return start, end, name[0].lower(), closing, source[name.end() : end - 1]
        return None

    def _end(self, at: int, quotes: bool) -> int:
        if not quotes:
            return self.source.find(">", at) + 1 or -1
        while (stop := _STOP.search(self.source, at)) and (quote := stop[1]):
            at = stop.end()
            if quote not in self._unclosed:
                close = self.source.find(quote, at, self._last)
                if close < 0:
                    self._unclosed.add(quote)
                else:
                    at = close + 1
        return stop.end() if stop else -1


class _Ends:
    """Ends of skipped elements, found in one pass per name."""

    def __init__(self, source: str):
        self.source, self.found = source, {}

    def after(self, name: str, start: int) -> int | None:
        """Where the element whose tag begins at start ends; None if nowhere."""
        if name not in self.found:
            ends, open_ = {}, []
            for m in re.finditer(rf"<(/?){name}(?=[\s/>])", self.source, re.I):
                if not m[1]:
                    open_.append(m.start())
                elif open_:
                    end = self.source.find(">", m.end())
                    end = len(self.source) if end < 0 else end + 1
                    if name in _RAW:  # all that were opened since end here
                        ends |= dict.fromkeys(open_, end)
                        open_ = []
                    else:
                        ends[open_.pop()] = end
            self.found[name] = ends
        return self.found[name].get(start)


def parse(source: str | None, label_of=None) -> Page:
    """The page's block elements as a tree, and its text blocks.

    label_of gives a node's label from its attributes, where pages are labelled.
    """
    page = Page()

    def add(tag: str, attrs: str, parent: int) -> int:
        marks = set()
        for m in _MARKS.finditer(attrs) if attrs else ():
            for w in (m[1] or m[2] or m[3] or "").lower().split():
                marks |= {_GROUP[x] for x in {w, *re.split(r"[-_]", w)} if x in _GROUP}
        page.parent.append(parent)
        page.tags.append(tag)
        page.marks.append(marks)
        page.labels.append(label_of(attrs) if label_of else -1)
        return len(page.tags) - 1

    if not source:
        return page
    open_: list[tuple[str, int]] = [("html", add("body", "", -1))]
    count: Counter = Counter()  # open elements by tag
    runs: list[str] = []
    linked = anchors = 0

    def flush():
        nonlocal linked, runs
        if runs:
            text = " ".join("".join(runs).split())
            if text:
                page.blocks.append((open_[-1][1], text, min(linked, len(text))))
        runs, linked = [], 0

    def text(raw: str):
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            runs.append(raw)
            if anchors:
                linked += len(raw.strip())

    def pop_to(k: int):
        for tag, _ in open_[k:]:
            count[tag] -= 1
        del open_[k:]

    ends = _Ends(source)
    tags, at = Tags(source), 0  # all before at is dealt with
    while found := tags.next():
        start, at_end, tag, closing, attrs = found
        text(source[at:start])
        at = at_end
        if not tag:
            continue
        if tag in _SKIPPED:
            if not closing and not attrs.endswith("/"):
                after = ends.after(tag, start)
                at = after if after is not None else len(source) if tag in _TO_THE_END else at
                tags.at = at
            continue
        if tag == "a":
            anchors = 0 if closing else 1
            continue
        if tag == "br":
            runs.append(" ")
            continue
        if tag not in _BLOCKS:
            if tag in ("img", "input"):
                runs.append(" ")
            continue
        flush()
        if tag in ("html", "body") or tag in _VOID:
            continue
        anchors = 0 if closing else anchors
        if closing:
            if count[tag]:
                pop_to(next(k for k in range(len(open_) - 1, 0, -1) if open_[k][0] == tag))
            continue
        if open_[-1][0] == "p":
            pop_to(len(open_) - 1)
        if tag in _CLOSES:
            ended, until = _CLOSES[tag]
            if any(count[t] for t in ended):
                for k in range(len(open_) - 1, 0, -1):
                    if open_[k][0] in until:
                        break
                    if open_[k][0] in ended:
                        pop_to(k)
        node = add(tag, attrs, open_[-1][1])
        if len(open_) >= DEPTH:
            pop_to(DEPTH - 1)
        open_.append((tag, node))
        count[tag] += 1
    text(source[at:])
    flush()
    return page


def features(page: Page) -> np.ndarray:
    n = len(page.tags)
    own, links, depth = np.zeros(n), np.zeros(n), np.zeros(n)
    sentence, rights = np.zeros(n), np.zeros(n)
    for node, text, linked in page.blocks:
        own[node] += len(text)
        links[node] += linked
        sentence[node] = max(sentence[node], text.rstrip("\"')»”")[-1:] in (".", "!", "?", "。"))
        rights[node] = max(rights[node], "©" in text[:40])
    total, total_links = own.copy(), links.copy()
    for k in range(n - 1, 0, -1):
        total[page.parent[k]] += total[k]
        total_links[page.parent[k]] += total_links[k]
    out = np.zeros((n, len(FEATURES)))
    at = {f: k for k, f in enumerate(FEATURES)}
    for k in range(n):
        if k:
            depth[k] = depth[page.parent[k]] + 1
        if (f := f"tag:{page.tags[k]}") in at:
            out[k, at[f]] = 1
        out[k, at["heading"]] = page.tags[k] in ("h1", "h2", "h3", "h4", "h5", "h6")
        for g in page.marks[k]:
            out[k, at[f"mark:{g}"]] = 1
    position = np.arange(n) / max(n - 1, 1)
    for name, column in (
        ("own", own > 0), ("words", np.log1p(own / 6) / 4), ("links", links / np.maximum(own, 1)), ("sentence", sentence), ("all_words", np.log1p(total / 6) / 6),
        ("all_links", total_links / np.maximum(total, 1)), ("depth", np.minimum(depth, 10) / 10), ("first", position < 0.1), ("last", position > 0.9), ("copyright", rights), ("bias", 1),
    ):
        out[:, at[name]] = column
    return out


class Forest:
    """Trees side by side; messages go level by level through all of them."""

    def __init__(self, pages: list[Page]):
        self.x = np.concatenate([features(p) for p in pages]) if pages else np.zeros((0, len(FEATURES)))
        sizes = [len(p.tags) for p in pages]
        self.start = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        self.parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + s) for p, s in zip(pages, self.start, strict=False)]).astype(int) if pages else np.zeros(0, int)
        depth = np.zeros(len(self.parent), int)
        for k, p in enumerate(self.parent.tolist()):  # parents come before children
            if p >= 0:
                depth[k] = depth[p] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max(initial=0)) + 1)]

    def beliefs(self, weights: np.ndarray, pair: np.ndarray):
        """Marginals of content, and the pair marginals [edge, parent state, child state], by sum-product."""
        unary = np.stack([np.zeros(len(self.x)), self.x @ weights], axis=1)
        inside, up = unary.copy(), np.zeros_like(unary)
        for nodes in reversed(self.levels[1:]):
            up[nodes] = np.logaddexp.reduce(inside[nodes][:, None, :] + pair[None], axis=2)
            np.add.at(inside, self.parent[nodes], up[nodes])
        full = inside.copy()
        pairs = np.zeros((len(self.x), 2, 2))
        for nodes in self.levels[1:]:
            cavity = full[self.parent[nodes]] - up[nodes]
            joint = cavity[:, :, None] + pair[None] + inside[nodes][:, None, :]
            full[nodes] = np.logaddexp.reduce(joint, axis=1)
            pairs[nodes] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(nodes), 4), axis=1)[:, None, None])
        return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -700, 700))), pairs


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray

    def marginals(self, pages: list[Page]) -> list[np.ndarray]:
        forest = Forest(pages)
        p, _ = forest.beliefs(self.weights, self.pair)
        return [p[a:b] for a, b in zip(forest.start[:-1], forest.start[1:], strict=True)]


def extract(model: Model, pages: list[Page]) -> list[str]:
    """The main text of each page."""
    out = []
    for page, p in zip(pages, model.marginals(pages), strict=True):
        out.append("\n".join(text for node, text, _ in page.blocks if p[node] >= 0.5))
    return out


def train(pages: list[Page], rounds: int = 150, rate: float = 0.1, ridge: float = 2e-3) -> Model:
    """Exact maximum likelihood: labels against marginals, by Adam."""
    forest = Forest(pages)
    y = np.concatenate([np.array(p.labels) for p in pages])
    edges = np.flatnonzero(forest.parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[forest.parent[edges]], y[edges]), 1)
    w = np.zeros(len(FEATURES) + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        p, pairs = forest.beliefs(w[4:], w[:4].reshape(2, 2))
        g = np.concatenate([(seen - pairs[edges].sum(axis=0)).ravel(), forest.x.T @ (y - p)]) / len(pages) - ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(w[4:], w[:4].reshape(2, 2))


#: Names that sites give their parts, as the generated pages use them: not the features' word lists, and in part misleading or without meaning.
_SITE_NAMES = {
    "nav": "main-nav site-navigation topnav nav-primary menu-main breadcrumb-trail mega-menu toc-list pagination-links js-menu",
    "top": "site-header masthead page-header top-bar header__inner brand logo-wrap hero-banner",
    "ad": "ad ad-slot ads-top advert dfp-ad adsbygoogle sponsored-box promo-unit native-promo banner-ad commercial",
    "notice": "cookie-banner cookie-notice consent-dialog gdpr-bar alert alert-info site-message popup modal-body paywall-prompt notice-box",
    "side": "sidebar widget-area secondary related-posts more-stories rail-right popular-list trending recommended aside-box",
    "form": "newsletter-signup search-form login-box subscribe contact-form signup",
    "comments": "comments comment-list disqus_thread replies discussion reader-comments responses",
    "comment": "comment comment-body reply comment__text depth-1 byuser",
    "foot": "site-footer footer colophon page-bottom legal-links copyright-line foot",
    "share": "share-bar social-links tags-list post-meta follow-us sharing author-bio",
    "content": "entry-content post-body article-text mw-parser-output story-content markdown-body single-post main-content td-post-content body-copy",
}
_PLAIN_NAMES = "container wrapper row col-md-8 inner box block css-1a2b3c sc-x9f section-2 grid left clearfix js-root card panel item".split()
_LABEL = re.compile(r' data-y="([01])"')


def labelled_pages(count: int = 500, seed: int = 5) -> list[Page]:
    """Generated pages of many layouts whose block elements are labelled.

    Which parts a page has, how they nest, and how (or whether) they are named
    is drawn independently; a third of all parts have a name without meaning.
    """
    rng = random.Random(seed)
    syllables = "an er th on re he in ed nd ha ou le la de en ti se ri co ma pa zu ge ver ich cion ado ue mente".split()
    pick = rng.choice

    def words(lo: int, hi: int) -> str:
        return " ".join("".join(pick(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(lo, hi)))

    def prose(lo: int = 12, hi: int = 90) -> str:
        return ". ".join(words(4, 18).capitalize() for _ in range(max(1, rng.randint(lo, hi) // 10))) + pick([".", ".", ".", "", "?"])

    def mark(part: str, sure: bool = False) -> str:
        """A part's name; it is always telling where nothing else could tell (sure)."""
        kind = rng.random()
        if not sure and kind < 0.2:
            return ""
        name = pick(_SITE_NAMES[part].split()) if sure or kind > 0.35 else pick(_PLAIN_NAMES)
        if rng.random() < 0.2:
            name = f"{pick(_PLAIN_NAMES)} {name}"
        return f' {pick(["class", "class", "id"])}="{name}"'

    def el(tag: str, y: int, inner: str, attrs: str = "") -> str:
        close = "" if tag in ("p", "li") and rng.random() < 0.1 else f"</{tag}>"
        return f'<{tag}{attrs} data-y="{y}">{inner}{close}'

    def link_list(lo: int = 3, hi: int = 8) -> str:
        return el(pick(["ul", "ol", "ul"]), 0, "".join(el("li", 0, f'<a href="/x">{words(1, 4)}</a>') for _ in range(rng.randint(lo, hi))))

    def nav() -> str:
        tag, m = pick([("nav", mark("nav")), ("nav", ""), ("div", mark("nav", True)), ("div", ' role="navigation"'), ("div", "")])
        return el(tag, 0, link_list() if m == "" or rng.random() < 0.8 else " | ".join(f'<a href="/y">{words(1, 2)}</a>' for _ in range(5)), m)

    def top() -> str:
        tag, m = pick([("header", ""), ("header", mark("top")), ("div", mark("top", True))])
        return el(tag, 0, pick([words(1, 4), el("h1", 0, words(1, 3)) + el("p", 0, words(2, 8)), el("div", 0, words(1, 3)) + nav()]), m)

    def ad() -> str:
        return el(pick(["div", "div", "aside", "section"]), 0, pick([prose(6, 25), el("p", 0, prose(6, 40)), words(3, 12), f'<a href="/b">{words(2, 6)}</a> {words(2, 6)}']), mark("ad", True))

    def notice() -> str:
        return el(pick(["div", "section", "aside"]), 0, pick([prose(8, 40), el("p", 0, prose(8, 30)) + f'<a href="/c">{words(1, 2)}</a>']), mark("notice", True))

    def side() -> str:
        tag, m = pick([("aside", ""), ("aside", mark("side")), ("div", mark("side", True))])
        return el(tag, 0, pick([el("h3", 0, words(1, 4)) + link_list(), el("h2", 0, words(1, 3)) + el("p", 0, prose(8, 50)), link_list()]), m)

    def form() -> str:
        return el("form", 0, pick([el("p", 0, words(2, 9)) + "<input><button>Go</button>", f"<label>{words(1, 3)}</label><input>", el("div", 0, el("label", 0, words(1, 4)) + "<input>")]), mark("form"))

    def comments() -> str:
        one = lambda: el(pick(["div", "article", "li", "section"]), 0, pick([el("p", 0, prose(6, 60)), el("h4", 0, words(1, 2)) + el("p", 0, prose(6, 60)), prose(6, 50)]), mark("comment"))
        return el(pick(["section", "div", "ol"]), 0, el("h3", 0, words(1, 2)) + "".join(one() for _ in range(rng.randint(1, 5))), mark("comments", True))

    def foot() -> str:
        tag, m = pick([("footer", ""), ("footer", mark("foot")), ("div", mark("foot", True))])
        return el(tag, 0, pick([f"&copy; {words(1, 3)} &middot; {prose(6, 25)}", el("p", 0, f"© 2020 {words(2, 8)}"), link_list() + el("p", 0, words(3, 12)), el("p", 0, prose(8, 30))]), m)

    def body_block() -> str:
        kind = rng.random()
        if kind < 0.7:
            said = words(1, 2).capitalize() + pick([".", ".", ""]) if rng.random() < 0.25 else " | ".join(words(1, 1) for _ in range(rng.randint(3, 30))) if rng.random() < 0.1 else prose(3, 120)
            return el("p", 1, pick(["", "", "", "<b>"]) + said + pick(["", "", "<br>"]))
        if kind < 0.78:
            return el(pick(["h2", "h3"]), 1, words(1, 8))
        if kind < 0.84:
            return el("ul", 1, "".join(el("li", 1, words(2, 20) + pick(["", ".", f' <a href="/q">{words(1, 3)}</a>'])) for _ in range(rng.randint(2, 6))))
        if kind < 0.9:
            return el(pick(["blockquote", "pre", "div"]), 1, pick([prose(6, 60), el("p", 1, prose(6, 60))]))
        if kind < 0.94:
            return el("table", 1, "".join(el("tr", 1, "".join(el("td", 1, words(1, 4)) for _ in range(3))) for _ in range(3)))
        return pick([ad, side, lambda: el("div", 0, f'<a href="/s">{words(1, 2)}</a>', mark("share", True)), form])()

    def article() -> str:
        head = pick([el("h1", 1, words(2, 12)), el("h1", 1, words(2, 12)), el("h2", 1, words(2, 10)), ""])
        if head and rng.random() < 0.15:
            head = el("header", 1, head)
        blocks = head + "".join(body_block() for _ in range(pick([1, 1, 2, 3, 5, 8, 14, 25])))
        tag, m = pick([("article", ""), ("article", mark("content")), ("main", ""), ("section", mark("content", True)), ("div", mark("content", True)), ("div", mark("content"))])
        inner = el(tag, 1, blocks, m)
        return el(pick(["div", "main"]), 1, inner, f' class="{pick(_PLAIN_NAMES)}"') if rng.random() < 0.3 else inner

    pages = []
    for _ in range(count):
        bare = rng.random() < 0.15  # a page that is little but its text
        parts = [] if bare else [f() for f, chance in ((top, 0.5), (nav, 0.8), (notice, 0.3), (ad, 0.5)) if rng.random() < chance]
        plain = "".join(el("p", 1, prose(2, 60)) for _ in range(pick([1, 1, 2, 4])))
        parts.append(pick([plain, el("div", 1, plain), el("div", 1, plain, f' class="{pick(_PLAIN_NAMES)}"'), article()]) if bare else article())
        if not bare and rng.random() < 0.9:  # else the page ends with its article, as a page cut short does
            parts += [f() for f, chance in ((side, 0.4), (comments, 0.4), (ad, 0.2), (form, 0.3), (notice, 0.15), (foot, 0.85)) if rng.random() < chance]
        source = "<html><head><title>t</title></head><body>" + "".join(parts) + pick(["</body></html>", ""])
        page = parse(source, lambda attrs: int(m[1]) if (m := _LABEL.search(attrs)) else -1)
        size = np.zeros((len(page.tags), 2))
        for node, text, _ in page.blocks:
            size[node, max(page.labels[node], 0)] += len(text)
        for k in range(len(page.tags) - 1, 0, -1):
            size[page.parent[k]] += size[k]
        page.labels = [int(size[k, 1] > size[k, 0]) if y < 0 else y for k, y in enumerate(page.labels)]
        pages.append(page)
    return pages


@functools.cache
def trained() -> Model:
    return train(labelled_pages())


def main_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Model | None = None) -> DataFrame:
    """Per page: the columns to keep, text, n_chars (code points)."""
    rows = pages.select(*keep, F.col(html_col).alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches):
        for batch in batches:
            for part in (batch.slice(k, 200) for k in range(0, batch.num_rows, 200)):
                texts = extract(shared.value, [parse(x.as_py()) for x in part["__html"]])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"]
                )

    return rows.mapInArrow(run, T.StructType([rows.schema[k] for k in keep]).add("text", "string").add("n_chars", "long"))
