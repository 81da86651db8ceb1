"""Main text of web pages by a tree-structured graphical model over DOM blocks.

A page is parsed into its tree of block elements. Every block is content or not; a block's features give its unary
potential, a 2 x 2 table by kind of child couples it with its parent. Sum-product messages go up the tree and down
again, which gives exact marginals; blocks with a content marginal of one half or more keep their text. Weights and
tables maximise the penalised likelihood of labelled pages (the gradient needs only the same marginals); the labelled
pages are made by ``labelled_pages`` from layouts of articles and of what surrounds them.

All pages of a batch form one forest, so messages are numpy operations by depth. Pages are independent rows: no
shuffle, and a lost executor repeats only its batches.

Defined results: null or empty html gives an empty text; markup errors (unclosed or stray tags, cut references,
missing end) are read as browsers do, roughly; all white space of Unicode, no-break spaces included, counts as white
space inside a block; equal rows give equal texts; an empty table gives no rows; only the
page's id, url and html columns are read, whatever else the table has.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of html in a forest, about.
FOREST_BYTES = 2 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content is skipped to the end tag without looking for markup.
RAW = frozenset("script style textarea title iframe xmp noframes".split())
#: Left out with all inside: no text of an article.
SKIPPED = frozenset("script style textarea title noscript iframe xmp noframes head template svg math object select button audio video canvas datalist map".split())
#: Start tags that may stand in a head; any other ends it.
IN_HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template head html".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr caption ul".split())
#: A start tag that ends an open element of these names.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tr"), "tfoot": ("tbody", "tr")}
#: Elements beyond which such an end does not reach.
SCOPES = frozenset("ul ol menu dl table html body article section main aside div".split())
MARKED = frozenset("article aside footer form header main nav section menu dialog figure fieldset".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([a-zA-Z][\w:-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Page:
    """Blocks of one page: parents, features and text pieces in page order."""

    def __init__(self, source: str):
        self.parent: list[int] = [-1]
        self.depth: list[int] = [0]
        self.tag: list[str] = ["#page"]
        self.names: list[tuple[str, ...]] = [()]
        self.label: list[int | None] = [None]
        self.chars: list[int] = [0]
        self.linked: list[int] = [0]
        self.controls: list[int] = [0]
        self.pieces: list[tuple[int, str]] = []
        self._read(source)

    def _open(self, tag: str, parent: int, rest: str) -> int:
        names: list[str] = []
        label = self.label[parent]
        if rest.strip(" /"):
            for key, *values, hidden in _ATTR.findall(rest):
                value = "".join(values)
                key = key.lower()
                if key in ("class", "id", "role", "itemprop", "aria-label"):
                    names += [t.lower() for t in _TOKEN.findall(value)[:12]]
                elif hidden or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
                    names.append("hidden")
                elif key == "data-truth":
                    label = int(value)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.tag.append(tag)
        self.names.append(tuple(dict.fromkeys(names)))
        self.label.append(label)
        self.chars.append(0)
        self.linked.append(0)
        self.controls.append(0)
        return len(self.parent) - 1

    def _read(self, source: str) -> None:
        # open elements: (name, block number, or INLINE, LEFT_OUT, or INSIDE one that is left out)
        INLINE, LEFT_OUT, INSIDE = -1, -2, -3
        stack: list[tuple[str, int]] = []
        block, links, skipped, buffer = 0, 0, 0, []

        def flush() -> None:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                self.pieces.append((block, text))
                self.chars[block] += len(text)

        def pop_to(size: int) -> None:
            nonlocal block, links, skipped
            while len(stack) > size:
                name, number = stack.pop()
                if number >= 0:
                    flush()
                    block, links = self.parent[number], 0
                elif number == LEFT_OUT:
                    skipped -= 1
                elif name == "a" and number == INLINE:
                    links = max(0, links - 1)

        def add(text: str) -> None:
            if skipped and stack[-1][0] == "head" and text.strip():
                pop_to(len(stack) - 1)  # text may not stand in a head
            if text and not skipped:
                text = html.unescape(text) if "&" in text else text
                buffer.append(text)
                if links:
                    self.linked[block] += len(text.strip())

        at, size = 0, len(source)
        while at < size:
            m = _TAG.search(source, at)
            if not m:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            name = name.lower()
            if m[1] or m[4]:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        pop_to(k)
                        break
                continue
            rest = m[3] or m[6] or ""
            if skipped:
                # what ends an element that is left out, besides its end tag and that of an element around it
                for k in range(len(stack) - 1, -1, -1):
                    open_, number = stack[k]
                    if open_ == "foreignobject":
                        break
                    if number == LEFT_OUT and (open_ == "head" and (name == "body" or k == len(stack) - 1 and name not in IN_HEAD) or open_ == name and name in ("select", "button") or open_ in ("svg", "math") and name in BLOCKS):
                        pop_to(k)
                        break
            if name in RAW or name in SKIPPED and not rest.endswith("/"):
                if not skipped:
                    if name in ("select", "button", "textarea"):
                        self.controls[block] += 1
                    buffer.append(" ")
                if name in RAW:
                    end = re.compile(rf"</{name}\s*>?", re.I).search(source, at)
                    at = end.end() if end else size
                    if end and source[at - 1] != ">":
                        at = (source.find(">", at) + 1) or size
                else:
                    stack.append((name, LEFT_OUT))
                    skipped += 1
                continue
            if skipped:
                if name not in VOID and not rest.endswith("/"):
                    stack.append((name, INSIDE))
                continue
            if name in SKIPPED:
                if name in ("select", "button"):
                    self.controls[block] += 1
                buffer.append(" ")
                continue
            if name in VOID:
                if name == "hr":
                    flush()
                elif name == "input":
                    self.controls[block] += 1
                elif name == "br":
                    buffer.append(" ")
                continue
            if name in BLOCKS:
                for k in range(len(stack) - 1, -1, -1):
                    # a new block ends an open paragraph; an item ends the item before it
                    if stack[k][0] == "p" or stack[k][0] in ENDS.get(name, ()):
                        pop_to(k)
                        break
                    if stack[k][0] in SCOPES:
                        break
                if name in ("html", "body") and any(x == name for x, _ in stack):
                    continue
                flush()
                block, links = self._open(name, block, rest), 0
                stack.append((name, block))
            else:
                if name == "a":
                    links += 1
                stack.append((name, INLINE))
        pop_to(0)
        flush()

    def features(self) -> list[list[str]]:
        n = len(self.parent)
        children: list[dict[str, int]] = [{} for _ in range(n)]
        below, h1 = list(self.chars), [t == "h1" for t in self.tag]
        controls = list(self.controls)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            children[p][self.tag[i]] = children[p].get(self.tag[i], 0) + 1
            below[p] += below[i]
            controls[p] += controls[i]
            h1[p] = h1[p] or h1[i]
        total = max(1, below[0])
        marks = set()
        for i, text in self.pieces:
            if "©" in text or "copyright" in text[:200].lower() or "all rights reserved" in text[-200:].lower():
                marks.add(i)
        # an element that says it holds the article tells on everything beside it; names reach what is inside them
        # (if it has a good part of the text: comments are articles too)
        inside, around = [t in ("article", "main") and b >= 0.3 * total for t, b in zip(self.tag, below, strict=True)], [False] * n
        named = [0] * n
        for i in range(1, n):
            p = self.parent[i]
            inside[i] = inside[i] or inside[p]
            named[i] = p if self.names[p] else named[p]
        for i in range(n - 1, 0, -1):
            around[self.parent[i]] = around[self.parent[i]] or around[i] or inside[i]
        out = []
        for i in range(n):
            p, chars = max(self.parent[i], 0), self.chars[i]
            f = ["bias", f"tag={self.tag[i]}", f"parent={self.tag[p]}", f"chars={_bucket(chars, (1, 25, 80, 200, 600))}"]
            if chars:
                f.append(f"links={_bucket(self.linked[i] / chars, (0.05, 0.4, 0.8))}")
            if children[i].get("p"):
                f.append(f"paragraphs={_bucket(children[i]['p'], (1, 2, 5))}")
            if children[i].get("li"):
                f.append(f"items={_bucket(children[i]['li'], (1, 3, 8))}")
            if children[i]:
                f.append(f"share={_bucket(below[i] / total, (0.05, 0.3, 0.6, 0.85))}")
            if h1[i] and self.tag[i] != "h1":
                f.append("over-h1")
            if controls[i]:
                f.append("controls")
            if i in marks:
                f.append("copyright")
            if around[0] and not inside[i] and not around[i]:
                f.append("beside-article")
            f += [f"under={x[:4]}" for x in self.names[named[i]]]
            for name in self.names[i]:
                f += [f"name={name}", f"start={name[:4]}"]
            out.append(f)
        return out


def _bucket(value: float, limits: tuple[float, ...]) -> int:
    return sum(value >= x for x in limits)


class Forest:
    """Blocks of many pages, by depth."""

    def __init__(self, pages: list[Page]):
        first = np.cumsum([0, *(len(p.parent) for p in pages)])
        self.first = first
        self.parent = np.concatenate([np.array(p.parent) + a for p, a in zip(pages, first, strict=False)]) if pages else np.zeros(0, int)
        depth = np.concatenate([np.array(p.depth) for p in pages]) if pages else np.zeros(0, int)
        self.levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1 if len(depth) else 0)]
        kinds = [[int(t in MARKED or bool(x)) for t, x in zip(p.tag, p.names, strict=True)] for p in pages]
        self.kind = np.concatenate(kinds) if pages else np.zeros(0, int)

    def marginals(self, score: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(content marginal of each block, joint marginals [parent label, own label]) by sum-product.

        ``score``: log odds of content by features; ``table``: log potentials [kind, parent label, own label].
        """
        n = len(score)
        own = np.stack([np.zeros(n), score], 1)
        up = np.zeros((n, 2))  # product of the children's messages
        message = np.zeros((n, 2))  # to the parent
        for level in self.levels[:0:-1]:
            message[level] = _log_sum(table[self.kind[level]] + (own[level] + up[level])[:, None, :], 2)
            np.add.at(up, self.parent[level], message[level])
        belief = own + up
        joint = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            others = belief[self.parent[level]] - message[level]
            pair = table[self.kind[level]] + others[:, :, None] + (own[level] + up[level])[:, None, :]
            belief[level] = _log_sum(pair, 1)
            joint[level] = np.exp(pair - _log_sum(pair.reshape(-1, 4), 1)[:, None, None])
        belief = belief - _log_sum(belief, 1)[:, None]
        return np.exp(belief[:, 1]), joint


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Model:
    def __init__(self, weights: dict[str, float], table: np.ndarray):
        self.weights, self.table = weights, table

    def content(self, pages: list[Page]) -> list[np.ndarray]:
        """Content marginals of the blocks of each page."""
        forest = Forest(pages)
        get = self.weights.get
        score = np.array([sum(get(x, 0.0) for x in f) for p in pages for f in p.features()])
        p, _ = forest.marginals(score, self.table)
        return [p[a:b] for a, b in zip(forest.first[:-1], forest.first[1:], strict=True)]

    def texts(self, sources: list[str | None]) -> list[str]:
        pages = [Page(s or "") for s in sources]
        return ["\n".join(t for i, t in page.pieces if p[i] >= 0.5) for page, p in zip(pages, self.content(pages), strict=True)]


@functools.lru_cache(maxsize=1)
def trained(n_pages: int = 450, rounds: int = 150, ridge: float = 0.05) -> Model:
    """The model of highest penalised likelihood over labelled pages (deterministic; some seconds on the driver)."""
    pages = [Page(s) for s in labelled_pages(n_pages)]
    forest = Forest(pages)
    index: dict[str, int] = {}
    nodes, feats, at = [], [], 0
    for page in pages:
        for f in page.features():
            for x in f:
                nodes.append(at)
                feats.append(index.setdefault(x, len(index)))
            at += 1
    nodes, feats = np.array(nodes), np.array(feats)
    truth = np.array([y or 0 for p in pages for y in p.label])
    children = np.flatnonzero(forest.parent >= 0)
    children = children[np.isin(children, np.concatenate(forest.levels[1:]))]
    weight, table = np.zeros(len(index)), np.zeros((2, 2, 2))
    state = [np.zeros_like(weight), np.zeros_like(table)]
    seen = np.zeros_like(table)
    np.add.at(seen, (forest.kind[children], truth[forest.parent[children]], truth[children]), 1)
    for r in range(rounds):
        p, joint = forest.marginals(np.bincount(nodes, weight[feats], at), table)
        g_weight = np.bincount(feats, (truth - p)[nodes], len(index)) - ridge * weight
        expected = np.stack([joint[children[forest.kind[children] == k]].sum(0) for k in (0, 1)])
        g_table = seen - expected - ridge * table
        for w, g, s in ((weight, g_weight, state[0]), (table, g_table, state[1])):
            s *= 0.9
            s += 0.1 * g * g
            w += 0.1 / (1 + r / 30) * g / np.sqrt(s + 1e-8)
    return Model({x: float(weight[i]) for x, i in index.items()}, table)


# ---- labelled pages ----
# How sites name what is and what surrounds an article.

ARTICLES = [
    "<article {t}>@</article>", "<main {t}>@</main>", "<main><article {t}>@</article></main>", '<div class="content" {t}>@</div>', '<div id="main-content" {t}>@</div>',
    '<div class="post" {t}>@</div>', '<div class="entry-content" {t}>@</div>', '<section class="article-body" {t}>@</section>', '<div class="story text" {t}>@</div>',
    "<table><tr><td {t}>@</td></tr></table>", "<div {t}>@</div>", '<div itemprop="articleBody" {t}>@</div>', '<article class="post"><div class="body" {t}>@</div></article>', '<div role="main" {t}>@</div>',
    '<div class="wrapper"><div class="container"><article {t}>@</article></div></div>', "<article {t}><section>@</section></article>",
]
AROUND = [
    "<nav><ul>{links}</ul></nav>", '<div class="menu"><ul>{links}</ul></div>', '<ul class="nav navbar">{links}</ul>', '<ul id="menu">{links}</ul>', '<div class="navigation">{links}</div>', '<div class="topnav">{inline}</div>',
    "<header><h1>{s}</h1><p>{s}</p></header>", '<div id="header"><h2>{s}</h2>{s}</div>', "<header>{s}</header>", '<div class="site-header masthead"><p>{s}</p></div>',
    "<footer>&copy; {s} &middot; {s}</footer>", '<div class="footer"><p>{s}</p><p>{s}</p></div>', "<footer><p>{p}</p></footer>", '<div id="footer">{s}</div>', '<p class="copyright">&copy; 2020 {s}</p>',
    "<aside><h3>{s}</h3><ul>{links}</ul></aside>", "<aside><p>{p}</p></aside>", '<div class="sidebar"><h3>{s}</h3><p>{p}</p></div>', '<div id="sidebar"><div class="widget"><p>{s}</p></div></div>', '<div class="right-column rail"><p>{p}</p></div>',
    '<div class="ad">{s}</div>', '<div class="ads"><p>{p}</p></div>', '<div class="advert">{p}</div>', '<div class="advertisement"><p>{s}</p></div>', '<div class="banner">{s}</div>', '<div class="sponsored"><p>{p}</p></div>', '<div class="promo">{s}</div>', '<div class="promotion sponsor"><p>{s}</p></div>', '<section class="ad-box">{p}</section>',
    '<div class="cookie-notice"><p>{s}</p><button>ok</button></div>', '<div class="notice">{p}</div>', '<div class="alert">{s}</div>', '<div id="cookie-banner"><p>{p}</p></div>', '<div class="gdpr consent">{s}</div>', '<div class="warning message"><p>{s}</p></div>', '<div class="popup modal"><p>{s}</p></div>', '<div class="disclaimer"><p>{p}</p></div>', '<p class="notice">{s}</p>',
    "<form><label>{s}</label><input><button>go</button></form>", '<form class="search"><p>{s}</p><input></form>', '<div class="newsletter"><p>{s}</p><form><input></form></div>', '<div class="subscribe signup"><p>{p}</p></div>', '<form id="login"><fieldset><legend>{s}</legend><input></fieldset></form>', "<form><p>{p}</p><textarea>x</textarea></form>",
    '<section class="comments"><h2>{s}</h2><div class="comment"><p>{p}</p></div><div class="comment"><p>{p}</p></div></section>', '<div id="comments"><p>{p}</p><p>{p}</p></div>', '<ol class="commentlist"><li><p>{p}</p></li><li><p>{p}</p></li></ol>', '<ul class="comments"><li>{p}</li><li>{s}</li></ul>', '<div class="reader-comments"><article class="comment"><p>{p}</p></article></div>', '<section id="responses" class="discussion"><p>{p}</p></section>', '<div class="reviews replies"><blockquote>{p}</blockquote></div>', '<div class="comment-thread"><div class="reply">{p}</div></div>',
    '<div class="related"><h3>{s}</h3><ul>{links}</ul></div>', '<div class="share social">{inline}</div>', '<div class="breadcrumbs">{inline}</div>', '<div class="pagination">{inline}</div>', '<div class="tags">{inline}</div>', '<div class="author-bio"><p>{p}</p></div>', '<section class="recommended more"><ul>{links}</ul></section>', '<div hidden><p>{p}</p></div>', '<div style="display:none">{s}</div>', '<div role="navigation">{inline}</div>', '<div role="complementary"><p>{p}</p></div>', '<div role="contentinfo">{s}</div>', '<div role="banner">{s}</div>', '<div role="alert">{s}</div>',
    '<section id="comments"><article><p>{p}</p></article><article><p>{s}</p></article></section>', '<div class="disqus thread"><p>{p}</p></div>', '<div class="legal terms">{p}</div>', '<div class="login account"><p>{s}</p></div>', '<div class="toolbar tools">{s}</div>', "<dialog><p>{s}</p></dialog>", "<menu><li>{s}</li></menu>", '<div class="related teaser"><p>{p}</p></div>', '<ul class="feedback"><li><article><p>{p}</p></article></li></ul>',
    '<div class="cookie">{s}</div>', '<div class="menu">{s}</div>', '<div class="share">{s}</div>', '<div class="comment"><p>{p}</p></div>', '<div class="reply">{p}</div>', '<div class="side">{p}</div>', '<div class="privacy">{s}</div>', '<p class="ad">{s}</p>', '<p class="comment">{p}</p>', "<div><form><label>{s}</label><select><option>x</option></select></form></div>",
]
INSIDE = ["<h1>{s}</h1>", "<h2>{s}</h2>", "<p>{p}</p>", "<p>{p}</p>", "<p>{p}</p>", "<p>{p}</p>", "<p>{s}</p>", "<p><b>{p}<br><p>{p}</p>", "<ul><li>{s}</li><li>{p}</li></ul>", "<blockquote><p>{p}</p></blockquote>", "<pre>{s}</pre>", "<figure><img><figcaption>{s}</figcaption></figure>", "<table><tr><th>{s}</th><td>{s}</td></tr></table>", "<p>{s} <a>{s}</a> {p}</p>", "<div>{p}</div>", "<h3>{s}</h3>", "<ol><li>{p}</li></ol>", "<dl><dt>{s}</dt><dd>{p}</dd></dl>", "<section><h2>{s}</h2><p>{p}</p></section>", "<p>{w}.</p>", "{p}"]


def labelled_pages(n: int, seed: int = 11) -> list[str]:
    """Pages in which ``data-truth`` says of a block, and all inside, whether it is content."""
    rng = random.Random(seed)
    words = ["".join(rng.choice(("ba", "ne", "tor", "il", "mur", "ash", "ver", "ko", "li", "sem")) for _ in range(rng.randint(1, 3))) for _ in range(300)]

    def surrounding() -> str:
        """Something beside the article; often with as much text as one of its paragraphs."""
        template = rng.choice(AROUND)
        return fill(template.replace("{s}", "{p}") if rng.random() < 0.4 else template)

    def fill(template: str) -> str:
        def part(m: re.Match) -> str:
            say = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b))).capitalize()
            kind = m[1]
            if kind == "links":
                return "".join(f'<li><a href="/{rng.choice(words)}">{say(1, 3)}</a></li>' for _ in range(rng.randint(2, 9)))
            if kind == "inline":
                return " ".join(f"<a>{say(1, 2)}</a>" for _ in range(rng.randint(2, 6)))
            return {"s": lambda: say(2, 9), "w": lambda: say(1, 2), "p": lambda: ". ".join(say(4, 18) for _ in range(rng.randint(1, 7))) + "."}[kind]()

        return re.sub(r"\{(links|inline|s|w|p)\}", part, template)

    out = []
    for _ in range(n):
        inner = [fill(rng.choice(INSIDE)) for _ in range(rng.randint(1, 14))]
        if rng.random() < 0.6:
            inner.insert(0, fill(rng.choice(("<h1>{s}</h1>", "<h1>{s}</h1><p>{p}</p>", "<h2>{s}</h2>"))))
        for _ in range(rng.choice((0, 1, 1, 2))):
            inner.insert(rng.randint(0, len(inner)), re.sub(r"^<(\w+)", r'<\1 data-truth="0"', surrounding()))
        body = rng.choice(ARTICLES).replace("{t}", 'data-truth="1"').replace("@", "".join(inner))
        # some pages have little but the article, and little of that
        alone = rng.random() < 0.2
        before, after = ("".join(surrounding() for _ in range(0 if alone else rng.randint(0, 4))) for _ in range(2))
        if alone and rng.random() < 0.5:
            body = rng.choice(ARTICLES[:10]).replace("{t}", 'data-truth="1"').replace("@", fill(rng.choice(("<p>{p}</p>", "<p>{s}</p>", "<h1>{s}</h1><p>{p}</p>", "{p}"))))
        if rng.random() < 0.25:
            body = f'<div class="{rng.choice(("page", "wrapper", "container", "row", "layout"))}">{before}{body}{after}</div>'
            before = after = ""
        if rng.random() < 0.15:
            out.append(f"{before}{body}{after}")
        else:
            out.append(f"<!DOCTYPE html><html><head><title>{fill('{s}')}</title></head><body>{before}{body}{after}</body></html>")
    return out


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row a page: page_id, url, text (blocks of content joined by a line feed) and n_chars, its code points."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts: list[str] = []
            part: list[str] = []
            held = 0
            for x in batch.column(2):
                part.append(x.as_py() or "")
                held += len(part[-1])
                if held >= FOREST_BYTES:
                    texts += model.texts(part)
                    part, held = [], 0
            texts += model.texts(part)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    narrow = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).alias("html"))
    return narrow.mapInArrow(work, "page_id long, url string, text string, n_chars long")
