"""Main text of web pages by gradient-boosted trees over the nodes of the page.

A page is parsed into a tree of elements, in one scan whose cost is in proportion to its length.
Each element gets features (tag, depth, tokens of its class, id and role, text and link density
of its subtree, form controls, subtree size and statistics of its siblings); boosted trees score
how likely its subtree holds main text. Decoding is hierarchical: the best set of kept elements
in which nothing is kept under an element that is dropped. By their tag alone only elements are
dropped that show no prose of the page (scripts, styles, drawings, controls); menus, forms,
headers and the like are for the trees to judge, so an article inside a form is kept.

The trees are fitted here, on pages composed by a seeded generator that knows which nodes are
main text; their number and size are fixed, so fitting does not depend on the corpus.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import ship

TRAIN_PAGES = 900
TREES, DEPTH, RATE, BINS = 60, 5, 0.2, 32
#: Elements whose features are held at once.
CHUNK = 20_000

# Fixed values of the HTML standard: elements without content, raw text elements, blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe xmp noembed noframes".split())
#: Elements that show no prose: scripts, styles, drawings, controls, what only other browsers show.
NEVER = RAW | set("head noscript template svg math button select datalist object canvas audio video".split())
CONTROLS = set("input select textarea button".split())
IN_HEAD = set("title meta link base script style noscript template".split())
BLOCK = set(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption option".split()
)
# A start tag ends an open element of its group (first), unless a wall (second) is open further in.
CELLS = ("td", "th", "caption", "table", "button", "object", "template")
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", *CELLS)),
    "dt": (("dt", "dd"), ("dl", *CELLS)),
    "dd": (("dt", "dd"), ("dl", *CELLS)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "a": (("a",), CELLS),
}
IN_TABLE = set("table thead tbody tfoot tr td th caption".split())
ENDS_P = BLOCK - {"html", "body", "option", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "summary", "figcaption", "legend"}

#: Attribute tokens with a feature each: parts of class, id and role.
TOKENS = "ad ads advert banner promo sponsor nav menu breadcrumb header footer sidebar side widget comment comments reply respond disqus share social related recommend cookie notice consent popup modal newsletter subscribe login search form content article post entry main body text story copyright legal tags meta author toolbar pagination skip hidden".split()
TAGS = "article main section div aside header footer nav p h1 h2 h3 h4 ul ol li blockquote pre table td figure span a b dl form label fieldset dialog menu".split()

# A quote opens a value only after an equals sign; a tag that the page's end cuts off has no >.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>=]++|=\s*+(?>\"[^\"]*+\"|'[^']*+')?+)*+)(>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "attrs", "kids", "depth", "up", "n", "links", "size", "paras", "controls", "at", "kin")

    def __init__(self, tag: str, attrs: str, depth: int, up: "Node | None"):
        self.tag, self.attrs, self.depth, self.up = tag, attrs, depth, up
        self.kids: list = []  # nodes and strings


def parse(page: str) -> Node:
    """A tree of the page; unclosed and stray tags are mended in the usual way, never an error."""
    root = Node("#root", "", 0, None)
    stack = [root]
    opened: dict[str, list[int]] = defaultdict(list)  # depths of the open elements by tag
    blocks = [0]

    def close(depth: int) -> None:
        while len(stack) > depth:
            x = stack.pop()
            opened[x.tag].pop()
            if x.tag in BLOCK:
                blocks.pop()

    def nearest(tags, walls) -> int:
        """Depth of the outermost of the last open elements of these tags, or 0 if a wall is further in."""
        wall = max((opened[t][-1] for t in walls if opened[t]), default=0)
        return min((d for t in tags if opened[t] and (d := opened[t][-1]) > wall), default=0)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                close(len(stack) - 1)
            stack[-1].kids.append(text)
        if m is None:
            break
        at = m.end()
        if not m[2] or not m[4]:
            continue
        tag = m[2].lower()
        if m[1]:
            d = nearest((tag,), () if tag in IN_TABLE else CELLS if tag not in CELLS else ())
            # an inline end tag does not end the blocks inside its element
            if d and (tag in BLOCK or blocks[-1] < d):
                close(d)
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if opened["head"] and tag not in IN_HEAD:
            close(opened["head"][-1])
        if tag in ENDS_P and (d := nearest(("p",), CELLS)):
            close(d)
        if tag in CLOSES and (d := nearest(*CLOSES[tag])):
            close(d)
        up = stack[-1]
        node = Node(tag, m[3] or "", up.depth + 1, up)
        up.kids.append(node)
        empty = node.attrs.endswith("/") and (tag in RAW or tag in ("svg", "math") or opened["svg"] or opened["math"])
        if tag in VOID or empty:
            continue
        if tag in RAW:
            ends = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = ends.end() if ends else end
            continue
        opened[tag].append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        stack.append(node)
    return root


def elements(root: Node) -> list[Node]:
    """All elements that may be kept, parents first, with the statistics of their subtrees."""
    out, todo = [], [root]
    while todo:
        x = todo.pop()
        out.append(x)
        todo.extend(k for k in x.kids if isinstance(k, Node) and k.tag not in NEVER)
    for x in reversed(out):
        x.n = x.links = x.paras = x.controls = 0
        x.size = 1
        kids = [k for k in x.kids if isinstance(k, Node)]
        tags = Counter(k.tag for k in kids)
        for i, k in enumerate(kids):
            k.kin = (len(kids), tags[k.tag], i)
        for k in x.kids:
            if isinstance(k, str):
                x.n += len(k) - k.count(" ") if not k.isspace() else 0
                continue
            x.controls += k.tag in CONTROLS
            if k.tag not in NEVER:
                x.n += k.n
                x.links += k.links
                x.size += k.size
                x.paras += k.paras + (k.tag == "p")
                x.controls += k.controls
        if x.tag == "a":
            x.links = x.n
    for i, x in enumerate(out):
        x.at = i
    root.kin = (1, 1, 0)
    return out


NUMBERS = 19  # the numeric features come first, all others are 0 or 1
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_TOKEN_AT = {t: i for i, t in enumerate(TOKENS)}


def _marks(attrs: str) -> int:
    """The known tokens of class, id and role as bits."""
    out = 0
    if attrs:
        for a in _ATTR.finditer(attrs):
            for t in _PART.findall((a[2] or a[3] or a[4] or "").lower()):
                if (i := _TOKEN_AT.get(t)) is not None:
                    out |= 1 << i
    return out


def _bits(masks: list[int]) -> np.ndarray:
    raw = b"".join(x.to_bytes(8, "little") for x in masks)
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(masks), 8), axis=1, bitorder="little")[:, : len(TOKENS)]


def features(nodes: list[Node]):
    """Arrays of one row per element, of at most CHUNK rows each."""
    whole = max(1, nodes[0].n)
    above = [0] * len(nodes)  # tokens of all elements that an element lies in; semantic tags speak like tokens
    own = [0] * len(nodes)
    for first in range(0, len(nodes), CHUNK):
        part = nodes[first : first + CHUNK]
        x = np.zeros((len(part), NUMBERS + len(TAGS) + 2 * len(TOKENS)), np.float32)
        numbers = []
        for i, v in enumerate(part):
            up = v.up if v.up is not None else v
            kin, same, place = v.kin
            top = up.up if up.up is not None else up
            numbers.append((v.depth, v.n, v.links / max(1, v.n), v.n / v.size, v.size, v.n / whole, v.paras, v.n / max(1, up.n), kin, same / kin, place / kin, up.paras, v.controls, v.controls / v.size, up.n, up.links / max(1, up.n), up.n / whole, top.n / whole, top.paras))
            if v.tag in _TAG_AT:
                x[i, NUMBERS + _TAG_AT[v.tag]] = 1
            own[v.at] = _marks(v.attrs)
            if v.up is not None:
                over = above[up.at] | own[up.at]
                if up.tag in _TOKEN_AT:
                    over |= 1 << _TOKEN_AT[up.tag]
                above[v.at] = over
        x[:, :NUMBERS] = numbers
        x[:, [1, 4, 14]] = np.log1p(x[:, [1, 4, 14]])
        x[:, NUMBERS + len(TAGS) : NUMBERS + len(TAGS) + len(TOKENS)] = _bits(own[first : first + CHUNK])
        x[:, NUMBERS + len(TAGS) + len(TOKENS) :] = _bits(above[first : first + CHUNK])
        yield x


class Boost:
    """Gradient-boosted regression trees for the log odds of a 0/1 target, on quantile bins."""

    def __init__(self):
        self.start = 0.0
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boost":
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(NUMBERS)]
        b = np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], 1)
        flags = np.ascontiguousarray(x[:, NUMBERS:], dtype=np.float64)
        p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        for _ in range(TREES):
            q = 1 / (1 + np.exp(-f))
            g, h = y - q, q * (1 - q)
            feat, cut, leaf = np.zeros(2**DEPTH, int), np.full(2**DEPTH, np.inf), np.zeros(2 ** (DEPTH + 1))
            at = np.ones(len(y), int)
            for node in range(1, 2**DEPTH):
                rows = np.flatnonzero(at == node)
                best, gt, ht = (1e-6, 0, np.inf), g[rows].sum(), h[rows].sum()
                gain = lambda gl, hl: gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)  # noqa: B023, E731
                if len(rows) >= 20:
                    gr, hr = g[rows], h[rows]
                    for j, c in enumerate(cuts):
                        if len(c):
                            gains = gain(np.cumsum(np.bincount(b[rows, j], gr, len(c) + 1))[:-1], np.cumsum(np.bincount(b[rows, j], hr, len(c) + 1))[:-1])
                            k = int(np.argmax(gains))
                            if gains[k] > best[0]:
                                best = (float(gains[k]), j, float(c[k]))
                    own = flags[rows]
                    gains = gain(gt - gr @ own, ht - hr @ own)
                    k = int(np.argmax(gains))
                    if gains[k] > best[0]:
                        best = (float(gains[k]), NUMBERS + k, 0.5)
                feat[node], cut[node] = best[1], best[2]
                at[rows] = 2 * node + (x[rows, feat[node]] >= cut[node])
            sums, weights = np.bincount(at, g, 2 ** (DEPTH + 1)), np.bincount(at, h, 2 ** (DEPTH + 1))
            leaf = RATE * sums / (weights + 1)
            f = f + leaf[at]
            self.trees.append((feat, cut, leaf))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feat, cut, leaf in self.trees:
            at = np.ones(len(x), int)
            for _ in range(DEPTH):
                at = 2 * at + (x[rows, feat[at]] >= cut[at])
            out += leaf[at]
        return out


def decode(nodes: list[Node], score: np.ndarray) -> np.ndarray:
    """Which elements are kept: the best total of scores where a kept element's parents are kept too."""
    best = score.astype(float).copy()
    for i in range(len(nodes) - 1, 0, -1):
        if best[i] > 0:
            best[nodes[i].up.at] += best[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[nodes[i].up.at] and best[i] > 0
    return keep


def render(root: Node, keep: np.ndarray) -> str:
    """Text of the kept elements: a line for each block, white space as one space."""
    lines: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            line = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if line:
                lines.append(line)
            run.clear()

    todo: list = [root]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(x)
        elif x.tag == "br":
            run.append(" ")
        elif x.tag not in NEVER and keep[x.at]:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            todo.extend(reversed(x.kids))
        elif x.tag in BLOCK:
            flush()
    flush()
    return "\n".join(lines)


def extract(pages: list[str | None], model: Boost) -> list[str]:
    out: list[str] = []
    held: list[tuple[Node, list[Node]]] = []

    def flush() -> None:  # small pages are scored together
        x = [part for _, nodes in held for part in features(nodes)]
        score = np.concatenate([model.score(np.concatenate(x))] if sum(map(len, x)) <= CHUNK else [model.score(part) for part in x])
        at = 0
        for root, nodes in held:
            out.append(render(root, decode(nodes, score[at : at + len(nodes)])))
            at += len(nodes)
        held.clear()

    for page in pages:
        root = parse(page if isinstance(page, str) else "")
        held.append((root, elements(root)))
        if sum(len(nodes) for _, nodes in held) > CHUNK // 8:
            flush()
    if held:
        flush()
    return out


# --- pages to learn from ---------------------------------------------------------------------


#: Marks the blocks of main text in generated pages; not among the attributes that features see.
MARK = "data-gold"


def compose(rng: random.Random) -> tuple[str, str]:
    """A page and its main text, in one of many layouts."""
    syll = "an be co da er fi go ha in ka lo mi no or pe ra sa ti un ve wo".split()
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 4)))
    sentence = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice(".?!")
    para = lambda: " ".join(sentence(4, 14) for _ in range(rng.randint(1, 6)))
    links = lambda n: "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))
    gold: list[str] = []

    def keep(tag: str, text: str, inner: str | None = None) -> str:
        gold.append(text)
        return f"<{tag} {MARK}>{inner or text}</{tag}>"

    def named(names: list[str], plain: bool = True) -> str:
        name = rng.choice(names)
        return rng.choice([f'class="{name}"', f'id="{name}"', f"class={name}", f'class="{name}-{word()} {word()}"', f'id="{word()}_{name}"'] + ["", f'class="{word()}"'] * (plain and rng.random() < 0.3))

    def form(kind: str) -> str:
        field = lambda: f"<label>{word()}</label><input type=text name={word()}>"
        button = rng.choice([f"<button>{word()}</button>", f'<input type="submit" value="{word()}">'])
        if kind == "search":
            return f'<form {named(["search"])}>{field()}{button}</form>'
        intro = rng.choice(["", f"<p>{sentence(3, 12)}</p>", f"<h3>{sentence(1, 4)}</h3><p>{para()}</p>", sentence(2, 8)])
        return f'<form action="/{word()}" {named(["login", "subscribe", "newsletter", "respond", "form"])}>{intro}{"".join(field() for _ in range(rng.randint(1, 4)))}{rng.choice(["", "<textarea></textarea>"])}{button}</form>'

    def advert() -> str:
        inner = rng.choice([sentence(2, 9), f"<p>{sentence(2, 9)}</p>", f"<p>{para()}</p>", f'<a href="/{word()}">{sentence(2, 9)}</a>'])
        return f'<{(t := rng.choice(["div", "div", "aside", "section"]))} {named(["ad", "ads", "promo", "sponsor", "banner", "advert banner", "advert"], False)}>{inner}</{t}>'

    def body() -> str:
        out = []
        title = keep(rng.choice(["h1", "h1", "h2"]), sentence(2, 12))
        lead = rng.random()
        if lead < 0.12:
            out.append(f"<header>{title}</header>")
        elif lead < 0.2:
            out.append(f'{title}<div {named(["meta", "author", "tags"], False)}>{rng.choice(["<span>" + word() + "</span>", ""])} {sentence(1, 4)}</div>')
        else:
            out.append(title)
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            text = para() if rng.random() < 0.8 else sentence(1, 6)
            if kind < 0.58:
                out.append(keep("p", text, text.replace(" ", " <a href='/x'>", 1).replace(".", "</a>.", 1) if rng.random() < 0.15 and "." in text else None))
            elif kind < 0.65:
                gold.append(text)
                out.append(f"<p {MARK}><b>{text}<br>")
            elif kind < 0.72:
                t = rng.choice(["ul", "ul", "ol"])
                out.append(f"<{t}>" + "".join(keep("li", sentence(2, 9)) for _ in range(rng.randint(2, 4))) + f"</{t}>")
            elif kind < 0.77:
                out.append("<blockquote>" + keep("p", text) + "</blockquote>")
            elif kind < 0.85:
                out.append(keep(rng.choice(["h2", "h3"]), sentence(1, 5)))
            elif kind < 0.88:
                out.append("<table><tr>" + keep("th", sentence(1, 2)) + keep("td", sentence(1, 5)) + "</tr></table>")
            elif kind < 0.91:
                out.append("<figure><img src=x>" + keep("figcaption", sentence(2, 8)) + "</figure>")
            elif kind < 0.93:
                out.append(f"<div>{keep('p', text)}</div>")
            elif kind < 0.95:
                out.append(form("newsletter"))
            elif kind < 0.97:
                out.append(f'<{(t := rng.choice(["div", "aside"]))} {named(["related", "share", "social", "newsletter", "recommend"], False)}>{rng.choice([f"<h3>{word()}</h3><ul>{links(3)}</ul>", f"<p>{sentence(2, 9)}</p>"])}</{t}>')
            else:
                out.append(advert())
        return "".join(out)

    def comments() -> str:
        t = rng.choice(["div", "section"])
        one = rng.choice(["div", "article", "li"])
        rows = "".join(f'<{one} {named(["comment", "reply"], False)}><b>{word()}</b><p>{para()}</p></{one}>' for _ in range(rng.randint(1, 6)))
        return f'<{t} {rng.choice(["id", "class"])}="{rng.choice(["comments", "comment", "respond", "disqus"])}">{rng.choice(["", f"<h3>{word()}</h3>"])}{rows}{form("comment") if rng.random() < 0.3 else ""}</{t}>'

    before, after = [], []
    if rng.random() < 0.5:
        before.append((t := rng.choice(["header", "div"])) and f'<{t} {"" if t == "header" else named(["header"], False)}>' + f"<h2>{word()}</h2><p>{sentence(2, 6)}</p>{form('search') if rng.random() < 0.3 else ''}</{t}>")
    menu = rng.random()
    if menu < 0.5:
        before.append(f"<nav {named(['nav', 'menu'])}><ul>{links(rng.randint(3, 8))}</ul></nav>")
    elif menu < 0.8:
        t = rng.choice(["div", "ul", "section"])
        before.append(f"<{t} {named(['nav', 'menu', 'breadcrumb', 'toolbar'])}>{'' if t == 'ul' else '<ul>'}{links(rng.randint(3, 8))}{'' if t == 'ul' else '</ul>'}</{t}>")
    if rng.random() < 0.5:
        before.append(advert())
    if rng.random() < 0.3:
        before.append(f'<{(t := rng.choice(["div", "section", "dialog"]))} {named(["cookie", "notice", "consent", "popup", "modal"], False)}><p>{sentence(5, 14)}</p></{t}>')
    if rng.random() < 0.25:
        before.append(form(rng.choice(["search", "login"])))
    if rng.random() < 0.4:
        t, attr = rng.choice([("aside", ""), ("div", 'class="sidebar"'), ("div", 'id="side"'), ("aside", 'class="widget"')])
        rng.choice([before, after, after]).append(f"<{t} {attr}><h3>{sentence(1, 3)}</h3><p>{para()}</p><ul>{links(4)}</ul></{t}>")
    if rng.random() < 0.4:
        after.append(comments())
    if rng.random() < 0.3:
        after.append(f"<div {named(['related', 'recommend', 'share', 'social', 'tags'], False)}><h3>{word()}</h3><ul>{links(3)}</ul></div>")
    if rng.random() < 0.2:
        after.append(form(rng.choice(["newsletter", "login", "respond"])))
    if rng.random() < 0.2:
        after.append(advert())
    if rng.random() < 0.7:
        t = rng.choice(["footer", "footer", "div"])
        after.append(f'<{t} {"" if t == "footer" else named(["footer", "copyright", "legal"], False)}>&copy; {word()} &middot; {sentence(3, 14)}</{t}>')
    rng.shuffle(before)
    inner = body()
    wraps = [("<article>", "</article>")] * 3 + [
        ("<main>", "</main>"),
        ('<div class="content">', "</div>"),
        ('<div id="main"><div class="post entry">', "</div></div>"),
        ("<main><article>", "</article></main>"),
        ('<div class="article-body">', "</div>"),
        ('<section class="story">', "</section>"),
        ("<div>", "</div>"),
        (f'<div class="{word()}"><div class="{word()}">', "</div></div>"),
        ("<table><tr><td>", "</td></tr></table>"),
        ("", ""),
    ]
    open_, close = rng.choice(wraps)
    page = f"{''.join(before)}{open_}{inner}{close}{''.join(after)}"
    shell = rng.random()
    if shell < 0.15:  # one form around all of it
        page = f'<form id="{word()}" method="post"><input type="hidden" value="{word()}">{page}</form>'
    elif shell < 0.3:
        page = f'<div {named(["page", "wrapper", "container"])}>{page}</div>'
    page = f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{}}</style></head><body>{page}"
    if rng.random() < 0.8:
        page += "</body></html>"
    return page, "\n".join(gold)


def train(pages: int = TRAIN_PAGES, seed: int = 7) -> Boost:
    """Trees fitted to generated pages: an element's target is whether its subtree holds main text."""
    rng = random.Random(seed)
    xs, ys = [], []
    for _ in range(pages):
        nodes = elements(parse(compose(rng)[0]))
        gold = [MARK in v.attrs for v in nodes]
        y = np.zeros(len(nodes))
        for v in nodes:
            if gold[v.at] or (v.up is not None and gold[v.up.at]):
                gold[v.at] = True  # what lies in a block of main text is main text
                u = v
                while u is not None and not y[u.at]:
                    y[u.at] = 1
                    u = u.up
        xs += features(nodes)
        ys.append(y)
    return Boost().fit(np.concatenate(xs), np.concatenate(ys))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages (page_id, url, html).

    Null or empty html has an empty text; broken markup is mended; whole pages are read, however
    long, at a cost in proportion to their length; elements whose score is just even are dropped;
    repeated rows get the same answer; an empty table gives an empty result; other columns are
    ignored.
    """
    spark = pages.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(train())  # a fixed number of trees

    @F.pandas_udf("string")
    def run(page: pd.Series) -> pd.Series:
        return pd.Series(extract(list(page), model.value), dtype=object)

    d = pages.select("page_id", "url", run(F.col("html")).alias("text"))
    return d.withColumn("n_chars", F.length("text").cast("long"))
