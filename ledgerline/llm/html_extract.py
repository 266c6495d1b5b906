"""Main-text extraction by gradient-boosted trees over DOM-node features with hierarchical decoding.

A page is read into a tree of block elements; inline elements only add to their block's text. Every
block has features of its own and of its subtree: depth, text and link density, share of paragraphs,
attribute tokens, siblings of its kind, place in the page, and the same of its parent. Boosted trees give
each block the probability that its text belongs to the article. Decoding goes bottom up: a subtree is
all article, all chrome, or split among its children at a price, whichever is likeliest for its text, so
no block is kept below one that is rejected as a whole, nor the other way round.

The trees are trained here on pages made by a seeded generator with known article blocks (page_sample):
many layouts of menus, headers, footers, sidebars, notices, adverts, forms, comments and articles, among them pages of bare
paragraphs or lines, of table cells, and of boxes without classes.

Defined results: null or empty html gives an empty text; a page without markup is one block; unclosed and
stray tags are read as browsers do, roughly (a paragraph ends the open one, an end tag closes what is open
within its element, else is ignored; of an unclosed video, select, svg or the like only the tag is dropped);
script, style, template and head content is never text; formulas are; character references are decoded;
white space becomes one space, blocks are joined by one space; nothing is cut; a quote that no other closes
is an ordinary sign of its tag, and a tag that nothing ends is text; repeated rows are read each; other
columns are ignored. A page is read in time linear in its length, whatever it holds.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = set(
    "html body div section article main header footer nav aside p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption pre blockquote figure figcaption "
    "form fieldset address details summary hgroup menu dialog center".split()
)
#: Elements whose content is raw up to their first end tag, or to the end of the page, and isn't text of the page.
RAW = set("script style noscript title textarea iframe".split())
#: Elements that nest and whose content isn't text of the page; without an end tag of its own only a template reaches to the end of the page.
SKIPPED = set("template svg select object audio video canvas annotation annotation-xml".split())
#: Elements that are part of a form, whatever is in them.
CONTROLS = set("button label option input legend".split())
VOID = set("area base br col embed hr img input link meta source track wbr".split())
#: Opening one of these ends an open paragraph.
_ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}

_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
#: A tag of usual size, read at once; bounded, so that an attempt that fails costs little.
_USUAL = re.compile(r"""<(/?)([A-Za-z][^\s/>]{0,80}+)((?:[^>"']{1,300}+|"[^"]{0,500}+"|'[^']{0,500}+'){0,40}+)>""")
_LONG_NUMBER = re.compile(r"&#[0-9]{8,};?")
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: A value without quotes, which a slash at the end belongs to.
_OPEN_VALUE = re.compile(r"""=\s*[^\s"'=<>`]*/$""")
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

#: Attribute tokens by what they speak of.
TOKENS = {
    "advert": "ad ads adv advert adverts advertisement adsense adbox banner sponsor sponsored promo promotion dfp taboola outbrain",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toc links toolbar skip navlist topbar",
    "side": "sidebar side aside widget widgets rail related recommended popular trending tags tagcloud archive archives more",
    "edge": "header footer masthead foot bottom copyright top branding logo legal credits colophon",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay warning message toast subscribe newsletter paywall disclaimer privacy",
    "comment": "comment comments commentlist reply replies respond discussion disqus reader responses",
    "form": "form search login signup register contact input field share sharing social follow poll survey",
    "article": "article content main post entry story text body prose hentry markdown page read",
}
_OF_TOKEN = {t: k for k, ts in enumerate(TOKENS.values()) for t in ts.split()}
_KINDS = ["article", "main", "section", "div", "header", "footer", "nav", "aside", "p", "h", "list", "li", "table", "quote", "form", "body", "root", "figure", "control"]
_OF_TAG = {t: k for k, t in enumerate(_KINDS)} | {f"h{i}": 9 for i in range(1, 7)} | {t: 10 for t in ("ul", "ol", "dl", "menu")} | {"dt": 11, "dd": 11} | {t: 12 for t in ("tr", "td", "th", "tbody", "thead", "tfoot", "caption")}
_OF_TAG |= {"pre": 13, "blockquote": 13, "fieldset": 14, "html": 16, "figcaption": 17} | {t: 18 for t in CONTROLS | {"summary", "details", "dialog"}}
N_TOKENS, N_KINDS = len(TOKENS), len(_KINDS)


@dataclass
class Tree:
    """Blocks in page order: parent's number, kind, attribute flags; and texts in page order with their block, and whether in a link."""

    parent: list[int]
    kind: list[int]
    flags: list[int]
    tag: list[str]
    text: list[str]
    text_block: list[int]
    text_link: list[bool]
    text_begins: list[bool]


def _attribute_flags(attributes: str) -> int:
    """What the attributes speak of; only those of usual length are kept in the cache."""
    return (_cached_flags if len(attributes) < 512 else _cached_flags.__wrapped__)(attributes)


@lru_cache(maxsize=4096)
def _cached_flags(attributes: str) -> int:
    flags = 0
    for name, *values in _ATTRIBUTE.findall(attributes):
        value = "".join(values)
        low = name.lower()
        if low == "hidden" or (low == "aria-hidden" and value == "true") or (low == "style" and re.search(r"display\s*:\s*none", value)):
            flags |= 1 << N_TOKENS
        elif low in ("class", "id", "role"):
            for word in _SPLIT.findall(value):
                of = _OF_TOKEN.get(word.lower())
                if of is not None:
                    flags |= 1 << of
    return flags


class Reader:
    """The tags of a page, one after another."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.quoted = True  # whether quotes hide a '>'; no longer once that left a tag open to the end of the page

    def _end(self, at: int) -> int:
        """Where the tag that has been read up to at ends, at its '>'; -1 if nowhere."""
        page = self.page
        if self.quoted:
            here = at
            while (m := _STOP.search(page, here)) is not None:
                sign, here = m[0], m.end()
                if sign == ">":
                    return here - 1
                if self.last[sign] >= here:
                    here = page.find(sign, here) + 1
            self.quoted = False
        return page.find(">", at)

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """Begin, end, name, whether it closes and attributes of the first tag, comment or declaration from at on; the latter have no name."""
        page = self.page
        while (begin := page.find("<", at)) >= 0:
            if self.quoted and (usual := _USUAL.match(page, begin)) is not None:
                closing, name, attributes = usual.groups()
                return begin, usual.end(), name.lower(), closing == "/", attributes
            sign = page[begin + 1 : begin + 2]
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 4)
                return begin, end + 3 if end >= 0 else len(page), "", False, ""
            if sign in ("!", "?") and sign:
                end = page.find(">", begin)
                return begin, end + 1 if end >= 0 else len(page), "", False, ""
            name = _NAME.match(page, begin + 1 + (sign == "/"))
            if name is not None:
                end = self._end(name.end())
                if end < 0:
                    return None
                return begin, end + 1, name[0].lower(), sign == "/", page[name.end() : end]
            at = begin + 1
        return None


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the raw content from at on, and its end tag, end."""
    begin = _raw_close(name).search(page, at)
    end = page.find(">", begin.end()) if begin else -1
    return end + 1 if end >= 0 else len(page)


@lru_cache(maxsize=64)
def _raw_close(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?![\w-])", re.I)


def _skipped_ends(page: str) -> dict[int, int]:
    """For the end of each start tag of a skipped element where its own end tag ends; those without one are left out."""
    ends: dict[int, int] = {}
    begun: dict[str, list[int]] = {name: [] for name in SKIPPED}
    reader, at = Reader(page), 0
    while (tag := reader.next(at)) is not None:
        _, at, name, closes, attributes = tag
        if name in SKIPPED:
            if not closes:
                if not attributes.endswith("/"):
                    begun[name].append(at)
            elif begun[name]:
                ends[begun[name].pop()] = at
        elif name in RAW and not closes and not (attributes.endswith("/") and begun["svg"]):
            at = _raw_end(page, name, at)
    return ends


class Open:
    """The open elements, with the places of each name, so that no look-up walks along them."""

    def __init__(self) -> None:
        self.entries: list[tuple[str, int]] = [("#root", 0)]  # name, and the block that was current before it; -1 if it's none
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, name: str, before: int) -> None:
        self.places.setdefault(name, []).append(len(self.entries))
        if before >= 0:
            self.blocks.append(len(self.entries))
        self.entries.append((name, before))

    def pop(self) -> tuple[str, int]:
        name, before = self.entries.pop()
        self.places[name].pop()
        if before >= 0:
            self.blocks.pop()
        return name, before

    def innermost(self, names: set[str] | tuple[str, ...]) -> int:
        """The place of the innermost open element of these names; 0 if there is none."""
        found = 0
        for name in names:
            own = self.places.get(name)
            if own and own[-1] > found:
                found = own[-1]
        return found


_CELLS = ("td", "th", "table", "article", "body")


def parse(page: str) -> Tree:
    """The page's blocks and texts."""
    t = Tree([-1], [_OF_TAG["root"]], [0], ["#root"], [], [], [], [])
    opened, reader = Open(), Reader(page)
    block, links, fresh, at, n = 0, 0, True, 0, len(page)
    text, text_block, text_link, text_begins = t.text, t.text_block, t.text_link, t.text_begins
    skipped: dict[int, int] | None = None

    def put(raw: str) -> None:
        nonlocal fresh
        if raw:
            text.append(entities.unescape(_LONG_NUMBER.sub("\ufffd", raw)) if "&" in raw else raw)
            text_block.append(block)
            text_link.append(links > 0)
            text_begins.append(fresh)
            fresh = False

    def close(depth: int) -> None:
        nonlocal block, links, fresh
        while len(opened.entries) > depth:
            name, before = opened.pop()
            if name == "a":
                links -= 1
            elif before >= 0:
                block, fresh = before, True

    while at < n:
        tag = reader.next(at)
        if tag is None:
            put(page[at:])
            break
        begin, end, name, closes, attributes = tag
        if begin > at:
            put(page[at:begin])
        at = end
        if not name:
            continue
        if closes:
            depth = opened.innermost((name,))
            if depth and (name in BLOCKS or depth == len(opened.entries) - 1 or opened.innermost(_CELLS) <= depth):
                close(depth)
            continue
        if name in RAW:
            if not attributes.endswith("/") or name in ("script", "style", "title", "textarea"):
                at = _raw_end(page, name, at)
            continue
        if name in SKIPPED:
            if not attributes.endswith("/"):
                skipped = _skipped_ends(page) if skipped is None else skipped
                at = skipped.get(at, n if name == "template" else at)
            continue
        if name == "br" or name == "hr":
            put(" ")
            continue
        if name in VOID:
            continue
        if name in _ENDS_P and opened.blocks and opened.entries[opened.blocks[-1]][0] == "p":
            close(opened.blocks[-1])
        if name in _SAME:
            depth = opened.innermost({"dt", "dd"} if name in ("dt", "dd") else {"td", "th"} if name in ("td", "th") else {name})
            if depth > opened.innermost(_SAME[name]):
                close(depth)
        if attributes.endswith("/") and name not in BLOCKS and not _OPEN_VALUE.search(attributes):
            continue
        if name == "a":
            links += 1
            opened.push(name, -1)
        elif name in BLOCKS or name in CONTROLS or "-" in name:
            opened.push(name, block)
            t.parent.append(block)
            t.kind.append(_OF_TAG.get(name, _OF_TAG["div"]))
            t.flags.append(_attribute_flags(attributes) if attributes else 0)
            t.tag.append(name)
            block, fresh = len(t.parent) - 1, True
        elif name != "head":
            opened.push(name, -1)
    return t


def features(t: Tree) -> tuple[np.ndarray, np.ndarray]:
    """A row of features per block; and the characters of each block's own text."""
    n = len(t.parent)
    parent = np.array(t.parent)
    kind, flags = np.array(t.kind), np.array(t.flags)
    own, own_link, own_marks = np.zeros(n), np.zeros(n), np.zeros(n)
    if t.text:
        of = np.array(t.text_block)
        size = np.array([len(x.strip()) for x in t.text], float)
        marks = np.array([x.count(".") + x.count(",") for x in t.text], float)
        np.add.at(own, of, size)
        np.add.at(own_link, of, size * np.array(t.text_link))
        np.add.at(own_marks, of, marks)
    depth, sub, sub_link, sub_marks = np.zeros(n), own.copy(), own_link.copy(), own_marks.copy()
    sub_p, sub_blocks, sub_li = own * (kind == 8), np.ones(n), own * (kind == 11)
    kids, above = np.zeros(n), np.zeros(n, np.int64)
    alike = np.zeros(n)
    place = np.zeros(n)
    counts: dict[tuple[int, int], int] = {}
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        above[i] = above[p] | flags[p] | ((1 << N_TOKENS + 1 + t.kind[p]) if t.kind[p] in (0, 1, 4, 5, 6, 7, 14) else 0)
        place[i] = kids[p]
        kids[p] += 1
        key = (int(p), t.kind[i])
        counts[key] = counts.get(key, 0) + 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        for a in (sub, sub_link, sub_marks, sub_p, sub_blocks, sub_li):
            a[p] += a[i]
        alike[i] = counts[(int(p), t.kind[i])]
    total = max(sub[0], 1.0)
    biggest = own - own_link
    for i in range(n - 1, 0, -1):
        biggest[parent[i]] = max(biggest[parent[i]], biggest[i])
    begin = np.zeros(n)
    first = np.full(n, len(t.text))
    if t.text:
        np.minimum.at(first, of, np.arange(len(t.text)))
        run = np.concatenate([[0], np.cumsum(size)])
        for i in range(n - 1, 0, -1):
            first[parent[i]] = min(first[parent[i]], first[i])
        begin = run[np.minimum(first, len(t.text))] / total
    up = np.maximum(parent, 0)
    density = sub_link / np.maximum(sub, 1)
    columns = [
        np.minimum(depth, 12),
        np.full(n, np.log1p(sub[0])),
        np.full(n, np.log1p((own > 0).sum())),
        np.full(n, sub_link[0] / total),
        np.full(n, float(np.isin(kind, (0, 1)).any())),
        np.full(n, float((flags > 0).any())),
        own / max(own.max(), 1.0),
        biggest / max(own.max(), 1.0),
        np.log1p(sub - sub_link),
        np.log1p(own),
        np.log1p(sub),
        sub / total,
        begin,
        density,
        sub_marks / np.maximum(sub, 1),
        sub_p / np.maximum(sub, 1),
        sub_li / np.maximum(sub, 1),
        np.log1p(sub_blocks),
        np.log1p(sub / sub_blocks),
        np.minimum(kids, 30),
        np.minimum(alike, 30),
        place / np.maximum(kids[up], 1),
        density[up],
        np.log1p(sub[up]),
        (sub_p / np.maximum(sub, 1))[up],
        sub / np.maximum(sub[up], 1),
        kind[up],
    ]
    columns += [(kind == k).astype(float) for k in range(N_KINDS)]
    columns += [(flags >> k & 1).astype(float) for k in range(N_TOKENS + 1)]
    columns += [(above >> k & 1).astype(float) for k in range(N_TOKENS + 1)]
    columns += [(above >> (N_TOKENS + 1 + k) & 1).astype(float) for k in (0, 1, 4, 5, 6, 7, 14)]
    return np.stack(columns, axis=1), own


@dataclass
class Trees:
    """Boosted trees of one depth: the feature and threshold of each inner node, the value of each leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, th, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > th[at])
            total += leaf[at - (leaf.size - 1)]
        return 1 / (1 + np.exp(-total))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32) -> Trees:
    """Trees for the weighted logistic loss, by histograms of quantile bins."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    code = np.stack([np.searchsorted(cut, c, "left") for cut, c in zip(cuts, x.T, strict=True)], axis=1)
    base = float(np.log((weight * y).sum() / (weight * (1 - y)).sum()))
    score = np.full(len(y), base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, threshold, leaf = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (y - p), weight * p * (1 - p)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            start, width = 2**level - 1, 2**level
            node = at - start
            best = np.full(width, 1e-6)
            gs_all, hs_all = np.bincount(node, g, width), np.bincount(node, h, width)
            for k, cut in enumerate(cuts):
                if not len(cut):
                    continue
                b = len(cut) + 1
                key = node * b + code[:, k]
                gs, hs = (np.bincount(key, v, width * b).reshape(width, b).cumsum(1)[:, :-1] for v in (g, h))
                gain = gs**2 / (hs + 1) + (gs_all[:, None] - gs) ** 2 / (hs_all[:, None] - hs + 1) - (gs_all**2 / (hs_all + 1))[:, None]
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best = np.where(better, gain[np.arange(width), top], best)
                feature[r, start : start + width] = np.where(better, k, feature[r, start : start + width])
                threshold[r, start : start + width] = np.where(better, cut[top], threshold[r, start : start + width])
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[r, at]] > threshold[r, at])
        last = at - inner
        leaf[r] = rate * np.bincount(last, g, leaves) / (np.bincount(last, h, leaves) + 1)
        score += leaf[r, last]
    return Trees(feature, threshold, leaf, base)


#: What it costs to split a subtree, in log-likelihood of its text.
SPLIT = 1.5


def decode(parent: list[int], own: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each block's own text is kept: the likeliest choice in which a subtree is kept whole, dropped whole or split at a price."""
    n = len(parent)
    p = np.clip(p, 1e-4, 1 - 1e-4)
    weight = np.where(own > 0, 1 + np.log1p(own), 0.2)
    keep, drop = weight * np.log(p), weight * np.log(1 - p)
    all_keep, all_drop = keep.copy(), drop.copy()
    mixed = np.maximum(keep, drop) - SPLIT
    for i in range(n - 1, 0, -1):
        q = parent[i]
        all_keep[q] += all_keep[i]
        all_drop[q] += all_drop[i]
        mixed[q] += max(all_keep[i], all_drop[i], mixed[i])
    state = np.zeros(n, np.int8)  # 0 dropped, 1 kept, 2 split
    for i in range(n):
        above = state[parent[i]] if i else 2
        state[i] = above if above != 2 else int(np.argmax([all_drop[i], all_keep[i], mixed[i]]))
    return np.where(state == 2, keep > drop, state == 1)


#: Attribute tokens and kinds of element that say that something isn't the article.
_CHROME_FLAGS = sum(1 << k for k, name in enumerate(TOKENS) if name != "article") | 1 << N_TOKENS
_CHROME_KINDS = {_OF_TAG[k] for k in ("header", "footer", "nav", "aside", "form", "control")}


_ASIDE_KINDS = {_OF_TAG[k] for k in ("footer", "nav", "aside")}


def _below(t: Tree, marked: list[bool]) -> np.ndarray:
    """The blocks that are marked or lie below one that is."""
    out = np.zeros(len(marked), bool)
    for i, up in enumerate(t.parent):
        out[i] = marked[i] or (up >= 0 and out[up])
    return out


def choose(t: Tree, own: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether each block's own text is kept.

    A page of which nothing would be, keeps the text that no markup marks as something else and that isn't mostly links. A page
    without an article element of which only footers, menus or links would be kept has no article.
    """
    link = np.zeros(len(own))
    np.add.at(link, np.array(t.text_block, np.int64), [len(x.strip()) * y for x, y in zip(t.text, t.text_link, strict=True)])
    kept = decode(t.parent, own, p)
    if not (kept & (own > 0)).any():
        marked = [bool(f & _CHROME_FLAGS) or k in _CHROME_KINDS for f, k in zip(t.flags, t.kind, strict=True)]
        kept = ~_below(t, marked) & (2 * link <= own)
    if not {0, 1} & set(t.kind):
        aside = _below(t, [k in _ASIDE_KINDS for k in t.kind])
        told = np.where(kept & ~aside, own - link, 0).sum()
        if 10 * told < np.where(kept, own, 0).sum():
            kept = np.zeros(len(own), bool)
    return kept


def read_page(page: str | None, trees: Trees) -> str:
    """The main text of one page."""
    return next(read_pages([page], trees))


def read_pages(pages: list[str | None], trees: Trees) -> Iterator[str]:
    """The main texts of pages, with one call of the trees for all of them."""
    parsed = [parse(p) if p else None for p in pages]
    made = [features(t) if t is not None and t.text else None for t in parsed]
    some = [m[0] for m in made if m is not None]
    every = trees.probability(np.concatenate(some)) if some else np.zeros(0)
    at = 0
    for t, m in zip(parsed, made, strict=True):
        if t is None or m is None:
            yield ""
            continue
        x, own = m
        kept = choose(t, own, every[at : at + len(x)])
        at += len(x)
        out: list[str] = []
        for text, block, begins in zip(t.text, t.text_block, t.text_begins, strict=True):
            if kept[block]:
                if begins and out:
                    out.append(" ")
                out.append(text)
        yield " ".join("".join(out).split())


@lru_cache(maxsize=1)
def trained() -> Trees:
    """The trees, from the generator's pages; the same on every call."""
    from ledgerline.llm.page_sample import layout_pages, sample_pages

    xs, ys, ws = [], [], []
    for page, wanted in chain(sample_pages(), layout_pages()):
        t = parse(page)
        x, own = features(t)
        marked = np.zeros(len(own))
        seen = np.zeros(len(own))
        np.add.at(seen, np.array(t.text_block), [float(len(s.strip())) for s in t.text])
        np.add.at(marked, np.array(t.text_block), [float(len(s.strip())) * (wanted in s) for s in t.text])
        # A block is of the article if most text of its subtree is.
        for i in range(len(own) - 1, 0, -1):
            seen[t.parent[i]] += seen[i]
            marked[t.parent[i]] += marked[i]
        full = seen > 0
        xs.append(x[full])
        ys.append((marked[full] > 0.5 * seen[full]).astype(float))
        ws.append(np.where(own[full] > 0, 1.0, 0.3))
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html)."""
    trees = pages.sparkSession.sparkContext.broadcast(trained())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                texts = list(read_pages(part.column(2).to_pylist(), trees.value))
                sizes = pa.array([len(x) for x in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(read, "page_id long, url string, text string, n_chars long")
