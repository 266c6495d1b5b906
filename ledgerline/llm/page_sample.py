"""Made-up pages with known article text, to train and test extraction. Seeded: the same pages every time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Stands in every text of the article, and in no other text.
MARK = "⁂"

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo zu an en in on un ar er ir or ur".split()


class _Maker:
    def __init__(self, seed: int) -> None:
        self.rng = np.random.default_rng(seed)

    def pick(self, items: list) -> object:
        return items[int(self.rng.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.rng.random() < p)

    def words(self, lo: int, hi: int) -> str:
        n = int(self.rng.integers(lo, hi + 1))
        out = []
        for _ in range(n):
            w = "".join(self.pick(_SYLLABLES) for _ in range(int(self.rng.integers(1, 4))))
            out.append(w + ("," if self.chance(0.06) else "." if self.chance(0.08) else ""))
        return " ".join(out).capitalize()

    def text(self, lo: int, hi: int, inside: bool) -> str:
        mark = MARK if inside else ""
        s = self.words(lo, hi)
        if self.chance(0.25):
            s += f" <{(t := self.pick(['b', 'i', 'em', 'strong', 'span', 'code']))}>{mark}{self.words(1, 4)}</{t}> {mark}{self.words(1, 6)}"
        if self.chance(0.2):
            s += f' <a href="/{self.words(1, 1)}">{mark}{self.words(1, 4)}</a>{mark} {self.words(1, 5)}'
        return mark + s + "."

    def links(self, lo: int, hi: int) -> str:
        items = [f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(int(self.rng.integers(lo, hi + 1)))]
        form = self.pick(["list", "bare", "div"])
        if form == "list":
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if form == "div":
            return "".join(f"<div>{x}</div>" for x in items)
        return " | ".join(items)

    def paragraphs(self, inside: bool, lo: int, hi: int, size: tuple[int, int] = (6, 90)) -> list[str]:
        out = []
        for _ in range(int(self.rng.integers(lo, hi + 1))):
            lo_w = 1 if self.chance(0.15) else size[0]
            out.append(f"<p>{self.text(lo_w, max(lo_w, size[1]), inside)}" + ("</p>" if self.chance(0.9) else ""))
        return out

    def wrapped(self, body: str, tags: list[tuple[str, str]]) -> str:
        tag, names = self.pick(tags)
        name = self.pick(names.split()) if names else ""
        attribute = f' {self.pick(["class", "class", "id"])}="{name}"' if name else ""
        return f"<{tag}{attribute}>{body}</{tag}>"

    # What isn't the article.
    def menu(self) -> str:
        return self.wrapped(self.links(3, 12), [("nav", ""), ("nav", "nav main-nav"), ("div", "nav menu navbar main-menu breadcrumbs pagination"), ("ul", "menu nav")])

    def page_header(self) -> str:
        body = f"<h1>{self.words(1, 4)}</h1>" if self.chance(0.5) else f"<div>{self.words(1, 5)}</div>"
        return self.wrapped(body + (f"<p>{self.words(2, 12)}</p>" if self.chance(0.5) else "") + (self.menu() if self.chance(0.4) else ""), [("header", ""), ("header", "site-header masthead"), ("div", "header masthead page-header site-top branding")])

    def footer(self) -> str:
        body = f"&copy; {self.words(1, 4)} &middot; {self.words(3, 25)}"
        body = body if self.chance(0.5) else f"<p>{body}</p>" + (self.links(2, 6) if self.chance(0.6) else "")
        return self.wrapped(body, [("footer", ""), ("footer", "site-footer footer"), ("div", "footer page-footer copyright legal")])

    def sidebar(self) -> str:
        body = f"<h3>{self.words(1, 3)}</h3>" + (self.links(3, 8) if self.chance(0.6) else "".join(self.paragraphs(False, 1, 3, (4, 40))))
        return self.wrapped(body, [("aside", ""), ("aside", "sidebar"), ("div", "sidebar side-bar widget related related-posts recommended popular-posts tags")])

    def advert(self) -> str:
        body = self.words(4, 40) if self.chance(0.6) else f"<p>{self.words(4, 40)}</p>" + (f'<a href="//x">{self.words(1, 4)}</a>' if self.chance(0.6) else "")
        return self.wrapped(body, [("div", "ad ads advert advertisement ad-box sponsored promo banner-ad"), ("section", "sponsored ad"), ("aside", "ad promo")])

    def notice(self) -> str:
        body = f"<p>{self.words(5, 35)}</p>" if self.chance(0.6) else self.words(5, 35)
        return self.wrapped(body + ("<button>ok</button>" if self.chance(0.5) else ""), [("div", "cookie-notice cookie consent notice gdpr alert popup newsletter subscribe paywall"), ("section", "notice newsletter"), ("dialog", "")])

    def form(self) -> str:
        return f"<form{self.pick(['', ' class=\"search\"', ' id=\"login\"', ' class=\"signup\"'])}><label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>" + (f"<p>{self.words(3, 20)}</p>" if self.chance(0.4) else "") + "</form>"

    def comments(self) -> str:
        items = []
        for _ in range(int(self.rng.integers(1, 7))):
            body = f"<p>{self.text(4, 50, False)}</p>" if self.chance(0.7) else self.text(4, 50, False)
            items.append(self.wrapped((f"<b>{self.words(1, 2)}</b> " if self.chance(0.5) else "") + body, [("div", "comment reply comment-body"), ("li", "comment"), ("article", "comment"), ("div", "")]))
        return self.wrapped(f"<h2>{self.words(1, 3)}</h2>" + "".join(items), [("section", "comments"), ("div", "comments comment-list discussion responses"), ("ol", "commentlist comments"), ("div", "reader-comments")])

    def article(self) -> str:
        parts = [f"<h1>{MARK}{self.words(2, 12)}</h1>"] if self.chance(0.85) else []
        brief = self.chance(0.3)
        for p in self.paragraphs(True, 1, 2, (1, 12)) if brief else self.paragraphs(True, 1, 14):
            parts.append(p)
            if self.chance(0.12):
                parts.append(f"<h2>{MARK}{self.words(1, 7)}</h2>")
            if self.chance(0.07):
                parts.append(f"<blockquote>{self.text(5, 40, True)}</blockquote>")
            if self.chance(0.07):
                parts.append("<ul>" + "".join(f"<li>{self.text(2, 20, True)}</li>" for _ in range(int(self.rng.integers(2, 6)))) + "</ul>")
            if self.chance(0.05):
                parts.append("<table>" + "".join(f"<tr><td>{MARK}{self.words(1, 4)}</td><td>{MARK}{self.words(1, 4)}</td></tr>" for _ in range(int(self.rng.integers(1, 5)))) + "</table>")
            if self.chance(0.04):
                parts.append(f"<pre>{MARK}{self.words(3, 20)}</pre>")
            if self.chance(0.05):
                parts.append(f"<figure><img src=x><figcaption>{self.text(2, 12, True)}</figcaption></figure>")
            if self.chance(0.10):
                parts.append(self.pick([self.advert, self.notice, self.sidebar, self.form])())
        if self.chance(0.1):
            parts = [f"<div>{''.join(parts)}</div>"]
        if self.chance(0.15) and not brief:
            parts.append(self.pick([self.comments, self.sidebar, self.menu, self.advert])())
        return self.wrapped("".join(parts), [("article", ""), ("article", "post entry"), ("main", ""), ("div", "content article post entry-content main-content story-body post-text"), ("section", "content article"), ("div", "")])

    def bare(self) -> str:
        """An article without an element of its own: paragraphs, boxes, lines or one text."""
        form = self.pick(["p", "p", "div", "br", "text", "font"])
        texts = [self.text(*((1, 12) if self.chance(0.2) else (6, 90)), True) for _ in range(1 if self.chance(0.25) else int(self.rng.integers(1, 12)))]
        head = f"<{(h := self.pick(['h1', 'h2', 'div', 'b', 'p']))}>{MARK}{self.words(2, 12)}</{h}>" if self.chance(0.5) else ""
        if form == "text":
            return re.sub(r"<[^>]+>", " ", " ".join(texts))
        if form == "br":
            return head + "<br><br>".join(texts)
        if form == "font":
            return head + "".join(f"<p><font size=2>{x}</font></p>" for x in texts)
        return head + "".join(f"<{form}>{x}</{form}>" for x in texts)

    def layout(self) -> str:
        """A page of any layout: a few without an article, bare ones, tables, boxes without names."""
        kind = self.rng.random()
        if kind < 0.08:
            only = "".join(self.pick([self.menu, self.menu, self.page_header, self.footer, self.form])() for _ in range(int(self.rng.integers(1, 4))))
            return anonymous(self.links(2, 9)) if self.chance(0.4) else f"<html><body>{only}</body></html>"
        if kind < 0.35:
            return self.bare_page()
        if kind < 0.6:
            return self.table_page()
        return anonymous(self.page())

    def bare_page(self) -> str:
        """Little or nothing around an article without an element."""
        before = self.pick([self.menu, self.page_header])() if self.chance(0.25) else ""
        after = self.pick([self.footer, self.menu, self.comments])() if self.chance(0.25) else ""
        body = before + self.bare() + after
        body = anonymous(body) if self.chance(0.6) else body
        return f"<html><body>{body}</body></html>" if self.chance(0.6) else body

    def table_page(self) -> str:
        """A page whose parts are the cells of a table."""
        cell = lambda x, a="": f"<td{a}>{x}</td>"
        middle = [cell(self.bare() if self.chance(0.7) else self.article())]
        if self.chance(0.7):
            middle.insert(0, cell(self.links(3, 10), " width=150"))
        if self.chance(0.4):
            middle.append(cell(self.pick([self.sidebar, self.advert])()))
        rows = [middle]
        if self.chance(0.6):
            rows.insert(0, [cell(f"<h2>{self.words(1, 4)}</h2>" if self.chance(0.5) else self.links(3, 8), " colspan=3")])
        if self.chance(0.6):
            rows.append([cell(f"&copy; {self.words(2, 14)}" + (self.links(2, 5) if self.chance(0.4) else ""), " colspan=3")])
        table = "<table>" + "".join(f"<tr>{''.join(r)}</tr>" for r in rows) + "</table>"
        return f"<html><head><title>{self.words(1, 5)}</title></head><body>{anonymous(table) if self.chance(0.7) else table}</body></html>"

    def page(self) -> str:
        before = [self.pick([self.menu, self.page_header, self.advert, self.notice, self.form, self.sidebar])() for _ in range(int(self.rng.integers(0, 4)))]
        after = [self.pick([self.sidebar, self.advert, self.comments, self.footer, self.form, self.notice, self.menu])() for _ in range(int(self.rng.integers(0, 5)))]
        middle = self.article()
        if self.chance(0.35):
            middle = self.wrapped(("" if self.chance(0.5) else self.sidebar()) + middle + (self.comments() if self.chance(0.3) else ""), [("main", ""), ("div", "wrapper container page main"), ("div", "")])
        body = "".join(before) + middle + "".join(after) + (self.footer() if self.chance(0.6) else "")
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head>" if self.chance(0.8) else ""
        return f"<!DOCTYPE html><html>{head}<body>{body}</body></html>" if self.chance(0.9) else body


def anonymous(page: str) -> str:
    """The page with nothing but boxes and paragraphs: no classes, ids or elements that say what they hold."""
    return re.sub(r"<(/?)(?:nav|header|footer|aside|article|main|section)\b", r"<\1div", re.sub(r' (?:class|id)="[^"]*"', "", page))


def sample_pages(n: int = 1000, seed: int = 3) -> Iterator[tuple[str, str]]:
    """(page, mark): texts that hold the mark are the article's."""
    maker = _Maker(seed)
    for _ in range(n):
        yield maker.page(), MARK


def layout_pages(n: int = 500, seed: int = 4) -> Iterator[tuple[str, str]]:
    """The same of the layouts that sample_pages doesn't make."""
    maker = _Maker(seed)
    for _ in range(n):
        yield maker.layout(), MARK
