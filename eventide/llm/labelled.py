"""Labelled pages to train the extractor on: layouts drawn from a seed, with ``data-label="main"`` on what is main text.

The pages vary in what marks the article (an element, a class or id, nothing but its place), in what stands around and
inside it, and in the lengths of all texts, so that no single sign is always right. In bare pages all elements are plain
divisions without telling names, where only the texts themselves tell.
"""

from __future__ import annotations

import random
import re

#: Names that sites give to the parts of a page.
MAIN = ("article", "main", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "section.story", "div#main", "td.text", "div.text")
HEADERS = ("header", "div.header", "div#masthead", "div.site-header", "div.top-bar", "div.banner")
MENUS = ("nav", "div.menu", "ul.nav", "div#navigation", "div.breadcrumbs", "nav.navbar", "ul.pagination", "div.tags")
FOOTERS = ("footer", "div.footer", "div#footer", "div.site-footer", "div.copyright", "div.legal")
SIDES = ("aside", "div.sidebar", "div#sidebar", "aside.related", "div.widget", "div.related-posts", "div.recommended", "div.popular")
ADVERTS = ("div.ad", "div.ads", "div.advert", "div.advertisement", "aside.promo", "div.sponsored", "div#ad-top", "section.banner-ad")
NOTICES = ("div.cookie-notice", "div.notice", "div#cookie-banner", "div.consent", "div.alert", "div.popup", "div.newsletter", "div.paywall", "div.share", "div.social")
FORMS = ("form", "form.search", "form#login", "form.subscribe", "div.search-form")
COMMENTS = ("div.comments", "section#comments", "ol.comment-list", "div.comment", "section.responses", "div.replies", "div#disqus-thread")
FRAMES = ("div", "div.wrapper", "div.container", "div#page", "div.row", "section", "div.col", "table")
TELLING = "address article aside blockquote footer h1 h2 header li main nav p section ul ol".split()
LETTERS = "aeiouaeiouaeiourstlnmdkpbgvhfzäéñ"


class Pages:
    def __init__(self, seed: int):
        self.random = random.Random(seed)

    def word(self) -> str:
        return "".join(self.random.choice(LETTERS) for _ in range(self.random.randint(1, 9)))

    def words(self, low: int, high: int) -> str:
        r = self.random
        n = r.randint(low, r.choice((low, (low + high) // 2, high)))
        out = [self.word() for _ in range(n)]
        for i in range(n):
            if r.random() < 0.1:
                out[i] += r.choice(".,;!?")
        if r.random() < 0.7:
            out[-1] += "."
        out[0] = out[0].capitalize()
        if r.random() < 0.1:
            out.insert(r.randrange(n), r.choice(("&amp;", "&lt;", "&copy;", "&nbsp;", "&#8212;")))
        return " ".join(out)

    def inline(self, text: str) -> str:
        mark = self.random.choice(("b", "i", "em", "strong", "span", 'a href="/x"'))
        return f"<{mark}>{text}</{mark.split()[0]}>" if self.random.random() < 0.15 else text

    def element(self, kind: str, inside: str, main: bool = False) -> str:
        tag, sign, name = (kind.partition(".") if "." in kind else kind.partition("#"))
        attr = f' {"class" if sign == "." else "id"}="{name}"' if sign else ""
        mark = ' data-label="main"' if main else ""
        return {"table": f"<table{attr}{mark}><tr><td>{inside}</td></tr></table>", "td": f"<table><tr><td{attr}{mark}>{inside}</td></tr></table>"}.get(tag, f"<{tag}{attr}{mark}>{inside}</{tag}>")

    def links(self, kind: str) -> str:
        n = self.random.randint(1, 9)
        if self.random.random() < 0.2:
            return self.element(kind, " ".join(f'<a href="/{i}">{self.words(1, 3)}</a>' for i in range(n)))
        items = "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(n))
        return self.element(kind, items if kind.startswith(("ul", "ol")) else f"<ul>{items}</ul>")

    def prose(self, kind: str, longest: int = 40) -> str:
        r = self.random
        text = "".join(f"<p>{self.inline(self.words(1, longest))}</p>" if r.random() < 0.6 else f"<div>{self.words(1, longest)}</div>" for _ in range(r.randint(1, 3)))
        return self.element(kind, text if r.random() < 0.6 else self.inline(self.words(1, longest)))

    def aside(self, inside_article: bool = False) -> str:
        r = self.random
        part = r.choice(("advert", "notice", "menu", "form") if inside_article else ("side", "advert", "notice", "menu", "form", "header"))
        if part == "menu":
            return self.links(r.choice(MENUS))
        if part == "form":
            return self.element(r.choice(FORMS), f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>")
        if part == "side":
            return self.links(r.choice(SIDES)) if r.random() < 0.5 else self.prose(r.choice(SIDES))
        return self.prose(r.choice({"advert": ADVERTS, "notice": NOTICES, "header": HEADERS}[part]))

    def article(self) -> str:
        r, out = self.random, []
        if r.random() < 0.8:
            out.append(f"<h1>{self.words(1, 12)}</h1>")
        for _ in range(r.randint(1, 14)):
            x = r.random()
            if x < 0.76:
                out.append(f"<p>{self.inline(self.words(1, r.choice((2, 8, 40, 90))))}" + ("</p>" if r.random() < 0.85 else ""))
            elif x < 0.82:
                out.append(f"<h2>{self.words(1, 6)}</h2>")
            elif x < 0.87:
                out.append(f"<ul><li>{self.words(1, 12)}</li><li>{self.words(1, 12)}</li></ul>")
            elif x < 0.90:
                out.append(f"<blockquote>{self.words(3, 30)}</blockquote>")
            elif x < 0.93:
                out.append(f"<table><tr><td>{self.words(1, 3)}</td><td>{self.words(1, 3)}</td></tr></table>")
            elif x < 0.95:
                out.append(f"<pre>{self.words(2, 20)}</pre>")
            else:
                out.append(f'</{"span"}>{self.words(2, 30)}<br>{self.words(1, 20)}')
        return "".join(x if not x.startswith("</span>") else f"<div>{x[7:]}</div>" for x in out)

    def bare(self, page: str) -> str:
        """``page`` with divisions for elements, and names that tell nothing or none at all."""
        page = re.sub(rf"<(/?)(?:{'|'.join(TELLING)})(?=[\s>])", r"<\1div", page)
        named = self.random.random() < 0.5
        name = lambda m: f' {m[1]}="{self.random.choice("bcdfgkqxz")}{self.random.randint(1, 99)}"' if named else ""
        return re.sub(r' (class|id)="[^"]*"', name, page)

    def page(self) -> str:
        r = self.random
        before = [self.prose(r.choice(HEADERS), 8) if r.random() < 0.5 else ""] + [self.links(r.choice(MENUS)) for _ in range(r.randint(0, 2))] + [self.aside() for _ in range(r.randint(0, 2))]
        if r.random() < 0.08:
            before.insert(0, f"<noscript><div>{self.words(3, 14)}</div></noscript>")
        kind, body = r.choice(MAIN), self.article()
        parts = [self.element(kind, body, main=True)]
        if r.random() < 0.3:  # something else inside the article's own element
            cut = body.rfind("<p>") if r.random() < 0.5 else len(body)
            own = [self.element("div", body[: max(cut, 0)], True), self.aside(True), self.element("div", body[max(cut, 0) :], True)]
            parts = [self.element(kind, "".join(own))]
        if r.random() < 0.04:
            parts = []
        if r.random() < 0.4:
            said = [self.prose(r.choice(COMMENTS)) for _ in range(r.randint(1, 3))]
            parts.append("".join(said) if r.random() < 0.5 else self.element(r.choice(COMMENTS), "".join(said)))
        after = [self.aside() for _ in range(r.randint(0, 2))] + [self.prose(r.choice(FOOTERS), 15) if r.random() < 0.5 else self.element(r.choice(FOOTERS), f"&copy; {self.words(1, 9)}")] * (r.random() < 0.8)
        middle = "".join(parts)
        if r.random() < 0.4:
            middle = self.element(r.choice(FRAMES), middle)
        inside = "".join(before) + middle + "".join(after)
        if r.random() < 0.4:
            inside = self.element(r.choice(FRAMES), inside)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style></head><body>{inside}</body></html>"


def labelled_pages(n: int = 600, seed: int = 6) -> list[str]:
    pages = Pages(seed)
    return [pages.page() for _ in range(n)]


def bare_pages(n: int = 80, seed: int = 7) -> list[str]:
    pages = Pages(seed)
    return [pages.bare(pages.page()) for _ in range(n)]
