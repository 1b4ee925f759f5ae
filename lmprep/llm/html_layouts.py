"""Labelled pages of many layouts, made from a seed: what tables of pages with one or two layouts cannot teach.

``data-label`` marks the roots of content and of what is none; everything below a root is like it unless marked again.
"""

from __future__ import annotations

import random

# Usual elements and names of the parts of a page.
CONTENT = [
    ("article", ""), ("article", "post"), ("article", "entry hentry"), ("main", ""), ("main", "main-content"), ("div", "content"),
    ("div", "article-body"), ("div", "post-content"), ("div", "entry-content"), ("div", "story"), ("div", "text"), ("div", ""),
    ("section", "article"), ("section", ""), ("td", "content"), ("td", ""), ("div", "page-content"), ("div", "body-copy"),
]
FRAMES = ["", "wrapper", "container", "page", "site", "layout row", "outer", "main", "columns"]
MENUS = [
    ("nav", ""), ("nav", "main-nav"), ("div", "menu"), ("div", "navbar"), ("ul", "nav"), ("ul", "menu"), ("div", "breadcrumbs"),
    ("div", "navigation"), ("nav", "toc"), ("ul", "pagination"), ("div", "pager"), ("div", "tags"), ("ul", "links"), ("div", ""),
]
HEADERS = [("header", ""), ("header", "site-header"), ("div", "header"), ("div", "masthead"), ("div", "top-bar"), ("div", "logo"), ("div", "branding")]
FOOTERS = [("footer", ""), ("footer", "site-footer"), ("div", "footer"), ("div", "copyright"), ("div", "bottom"), ("div", "legal")]
SIDEBARS = [
    ("aside", ""), ("aside", "sidebar"), ("div", "sidebar"), ("div", "widget"), ("div", "related"), ("section", "recommended"),
    ("div", "side"), ("div", "teaser"), ("section", "more-stories"), ("div", "popular trending"), ("td", "sidebar"),
]
NOTICES = [
    ("div", "cookie-notice"), ("div", "cookie-banner"), ("div", "consent"), ("div", "notice"), ("div", "alert"), ("div", "gdpr popup"),
    ("section", "announcement"), ("div", "modal overlay"), ("div", "warning message"), ("div", "paywall"), ("p", "notice"), ("div", "disclaimer"),
]
ADVERTS = [
    ("div", "ad"), ("div", "ads"), ("div", "advert"), ("div", "advertisement"), ("div", "banner"), ("aside", "sponsored"), ("div", "promo"),
    ("div", "sponsor"), ("section", "promotion"), ("div", "ad-slot"), ("p", "ad"), ("div", "adsbox"), ("ins", "adsense"), ("span", "ad"),
]
FORMS = [("form", ""), ("form", "search"), ("div", "newsletter"), ("div", "subscribe"), ("form", "login"), ("div", "signup"), ("form", "contact"), ("fieldset", "")]
COMMENTS = [
    ("div", "comments"), ("section", "comments"), ("ol", "commentlist"), ("ul", "comment-list"), ("div", "discussion"), ("section", "responses"),
    ("div", "disqus"), ("div", "replies"), ("div", "reader-comments"), ("section", "reviews"), ("aside", "comments"), ("div", "feedback"),
]
SHARES = [("div", "share"), ("div", "social"), ("ul", "share-buttons"), ("div", "author-bio"), ("div", "meta"), ("p", "byline"), ("div", "toolbar")]


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def word(self) -> str:
        return "".join(self.rng.choice(("ba", "ne", "ti", "ro", "su", "la", "en", "or", "st", "é")) for _ in range(self.rng.randint(1, 4)))

    def line(self, least: int = 1, most: int = 6) -> str:
        return " ".join(self.word() for _ in range(self.rng.randint(least, most))).capitalize()

    def prose(self, most: int = 5) -> str:
        return " ".join(self.line(3, 18) + self.rng.choice((".", ".", ".", ", " + self.line(2, 6).lower() + ".", "?")) for _ in range(self.rng.randint(1, most)))

    def maybe(self, chance: float) -> bool:
        return self.rng.random() < chance

    def tag(self, kind: tuple[str, str], inside: str, label: str = "") -> str:
        name, words = kind
        if words and self.maybe(0.1):
            words = words.replace("-", "_")
        mark = f' data-label="{label}"' if label else ""
        own = f' {self.rng.choice(("class", "class", "id"))}="{words}"' if words else ""
        return f"<{name}{own}{mark}>{inside}</{name}>"

    def links(self) -> str:
        items = [f'<a href="/{self.word()}">{self.line(1, 3)}</a>' for _ in range(self.rng.randint(2, 9))]
        if self.maybe(0.6):
            return "<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>"
        return self.rng.choice((" | ", " ", "<br>", "")).join(items)

    def content(self) -> str:
        parts = [f"<h1>{self.line(2, 9)}</h1>"] if self.maybe(0.7) else []
        for _ in range(self.rng.randint(1, 9)):
            kind = self.rng.random()
            if kind < 0.66:
                text = self.prose(60 if self.maybe(0.1) else 5) if self.maybe(0.85) else self.line(1, 5) + "."
                if self.maybe(0.2):
                    text = f"{self.line()} <a href='/x'>{self.line(1, 3)}</a> {text}"
                parts.append(f"<p>{text}</p>" if self.maybe(0.9) else f"<div>{text}</div>")
            elif kind < 0.74:
                parts.append(f"<h2>{self.line(1, 6)}</h2>")
            elif kind < 0.8:
                parts.append("<ul>" + "".join(f"<li>{self.line(2, 9)}.</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.84:
                parts.append(f"<blockquote><p>{self.prose(2)}</p></blockquote>")
            elif kind < 0.87:
                parts.append("<table>" + "".join(f"<tr><td>{self.line()}</td><td>{self.line()}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.9:
                parts.append(f"<figure><img src=x><figcaption>{self.line(3, 9)}.</figcaption></figure>")
            elif kind < 0.92:
                parts.append(f"<section><h3>{self.line()}</h3><p>{self.prose()}</p></section>")
            elif kind < 0.96:
                parts.append(self.advert())
            else:
                parts.append(self.tag(self.rng.choice(SHARES), self.links() if self.maybe(0.6) else self.line(), "none"))
        if self.maybe(0.1):
            parts.append(self.comments())
        return "".join(parts)

    def advert(self) -> str:
        return self.tag(self.rng.choice(ADVERTS), self.line(2, 9) if self.maybe(0.5) else f"<p>{self.prose(3)}</p>", "none")

    def comments(self) -> str:
        kind = self.rng.choice(COMMENTS)
        own = "li" if kind[0] in ("ol", "ul") else self.rng.choice(("div", "article", "p"))
        words = self.rng.choice(("comment", "comment", "reply", "review", ""))
        said = "".join(
            self.tag((own, words), (f"<b>{self.line(1, 2)}</b> " if self.maybe(0.4) else "") + (self.prose() if own == "p" else f"<p>{self.prose(40 if self.maybe(0.05) else 5)}</p>"))
            for _ in range(self.rng.randint(1, 8))
        )
        return self.tag(kind, (f"<h3>{self.line(1, 3)}</h3>" if self.maybe(0.5) else "") + said, "none")

    def aside(self) -> str:
        kind = self.rng.choice(SIDEBARS)
        inside = [f"<h3>{self.line(1, 3)}</h3>"] if self.maybe(0.6) else []
        inside += [self.links() if self.maybe(0.5) else f"<p>{self.prose()}</p>" for _ in range(self.rng.randint(1, 5))]
        return self.tag(kind, "".join(inside), "none")

    def form(self) -> str:
        return self.tag(self.rng.choice(FORMS), f"<label>{self.line()}</label><input name=x><p>{self.line(2, 9)}.</p><button>{self.line(1, 1)}</button>", "none")

    def notice(self) -> str:
        return self.tag(self.rng.choice(NOTICES), self.prose(3) if self.maybe(0.5) else f"<p>{self.prose(4)}</p>", "none")

    def page(self) -> str:
        rng = self.rng
        before, after = [], []
        if self.maybe(0.7):
            before.append(self.tag(rng.choice(HEADERS), self.line() if self.maybe(0.5) else f"<h1>{self.line()}</h1><p>{self.line(2, 8)}</p>", "none"))
        if self.maybe(0.8):
            before.append(self.tag(rng.choice(MENUS), self.links(), "none"))
        for chance, make in ((0.35, self.notice), (0.4, self.advert), (0.2, self.form), (0.25, self.aside)):
            if self.maybe(chance):
                before.append(make())
        for chance, make in ((0.45, self.comments), (0.45, self.aside), (0.25, self.advert), (0.25, self.form), (0.25, self.notice)):
            if self.maybe(chance):
                after.append(make())
        rng.shuffle(before)
        rng.shuffle(after)
        if self.maybe(0.8):
            after.append(self.tag(rng.choice(FOOTERS), f"&copy; {self.line()}" if self.maybe(0.5) else f"<p>{self.prose(2)}</p>" + self.links(), "none"))
        kind = rng.choice(CONTENT)
        middle = self.tag(kind, self.content(), "text")
        if kind[0] == "td":
            middle = f"<table><tr>{middle}{self.tag(('td', rng.choice(('', 'sidebar'))), self.links(), 'none')}</tr></table>"
        elif self.maybe(0.03):  # nothing but the text
            return f'<html><body data-label="text">{self.content()}</body></html>'
        for _ in range(rng.randint(0, 2)):
            split = rng.randint(0, len(before)), rng.randint(0, len(after))
            inner = "".join(before[split[0] :]) + middle + "".join(after[: split[1]])
            before, after = before[: split[0]], after[split[1] :]
            middle = self.tag((rng.choice(("div", "div", "section", "main")), rng.choice(FRAMES)), inner)
        return f"<!DOCTYPE html><html><head><title>{self.line()}</title></head><body>{''.join(before)}{middle}{''.join(after)}</body></html>"


def labelled_pages(count: int, seed: int = 1) -> list[str]:
    return [_Maker(seed * 1_000_003 + i).page() for i in range(count)]
