"""Made-up web pages with known main text, on which the extractor's trees are fitted and tested.

A page is an article of headings, paragraphs, lists, tables and quotations amid menus, headers, footers, sidebars,
notices, adverts, forms and reader comments. Layouts vary in elements, in attribute tokens, in how deep the article lies,
in lengths and in sloppiness of markup; some have no telling attributes at all.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ro su ta ve wi xo ya zen tor lin mar sto pel der ich eau ción über né".split()


class Maker:
    """Pages from a seed. ``page`` gives the source; elements carry their label in ``data-y``."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(low, high)):
            word = "".join(r.choice(_SYLLABLES) for _ in range(r.choice((1, 1, 2, 2, 3))))
            out.append(word + r.choice(("",) * 9 + (",", ".")))
        text = " ".join(out)
        return text[:1].upper() + text[1:]

    def sentence_text(self, low: int, high: int) -> str:
        return self.words(low, high).rstrip(",.") + self.r.choice(("." * 1, ".", ".", "!", "?", ""))

    def link(self, low: int = 1, high: int = 4) -> str:
        return f'<a href="/{self.r.randint(1, 999)}">{self.words(low, high)}</a>'

    def inline(self, text: str) -> str:
        r, parts = self.r, text.split(" ")
        for _ in range(r.choice((0, 0, 1, 2))):
            k = r.randrange(len(parts))
            tag = r.choice(("b", "i", "em", "strong", "span", "code"))
            parts[k] = r.choice((f"<{tag}>{parts[k]}</{tag}>", f'<a href="#">{parts[k]}</a>', parts[k] + "<br>", f"<{tag}>{parts[k]}"))
        return " ".join(parts)

    def element(self, tag: str, names: str, inside: str, label: str = "") -> str:
        kind = f' class="{names}"' if names and self.r.random() < 0.8 else f' id="{names}"' if names else ""
        mark = f' data-y="{label}"' if label else ""
        return f"<{tag}{kind}{mark}>{inside}</{tag}>"

    def paragraph(self, label: str = "") -> str:
        text = self.inline(self.sentence_text(*self.r.choice(((2, 8), (10, 40), (30, 120), (60, 200)))))
        mark = f' data-y="{label}"' if label else ""
        return f"<p{mark}>{text}" + ("</p>" if self.r.random() < 0.85 else "")

    def piece(self) -> str:
        r = self.r
        kind = r.random()
        if kind < 0.68:
            return self.paragraph()
        if kind < 0.78:
            return f"<h{(n := r.randint(2, 4))}>{self.words(2, 9)}</h{n}>"
        if kind < 0.88:
            tag = r.choice(("ul", "ol"))
            item = lambda: r.choice((self.words(2, 25), self.words(2, 25), self.link(2, 6)))
            return f"<{tag}>" + "".join(f"<li>{item()}" + r.choice(("</li>", "</li>", "")) for _ in range(r.randint(2, 7))) + f"</{tag}>"
        if kind < 0.93:
            return f"<blockquote>{r.choice((self.paragraph(), self.words(5, 40)))}</blockquote>"
        if kind < 0.97:
            rows = "".join("<tr>" + "".join(f"<td>{self.words(1, 4)}</td>" for _ in range(3)) + "</tr>" for _ in range(r.randint(1, 5)))
            return f"<table>{rows}</table>"
        return f"<figure><img src='x.png'><figcaption>{self.words(3, 15)}</figcaption></figure>"

    def advert(self) -> str:
        r = self.r
        inside = r.choice((self.sentence_text(2, 25), self.link(2, 8), self.paragraph(), "", f"<span>{self.words(1, 3)}</span> {self.link()}"))
        names = r.choice(("ad", "ads", "ad-slot", "advert", "advertisement", "sponsored", "promo", "promo-box", "banner-ad", "adsense"))
        return self.element(r.choice(("div", "div", "aside", "section")), names, inside, "d")

    def links(self) -> str:
        r = self.r
        n = r.randint(2, 14)
        if r.random() < 0.8:
            return "<ul>" + "".join(f"<li>{self.link()}</li>" for _ in range(n)) + "</ul>"
        return r.choice((" | ", " ", "\n")).join(self.link() for _ in range(n))

    def menu(self) -> str:
        r = self.r
        if r.random() < 0.55:
            return self.element("nav", r.choice(("", "", "menu", "main-nav")), self.links(), "d")
        return self.element("div", r.choice(("menu", "nav", "navbar", "breadcrumbs", "top-menu", "navigation", "")), self.links(), "d")

    def top(self) -> str:
        r = self.r
        inside = r.choice((f"<h1>{self.words(1, 4)}</h1>", f"<div>{self.words(1, 5)}</div>", self.words(1, 8), f"<p>{self.words(2, 12)}</p>"))
        if r.random() < 0.5:
            inside += self.menu()
        if r.random() < 0.55:
            return self.element("header", r.choice(("", "site-header")), inside, "d")
        return self.element("div", r.choice(("header", "masthead", "top", "topbar", "logo", "branding")), inside, "d")

    def bottom(self) -> str:
        r = self.r
        inside = r.choice(("&copy; ", "© ", "", "Copyright ")) + r.choice((self.sentence_text(2, 30), self.links(), f"<p>{self.sentence_text(3, 40)}</p>", f"{self.words(1, 3)} &middot; {self.sentence_text(3, 25)}"))
        if r.random() < 0.6:
            return self.element("footer", r.choice(("", "", "site-footer")), inside, "d")
        return self.element("div", r.choice(("footer", "bottom", "copyright", "colophon", "legal", "")), inside, "d")

    def side(self) -> str:
        r = self.r
        inside = "".join(
            r.choice((f"<h3>{self.words(1, 4)}</h3>{self.links()}", f"<p>{self.sentence_text(3, 40)}</p>", self.links(), f"<div>{self.sentence_text(4, 60)}</div>"))
            for _ in range(r.randint(1, 3))
        )
        if r.random() < 0.5:
            return self.element("aside", r.choice(("", "sidebar", "related")), inside, "d")
        return self.element("div", r.choice(("sidebar", "side", "related-posts", "widget", "recommended", "popular", "more-links")), inside, "d")

    def notice(self) -> str:
        r = self.r
        inside = r.choice((self.sentence_text(4, 50), f"<p>{self.sentence_text(5, 40)}</p>")) + r.choice(("", f"<button>{self.words(1, 2)}</button>", self.link(1, 3)))
        return self.element(r.choice(("div", "div", "section", "aside")), r.choice(("cookie-notice", "cookies", "consent", "gdpr-banner", "notice", "popup", "modal", "alert", "overlay")), inside, "d")

    def form(self) -> str:
        r = self.r
        inside = f"<label>{self.words(1, 5)}</label> <input name='x'>" + r.choice(("", f"<p>{self.sentence_text(3, 30)}</p>")) + f"<button>{self.words(1, 2)}</button>"
        if r.random() < 0.6:
            return self.element("form", r.choice(("", "search", "newsletter")), inside, "d")
        return self.element("div", r.choice(("newsletter", "subscribe", "login", "signup-form", "search-box")), f"<form>{inside}</form>", "d")

    def comments(self) -> str:
        r = self.r
        one = lambda: self.element(r.choice(("div", "li", "article", "p")), r.choice(("comment", "comment-body", "reply", "")), f"<b>{self.words(1, 2)}</b> {self.sentence_text(3, 90)}")
        inside = r.choice((f"<h3>{self.words(1, 3)}</h3>", f"<h2>{self.words(1, 3)}</h2>", "")) + "".join(one() for _ in range(r.randint(1, 8)))
        return self.element(r.choice(("div", "section", "ul", "div")), r.choice(("comments", "comment-list", "disqus", "discussion", "responses comments", "reader-comments")), inside, "d")

    def share(self) -> str:
        return self.element(self.r.choice(("div", "ul")), self.r.choice(("share", "social", "share-buttons", "follow")), " ".join(self.link(1, 2) for _ in range(3)), "d")

    def junk(self) -> str:
        r = self.r
        return r.choice((self.advert, self.links_box, self.side, self.notice, self.form, self.share))()

    def links_box(self) -> str:
        return self.element("div", self.r.choice(("related", "see-also more", "tags")), self.links(), "d")

    def article(self) -> str:
        r = self.r
        pieces = []
        if r.random() < 0.8:
            title = f"<h1>{self.words(2, 14)}</h1>"
            pieces.append(r.choice((title, title, title, f"<header>{title}</header>", f'<div class="title">{title}</div>')))
        for _ in range(r.choice((1, 1, 2, 3, 5, 8, 13, 21))):
            pieces.append(self.piece() if r.random() < 0.93 else self.junk())
        if r.random() < 0.15:
            pieces.append(self.comments())
        inside = r.choice(("", "\n", "\n  ")).join(pieces)
        if r.random() < 0.15:
            inside = r.choice((self.sentence_text(5, 60) + "<br>" + inside, f"<div>{inside}</div>", f"<section>{inside}</section>"))
        if r.random() < 0.6:
            return self.element("article", r.choice(("", "", "post", "story")), inside, "c")
        return self.element(r.choice(("div", "div", "main", "section")), r.choice(("content", "article-body", "post", "entry-content", "story", "main-content", "text", "", "c12")), inside, "c")

    def bare(self) -> str:
        """A page whose text stands in its body, without an element around it: much, little, or plain text alone."""
        r = self.r
        inside = r.choice((
            lambda: "".join(self.piece() for _ in range(r.choice((1, 1, 2, 4, 9)))),
            lambda: f"<h1>{self.words(1, 9)}</h1>" + "".join(self.paragraph() for _ in range(r.choice((1, 2, 5)))),
            lambda: self.sentence_text(2, 60),
            lambda: f"<div>{self.sentence_text(2, 60)}</div>" + self.paragraph(),
        ))()
        before = self.menu() if r.random() < 0.25 else ""
        after = self.bottom() if r.random() < 0.25 else ""
        head = r.choice(("", f"<head><title>{self.words(1, 6)}</title></head>", f"<head><title>{self.words(1, 6)}</title>"))
        return f'<html>{head}<body data-y="c">{before}{inside}{after}'

    def page(self) -> str:
        r = self.r
        if r.random() < 0.12:
            return self.bare()
        before = [f() for f, p in ((self.notice, 0.2), (self.top, 0.5), (self.menu, 0.7), (self.advert, 0.4), (self.side, 0.15), (self.form, 0.1)) if r.random() < p]
        after = [f() for f, p in ((self.share, 0.15), (self.comments, 0.3), (self.side, 0.35), (self.advert, 0.2), (self.form, 0.2), (self.bottom, 0.85), (self.notice, 0.15)) if r.random() < p]
        if r.random() < 0.2:
            r.shuffle(before)
        middle = self.article()
        if r.random() < 0.35:
            wrap = r.choice(("main", "div", "div"))
            first = [before.pop()] if len(before) > 1 and r.random() < 0.5 else []
            last = [after.pop(0)] if len(after) > 1 and r.random() < 0.5 else []
            inner = [*first, middle, *last]
            middle = self.element(wrap, r.choice(("container", "wrapper", "page", "main", "")), "".join(inner))
        gap = r.choice(("", "", "\n", "<!-- x -->", "<script>var s='</div>';</script>"))
        head = f"<head><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style></head>" if r.random() < 0.9 else ""
        return f"<!DOCTYPE html><html lang='x'>{head}<body>{gap.join([*before, middle, *after])}" + ("</body></html>" if r.random() < 0.9 else "")
