"""Labelled pages to train main-text extraction on: layouts drawn from a seeded grammar of page parts.

Each part is written with its label: article parts carry data-main="1" on the element that holds a block, all else is
what surrounds an article on the web. Wordings are pseudo-words, so that a model learns structure, tags, class names and
the shape of text rather than a language; the words of menus and notices are real.
"""

from __future__ import annotations

import random
from collections.abc import Callable

_SYLLABLES = "an ber co de en er ha in ka la lo ma mi na ne o pa ra re sa se ta ti to un ver wi".split()
_MENU = "Home News About Contact Products Services Blog Archive Login Register Search Help Careers Shop Cart Privacy Terms Sitemap Support Start Kontakt Impressum Accueil Inicio".split()


class _Page:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.choice((1, 2, 2, 3))))

    def sentence(self, most: int = 14) -> str:
        w = [self.word() for _ in range(self.r.randint(1, most))]
        return (" ".join(w).capitalize()) + self.r.choice("...!?") if self.r.random() < 0.95 else " ".join(w)

    def prose(self, most: int = 6) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(1, most)))
        if self.r.random() < 0.2:
            text += f' <a href="/{self.word()}">{self.word()}</a> {self.sentence()}'
        if self.r.random() < 0.15:
            text = f"<b>{self.sentence(4)}</b> {text}"
        return text

    def pick(self, *options: str) -> str:
        return self.r.choice(options)

    def repeat(self, make: Callable[[], str], low: int, high: int) -> str:
        return "".join(make() for _ in range(self.r.randint(low, high)))

    def link(self) -> str:
        return f'<a href="/{self.word()}">{self.pick(self.word(), self.r.choice(_MENU), self.word() + " " + self.word())}</a>'

    # What surrounds an article.

    def menu(self) -> str:
        items = self.repeat(lambda: f"<li>{self.link()}</li>", 3, 8)
        return self.pick(f"<nav><ul>{items}</ul></nav>", f'<div class="{self.pick("menu", "nav", "navbar", "main-menu", "navigation", "topnav")}"><ul>{items}</ul></div>', f'<ul id="{self.pick("menu", "nav")}">{items}</ul>', f'<div role="navigation">{self.repeat(self.link, 3, 7)}</div>')

    def header(self) -> str:
        name = f"<h1>{self.word()}</h1>" if self.r.random() < 0.3 else f'<div class="logo">{self.word()} {self.word()}</div>'
        line = f'<p class="tagline">{self.sentence(7)}</p>' if self.r.random() < 0.5 else ""
        return self.pick(f"<header>{name}{line}</header>", f'<div id="header" class="{self.pick("site-header", "masthead", "header", "top")}">{name}{line}</div>', f"<header>{name}{self.menu()}</header>")

    def crumbs(self) -> str:
        return f'<div class="{self.pick("breadcrumb", "breadcrumbs", "crumbs")}">{self.link()} &raquo; {self.link()} &raquo; {self.word()}</div>'

    def notice(self) -> str:
        text = self.pick("We use cookies to improve your experience. By continuing you accept our use of cookies.", "This site uses cookies.", "Please enable JavaScript.", "Wir verwenden Cookies.", "Nous utilisons des cookies.", "Usamos cookies.", self.prose(2), "Subscribe to read more.", "You have 3 free articles left.")
        return f'<div class="{self.pick("cookie-banner", "cookie", "notice", "consent", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "cookie-notice", "banner", "message", "disclaimer")}">{self.pick(text, f"<p>{text}</p>")}{self.pick("", "<button>Accept</button>", "<a href=#>OK</a>")}</div>'

    def advert(self) -> str:
        return f'<{(t := self.pick("div", "div", "aside", "section", "p"))} class="{self.pick("ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner-ad", "sponsor", "adsbox", "promotion")}">{self.pick(self.prose(3), f"<p>{self.prose(2)}</p>", f"<span>Advertisement</span><a href=/x>{self.sentence(6)}</a>", f"Sponsored: {self.sentence()}")}</{t}>'

    def sidebar(self) -> str:
        box = lambda: self.pick(f"<h3>{self.pick('Related', 'Popular', 'Recent posts', 'Most read', 'Tags', self.word())}</h3><ul>{self.repeat(lambda: f'<li>{self.link()}</li>', 2, 6)}</ul>", f"<div class=\"widget\"><h4>{self.word()}</h4><p>{self.prose(3)}</p></div>", f"<p>{self.prose(2)}</p>")
        inner = self.repeat(box, 1, 3)
        return self.pick(f"<aside>{inner}</aside>", f'<div class="{self.pick("sidebar", "side", "widget-area", "related", "rail", "recommended", "teasers")}">{inner}</div>', f'<div id="sidebar">{inner}</div>', f'<section class="related-posts">{inner}</section>')

    def form(self) -> str:
        return f'<form class="{self.pick("search", "newsletter", "signup", "contact", "login")}"><{self.pick("p", "div")}><label>{self.pick("Email", "Name", "Search", self.sentence(6), "Your message")}</label><input name=q>{self.pick("<select><option>" + self.word() + "</option><option>" + self.word() + "</option></select>", "", "<textarea>" + self.word() + "</textarea>")}<button>{self.pick("Send", "Go", "Subscribe", "Submit")}</button><p>{self.pick("We never share your address.", self.prose(2), "")}</p></form>'

    def share(self) -> str:
        return f'<div class="{self.pick("share", "social", "share-buttons", "social-links", "toolbar", "tools")}">{self.repeat(self.link, 2, 4)}</div>'

    def footer(self) -> str:
        text = f"&copy; {self.r.randint(1999, 2026)} {self.word()}.{self.pick('com', 'org', 'example')} {self.pick('', 'All rights reserved.', '&middot; ' + self.prose(2))}"
        inner = self.pick(text, f"<p>{text}</p>", f"<ul>{self.repeat(lambda: f'<li>{self.link()}</li>', 2, 5)}</ul><p>{text}</p>", f"<p>{self.prose(2)}</p><p>{text}</p>")
        return self.pick(f"<footer>{inner}</footer>", f'<div class="{self.pick("footer", "site-footer", "bottom", "copyright", "colophon")}">{inner}</div>', f'<div id="footer">{inner}</div>')

    def comments(self) -> str:
        one = lambda: self.pick(f'<div class="comment"><b>{self.word()}</b><p>{self.prose(3)}</p></div>', f'<li class="comment"><span class="author">{self.word()}</span><p>{self.prose(3)}</p></li>', f"<article class=\"comment\"><p>{self.prose(3)}</p></article>")
        inner = f"<h3>{self.pick('Comments', '3 comments', 'Discussion', 'Leave a reply')}</h3>{self.repeat(one, 1, 5)}"
        return self.pick(f'<section id="comments">{inner}</section>', f'<div class="{self.pick("comments", "comment-list", "responses", "discussion", "replies", "reader-comments")}">{inner}</div>', f'<ol class="commentlist">{inner}</ol>')

    # An article.

    def part(self) -> str:
        kind = self.r.random()
        m = 'data-main="1"'
        if kind < 0.62:
            return f"<p {m}>{self.prose()}" + self.pick("</p>", "</p>", "")
        if kind < 0.72:
            return f"<h{(n := self.pick('2', '3', '4'))} {m}>{self.sentence(8)}</h{n}>"
        if kind < 0.8:
            items = self.repeat(lambda: f"<li {m}>{self.sentence()}{self.pick('</li>', '')}", 2, 5)
            return self.pick(f"<ul>{items}</ul>", f"<ol>{items}</ol>")
        if kind < 0.85:
            return f"<blockquote><p {m}>{self.prose(3)}</p></blockquote>"
        if kind < 0.89:
            return f"<pre {m}>{self.word()} = {self.word()}({self.r.randint(0, 99)})\n{self.word()}</pre>"
        if kind < 0.93:
            return "<table>" + self.repeat(lambda: f"<tr><td {m}>{self.word()}</td><td {m}>{self.r.randint(1, 999)}</td></tr>", 2, 3) + "</table>"
        if kind < 0.96:
            return f"<figure><img src=x><figcaption {m}>{self.sentence()}</figcaption></figure>"
        return f"<p {m}><b>{self.sentence()}<br><p {m}>{self.prose()}</p>"

    def article(self) -> str:
        title = f"<h1 data-main=\"1\">{self.sentence(9)}</h1>" if self.r.random() < 0.85 else ""
        if title and self.r.random() < 0.1:
            title = f"<header>{title}</header>"
        parts = [self.part() for _ in range(self.r.choice((1, 2, 3, 4, 5, 7, 10, 14)))]
        for extra in (self.advert, self.share, self.notice, self.form):
            if self.r.random() < 0.08:
                parts.insert(self.r.randint(0, len(parts)), extra())
        inner = title + "".join(parts)
        if self.r.random() < 0.08:
            inner += self.comments()
        kind = self.r.random()
        if kind < 0.5:
            return f"<article>{inner}</article>"
        if kind < 0.62:
            return f"<main>{inner}</main>"
        if kind < 0.9:
            return f'<div class="{self.pick("content", "post", "entry-content", "article-body", "story", "article", "main", "post-content", "body-text", "text")}">{inner}</div>'
        if kind < 0.95:
            return f'<div id="{self.pick("content", "main", "article")}"><div>{inner}</div></div>'
        return inner

    def html(self) -> str:
        r = self.r
        out = [f"<!DOCTYPE html><html lang=\"{self.pick('en', 'de', 'fr')}\"><head><meta charset=utf-8><title>{self.sentence()}</title><style>p{{margin:0}}</style><script>var a=\"</p>\";</script></head><body>"]
        for make, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.8), (self.crumbs, 0.2), (self.advert, 0.5), (self.form, 0.15), (self.sidebar, 0.2)):
            if r.random() < p:
                out.append(make())
        out.append(self.article())
        for make, p in ((self.share, 0.2), (self.comments, 0.3), (self.advert, 0.25), (self.sidebar, 0.35), (self.form, 0.2), (self.notice, 0.15), (self.footer, 0.85)):
            if r.random() < p:
                out.append(make())
        return "".join(out) + self.pick("</body></html>", "</body></html>", "")


def labelled_pages(n: int, seed: int = 7) -> list[str]:
    return [_Page(seed * 1_000_003 + i).html() for i in range(n)]
