"""Made pages with known main text, to train the extractor on: many layouts, no real site."""

from __future__ import annotations

import random

SYLLABLES = ("an", "er", "on", "the", "in", "re", "st", "ou", "ti", "ly", "ment", "ver", "sch", "que", "ción", "ü", "é", "al", "is", "or")
CONTENT_NAMES = ("content", "article-body", "post", "entry-content", "story", "main-content", "text", "article", "post-body", "page-content", "")
NAMES = {
    "nav": ("nav", "menu", "main-menu", "navbar", "breadcrumb", "breadcrumbs", "topnav", "pagination", "toc", ""),
    "header": ("header", "masthead", "site-header", "top-bar", "branding", "logo", ""),
    "footer": ("footer", "site-footer", "copyright", "colophon", "legal", "bottom", ""),
    "aside": ("sidebar", "side", "widget", "related", "related-posts", "recommended", "most-read", "trending", "right-rail", "tags", ""),
    "ad": ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo", "ad-slot", "sponsor"),
    "notice": ("cookie-notice", "consent", "gdpr", "notice", "alert", "cookie-banner", "popup", "modal", "overlay", "disclaimer"),
    "comments": ("comments", "comment-list", "comment", "disqus", "replies", "discussion", "responses", "reader-comments"),
    "form": ("newsletter", "subscribe", "search-form", "login", "signup", "contact-form", "search", "form", ""),
    "share": ("share", "social", "share-buttons", "social-links", "byline-share", "follow-us"),
}
KEEP, DROP = "data-q='1'", "data-q='0'"


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, n: int) -> str:
        out = [self.word() + self.r.choice(("", "", "", "", "", ",", ".")) for _ in range(n)]
        return " ".join(out).capitalize() + "."

    def attrs(self, kind: str, mark: str, sure: bool = False) -> str:
        names = [n for n in NAMES.get(kind, CONTENT_NAMES) if n or not sure]
        name = self.r.choice(names)
        if not name or (not sure and self.r.random() < 0.25):
            return f" {mark}"
        if self.r.random() < 0.3:
            name += self.r.choice((" clearfix", " box", " col-8", "-wrap", "-inner", " block-12"))
        return f' {self.r.choice(("class", "class", "class", "id"))}="{name}" {mark}'

    def links(self, n: int) -> str:
        item = lambda: f'<a href="/{self.word()}">{self.words(self.r.randint(1, 3))[:-1]}</a>'
        if self.r.random() < 0.7:
            end = self.r.choice(("</li>", "</li>", ""))
            return "<ul>" + "".join(f"<li>{item()}{end}" for _ in range(n)) + "</ul>"
        return self.r.choice((" | ", " ", "<br>")).join(item() for _ in range(n))

    def boilerplate(self, kind: str) -> str:
        r = self.r
        tags = {"nav": ("nav", "nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "footer", "div"), "aside": ("aside", "div", "section"), "form": ("form", "form", "div"), "comments": ("section", "div", "ol"), "ad": ("div", "div", "aside", "p"), "notice": ("div", "section", "p"), "share": ("div", "ul")}
        tag = r.choice(tags[kind])
        plain = tag in ("div", "p", "section", "ul", "ol")
        inner = {
            "nav": lambda: self.links(r.randint(2, 14)),
            "header": lambda: f"<a href='/'>{self.word()}</a>" + (f"<p>{self.words(r.randint(2, 6))}</p>" if r.random() < 0.4 else "") + (self.links(r.randint(2, 8)) if r.random() < 0.5 else ""),
            "footer": lambda: r.choice((lambda: f"&copy; {self.word()}.example &middot; {self.words(r.randint(2, 30))}", lambda: f"<p>&copy; {r.randint(1999, 2030)} {self.words(r.randint(2, 20))}</p>" + self.links(r.randint(1, 8)), lambda: self.links(r.randint(2, 12))))(),
            "aside": lambda: f"<h3>{self.words(2)}</h3>" + (self.links(r.randint(2, 10)) if r.random() < 0.7 else f"<p>{self.words(r.randint(5, 40))}</p>"),
            "ad": lambda: r.choice((lambda: self.words(r.randint(3, 25)), lambda: f"<a href='//{self.word()}.example'>{self.words(r.randint(3, 15))}</a>", lambda: f"<p>{self.words(r.randint(4, 40))}</p>"))(),
            "notice": lambda: (f"<p>{self.words(r.randint(6, 50))}</p>" if r.random() < 0.6 else self.words(r.randint(6, 50))) + r.choice(("", "<button>OK</button>", "<a href='/privacy'>More</a>")),
            "comments": lambda: f"<h3>{r.randint(1, 99)} {self.word()}</h3>" + "".join(f"<{t} class='{r.choice(('comment', 'reply', 'comment-body', 'c'))}'><b>{self.word()}</b> <p>{self.words(r.randint(3, 60))}</p></{t}>" for t in [r.choice(("div", "li", "article"))] for _ in range(r.randint(1, 6))),
            "form": lambda: f"<label>{self.words(2)}</label><input name='q'><button>{self.word()}</button>" + (f"<p>{self.words(r.randint(4, 20))}</p>" if r.random() < 0.5 else ""),
            "share": lambda: self.links(r.randint(2, 5)),
        }[kind]()
        return f"<{tag}{self.attrs(kind, DROP, sure=plain)}>{inner}</{tag}>"

    def paragraph(self) -> str:
        r = self.r
        text = self.words(r.choice((1, 3, 8, 20, 40, 80, 150)))
        if r.random() < 0.2:
            cut = text.split(" ")
            at = r.randrange(len(cut))
            cut[at] = f'<{t} href="/x">{cut[at]}</{t}>' if (t := r.choice(("a", "em", "b", "span"))) else ""
            text = " ".join(cut)
        return r.choice((lambda: f"<p>{text}</p>", lambda: f"<p>{text}</p>", lambda: f"<p>{text}</p>", lambda: f"<p>{text}", lambda: f"<p><b>{text}<br>", lambda: f"<div>{text}</div>"))()

    def article(self) -> str:
        r = self.r
        parts = [self.paragraph() for _ in range(r.choice((1, 2, 4, 8, 15)))]
        extra = (
            lambda: f"<h2>{self.words(r.randint(2, 7))}</h2>", lambda: "<ul>" + "".join(f"<li>{self.words(r.randint(2, 20))}</li>" for _ in range(r.randint(2, 6))) + "</ul>", lambda: f"<blockquote><p>{self.words(r.randint(5, 40))}</p></blockquote>",
            lambda: "<table>" + "".join(f"<tr><td>{self.word()}</td><td>{r.randint(1, 999)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>", lambda: f"<figure><img src='x.png'><figcaption>{self.words(r.randint(3, 12))}</figcaption></figure>", lambda: f"<pre>{self.words(r.randint(5, 20))}</pre>",
        )
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            parts.insert(r.randint(0, len(parts)), r.choice(extra)())
        for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
            parts.insert(r.randint(0, len(parts)), self.boilerplate(r.choice(("ad", "share", "aside", "form", "ad", "nav"))))
        if r.random() < 0.2:
            parts.append(self.boilerplate("comments"))
        if r.random() < 0.85:
            parts.insert(0, r.choice((f"<h1>{self.words(r.randint(2, 9))}</h1>", f"<header {KEEP}><h1>{self.words(r.randint(2, 9))}</h1></header>")))
        tag = r.choice(("article", "article", "article", "main", "div", "div", "section"))
        return f"<{tag}{self.attrs('content', KEEP, sure=tag != 'article' and r.random() < 0.8)}>" + "".join(parts) + f"</{tag}>"

    def page(self) -> str:
        r = self.r
        before = [self.boilerplate(k) for k in ("notice", "header", "nav", "ad", "aside") if r.random() < 0.5]
        after = [self.boilerplate(k) for k in ("share", "ad", "aside", "comments", "form", "nav", "footer") if r.random() < 0.45]
        body = self.article()
        if r.random() < 0.4:
            side = self.boilerplate("aside")
            tag = r.choice(("div", "div", "main", "section"))
            inner = body + side if r.random() < 0.7 else side + body
            body = f'<{tag} class="{r.choice(("container", "wrapper", "row", "page", "layout", "content-area", "site-main", "main"))}" data-q="2">{inner}</{tag}>'
        everything = "".join(before) + body + "".join(after)
        for _ in range(r.choice((0, 0, 1, 2))):
            everything = f'<div class="{r.choice(("wrapper", "site", "page", "container", "root", "outer"))}" data-q="2">{everything}</div>'
        return f"<!DOCTYPE html><html lang='en'><head><title>{self.word()}</title><style>p{{}}</style></head><body data-q='2'>{everything}</body></html>"
