"""Labelled web pages to train on: layouts drawn at random, content elements marked with data-gold."""

from __future__ import annotations

import html
import random

SYLLABLES = ("an", "ber", "ca", "de", "el", "fi", "go", "hu", "in", "ka", "lo", "mer", "no", "or", "pa", "qui", "ré", "sol", "tu", "ver")
SOCIAL = ("Share", "Tweet", "Follow us", "Like", "Email")
MENU = ("Home", "News", "About", "Contact", "Sports", "Archive", "Login", "Shop", "Blog", "Help")


# Names that pages give to wrappers and articles and that say nothing about them.
MISLEADING = (
    "has-top-banner", "comments-open", "tag-news", "alert-weather", "no-sidebar", "with-ads", "menu-closed", "post-footer-meta",
    "form-page", "share-enabled", "related-topic", "search-results-off", "has-cookie-bar", "sticky-header", "popular-post",
)
COMMENT_HEADS = ("Comments", "3 comments", "2 Kommentare", "Kommentare", "12 commentaires", "5 comentarios", "1 reply", "Discussion", "Responses (4)")


class PageMaker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice((1, 1, 2, 2, 3))))

    def sentence(self, style: str) -> str:
        words = [self.word() for _ in range(self.r.choice((1, 3, 6, 9, 14, 20)))]
        if style == "symbols":
            words = [w + self.r.choice(("%%%", "***", "###", "&&&")) for w in words]
        text = " ".join(words).capitalize() + self.r.choice("...!?")
        return text.upper() if style == "caps" else text

    def text(self, style="plain", low=1, high=8) -> str:
        return html.escape(" ".join(self.sentence(style) for _ in range(self.r.randint(low, high))))

    def named(self, *names: str, chance=0.85) -> str:
        if self.r.random() > chance:
            return ""
        name = self.r.choice(names)
        name = self.r.choice((name, name, f"site-{name}", f"{name}-inner", f"page_{name}", f"{name}Box", f"{name} wide", f"l-{name}"))
        return f' {self.r.choice(("class", "class", "id"))}="{name}"'

    def links(self, n, wrap="li") -> str:
        one = lambda: f'<a href="/{self.word()}">{self.r.choice((*MENU, self.word(), self.word() + " " + self.word()))}</a>'
        return "".join(f"<{wrap}>{one()}</{wrap}>" for _ in range(n)) if wrap else " | ".join(one() for _ in range(n))

    def menu(self) -> str:
        tag = self.r.choice(("nav", "nav", "div", "ul"))
        inner = self.links(self.r.randint(2, 9)) if tag == "ul" or self.r.random() < 0.7 else self.links(4, None)
        return f"<{tag}{self.named('nav', 'menu', 'navbar', 'breadcrumbs', chance=0.9 if tag != 'nav' else 0.3)}>" + (
            inner if tag == "ul" else f"<ul>{inner}</ul>" if "<li>" in inner else inner
        ) + f"</{tag}>"

    def header(self) -> str:
        tag = self.r.choice(("header", "div"))
        title = self.r.choice(("", f"<h1>{self.word()} {self.word()}</h1>", f"<div>{self.word()}</div>", f"<p>{self.text(high=1)}</p>"))
        return f"<{tag}{self.named('header', 'masthead', 'banner', 'top', chance=0.95 if tag == 'div' else 0.3)}>{title}{self.menu() if self.r.random() < 0.5 else ''}</{tag}>"

    def footer(self) -> str:
        tag = self.r.choice(("footer", "footer", "div"))
        line = self.r.choice(("&copy; ", "Copyright ", "&copy; 2020 ", "")) + self.word() + self.r.choice((".com", "", " &middot; ")) + self.text(high=2)
        line = self.r.choice((line, f"<p>{line}</p>", f"<ul>{self.links(4)}</ul><p>{line}</p>"))
        return f"<{tag}{self.named('footer', 'copyright', 'colophon', 'bottom', chance=0.95 if tag == 'div' else 0.2)}>{line}</{tag}>"

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "aside", "section"))
        inner = self.r.choice((self.text(high=2), f"<p>{self.text(high=2)}</p>", f'<a href="#">{self.text(high=1)}</a>'))
        return f"<{tag}{self.named('ad', 'ads', 'advert', 'sponsored', 'promo', 'banner', chance=1)}>{inner}</{tag}>"

    def notice(self) -> str:
        tag = self.r.choice(("div", "section", "aside", "dialog"))
        say = self.r.choice(("We use cookies. ", "This site uses cookies. ", "Subscribe to our newsletter. ", "", ""))
        inner = self.r.choice((f"<p>{say}{self.text(high=2)}</p>", say + self.text(high=2), f"<h3>{say}</h3><p>{self.text(high=2)}</p>"))
        return f"<{tag}{self.named('cookie', 'consent', 'notice', 'popup', 'newsletter', 'alert', chance=1)}>{inner}<button>OK</button></{tag}>"

    def form(self) -> str:
        inner = f"<label>{self.word()}</label><input><p>{self.text(high=1)}</p><button>Go</button>"
        return f"<form{self.named('search', 'login', 'form', 'newsletter', chance=0.6)}>{inner}</form>"

    def sidebar(self) -> str:
        tag = self.r.choice(("aside", "aside", "div", "section"))
        part = lambda: self.r.choice((
            f"<h3>{self.r.choice(('Related', 'Popular', 'More', self.word()))}</h3><ul>{self.links(5)}</ul>",
            f"<p>{self.text(high=3)}</p>", f"<h4>{self.word()}</h4><p>{self.text(high=2)}</p>", self.text(high=2),
        ))
        inner = "".join(part() for _ in range(self.r.randint(1, 3)))
        names = self.named("sidebar", "related", "widget", "rail", "popular", "side", "secondary", "latest", chance=0.97 if tag != "aside" else 0.4)
        return f"<{tag}{names}>{inner}</{tag}>"

    def misleading(self, chance: float) -> str:
        if self.r.random() > chance:
            return ""
        good = self.r.choice(("", "post ", "entry ", "page ", "content ", ""))
        return f' class="{good}{" ".join(self.r.sample(MISLEADING, self.r.randint(1, 2)))}"'

    def unnamed_comments(self) -> str:
        """Comments that only their heading tells."""
        head = self.r.choice(("h2", "h3", "h4", "div"))
        item = self.r.choice((
            lambda: f"<p><b>{self.word().capitalize()}</b></p><p>{self.text(high=4)}</p>",
            lambda: f"<div><b>{self.word().capitalize()}</b><p>{self.text(high=3)}</p></div>",
            lambda: f"<div><div>{self.word().capitalize()}, {self.r.randint(1, 28)}.{self.r.randint(1, 12)}.</div><p>{self.text(high=5)}</p></div>",
            lambda: f"<ul><li>{self.word()}: {self.text(high=3)}</li></ul>",
        ))
        inner = f"<{head}>{self.r.choice(COMMENT_HEADS)}</{head}>" + "".join(item() for _ in range(self.r.randint(1, 5)))
        tag = self.r.choice(("div", "div", "section", ""))
        return f"<{tag}>{inner}</{tag}>" if tag else inner

    def comments(self) -> str:
        if self.r.random() < 0.3:
            return self.unnamed_comments()
        tag = self.r.choice(("section", "div", "div", "ol"))
        item = lambda: self.r.choice((
            f"<p>{self.text(high=4)}</p>", f"<div{self.named('comment', 'reply')}><b>{self.word()}</b><p>{self.text(high=4)}</p></div>",
            f"<article{self.named('comment', chance=0.9)}><p>{self.text(high=4)}</p></article>", f"<div{self.named('comment')}>{self.text(high=3)}</div>",
        ))
        items = [item() for _ in range(self.r.randint(1, 5))]
        inner = "".join(f"<li>{x}</li>" for x in items) if tag == "ol" else self.r.choice(("", "<h3>Comments</h3>", "<h2>3 comments</h2>")) + "".join(items)
        return f"<{tag}{self.named('comments', 'discussion', 'responses', 'commentlist', chance=1)}>{inner}</{tag}>"

    def share(self) -> str:
        return f"<div{self.named('share', 'social', chance=1)}>" + " ".join(f'<a href="#">{self.r.choice(SOCIAL)}</a>' for _ in range(3)) + "</div>"

    def content(self) -> str:
        g, style = ' data-gold="1"', self.r.choice(("plain", "plain", "plain", "symbols", "caps"))
        close = self.r.random() < 0.8
        p = lambda: self.r.choice((
            f"<p{g}>{self.text(style)}" + ("</p>" if close else ""), f"<p{g}><b>{self.text(style, high=2)}</b>" + ("</p>" if close else ""),
            f"<p{g}><b>{self.text(style, high=2)}<br>", f'<p{g}>{self.text(style)} <a href="/x">{self.word()}</a> {self.text(style)}</p>',
            f"<p{g}>{self.word().capitalize()}.</p>",
        ))
        other = lambda: self.r.choice((
            f"<h2{g}>{self.text(style, high=1)}</h2>", f"<ul{g}>" + "".join(f"<li{g}>{self.text(style, high=2)}</li>" for _ in range(4)) + "</ul>",
            f"<blockquote{g}>{self.text(style)}</blockquote>", f"<blockquote{g}><p{g}>{self.text(style)}</p></blockquote>",
            f"<pre{g}>{self.text(style)}</pre>", f"<div{g}>{self.text(style)}</div>",
            f"<ul{g}>" + "".join(f'<li{g}><a href="/{self.word()}">{self.text(style, high=1)}</a></li>' for _ in range(self.r.randint(3, 12))) + "</ul>",
            f"<table{g}><tr{g}><td{g}>{self.word()}</td><td{g}>{self.text(style, high=1)}</td></tr></table>",
            f"<figure{g}><figcaption{g}>{self.text(style, high=1)}</figcaption></figure>", f"<section{g}><h3{g}>{self.word()}</h3><p{g}>{self.text(style)}</p></section>",
        ))
        parts = [p() if self.r.random() < 0.8 else other() for _ in range(self.r.choice((0, 1, 2, 4, 8, 14)))]
        head = f"<h1{g}>{self.text(style, high=1)[:60]}</h1>"
        if self.r.random() < 0.15:
            head = f"<header{g}>{head}</header>"
        if self.r.random() < 0.85 or not parts:
            parts.insert(0, head)
        for extra, chance in ((self.advert, 0.2), (self.share, 0.12), (self.sidebar, 0.2), (self.comments, 0.1), (self.notice, 0.06), (self.form, 0.06), (self.menu, 0.05)):
            if self.r.random() < chance:
                parts.insert(self.r.randint(min(1, len(parts)), len(parts)), extra())
        tag = self.r.choice(("article", "article", "main", "div", "div", "section", "td"))
        names = self.named("article", "content", "post", "entry", "story", "text", "main", chance=0.75 if tag in ("div", "section", "td") else 0.3)
        names = self.misleading(0.2) or names
        made = f"<{tag}{names}{g}>{''.join(parts)}" + (f"</{tag}>" if self.r.random() < 0.95 else "")
        if tag == "td":
            return f"<table><tr><td>{self.links(4, None)}</td>{made}</tr></table>"
        if self.r.random() < 0.35:
            if self.r.random() < 0.4:  # other parts beside the article, in one wrapper with it
                made += "".join(x() for x in self.r.sample((self.comments, self.sidebar, self.share, self.advert, self.form), 2))
            made = f"<main{g}>{made}</main>" if tag != "main" and self.r.random() < 0.5 else f"<div{self.named('wrapper', 'container', 'content', 'row')}{g}>{made}</div>"
        return made

    def page(self) -> str:
        r = self.r
        before = [x() for x, chance in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.form, 0.2), (self.advert, 0.5), (self.sidebar, 0.2)) if r.random() < chance]
        after = [x() for x, chance in ((self.share, 0.2), (self.advert, 0.2), (self.comments, 0.35), (self.sidebar, 0.4), (self.form, 0.15), (self.menu, 0.1)) if r.random() < chance]
        if r.random() < 0.3:
            r.shuffle(after)
        foot = [x() for x, chance in ((self.footer, 0.9), (self.notice, 0.2)) if r.random() < chance]
        made = self.content()
        if r.random() < 0.15:
            made = f"<div{self.misleading(0.6)}>{made}</div>"
        middle = "".join(before) + made + "".join(after)
        if r.random() < 0.3:
            middle = f"<div{self.named('wrapper', 'page', 'container', 'site')}>{middle}</div>"
        everything = middle + "".join(foot)
        if r.random() < 0.12:
            everything = f"<form{self.named('aspnetForm', 'form', 'mainForm', 'Form1', chance=0.8)} method=post>{everything}</form>"
        head = f"<head><title>{self.text(high=1)}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head>"
        end = r.choice(("</body></html>", "", "</html>"))
        return f"<!DOCTYPE html><html>{head}<body{self.misleading(0.3)}>{everything}{end}"


def labelled_pages(count: int, seed: int = 11) -> list[str]:
    return [PageMaker(seed * 1_000_003 + i).page() for i in range(count)]
