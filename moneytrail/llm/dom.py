"""DOM trees of web pages: block elements as nodes, their own text, and features of both."""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

INLINE = frozenset(
    (
        "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i",
        "img", "ins", "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike",
        "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
        # formulas
        "annotation", "annotation-xml", "maction", "math", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts",
        "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts", "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub",
        "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder", "munderover", "none", "semantics",
    )
)
VOID = frozenset(
    ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
)
# Nothing inside these is text of the page.
DROPPED = frozenset(
    (
        "audio", "button", "canvas", "datalist", "head", "iframe", "noscript", "object", "option", "script",
        "select", "style", "svg", "template", "textarea", "title", "video",
    )
)
# These hold no tags: only their own end tag ends them.
RAW = frozenset(("iframe", "script", "style", "textarea", "title"))
HEAD = frozenset(("noscript", "script", "style", "template", "title"))
# An end tag of an inline element around these does not end them.
HOLDS = frozenset(("button", "noscript", "object", "select"))
# Start tags that end an open drawing.
ENDS_SVG = frozenset(
    (
        "article", "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2",
        "h3", "h4", "h5", "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s",
        "small", "span", "strike", "strong", "sub", "sup", "table", "tt", "u", "ul", "var",
    )
)
# Start tags that end a dropped element of these kinds.
ENDS_DROPPED = {
    "button": ("button",), "option": ("option",), "optgroup": ("option",), "select": ("select",), "input": ("select",),
    "textarea": ("select",),
}
# A start tag ends an open element of these kinds, if none of the stops is in between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "body": (("head",), ()),
}
TAGS = (
    "body", "nav", "header", "footer", "aside", "article", "main", "section", "div", "p", "heading", "list", "li", "form",
    "table", "cell", "quote", "figure", "pre", "other",
)
TAG_GROUP = {t: t for t in TAGS} | {
    "html": "body", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading",
    "ul": "list", "ol": "list", "dl": "list", "menu": "list", "dt": "li", "dd": "li", "fieldset": "form", "dialog": "form",
    "tbody": "table", "thead": "table", "tfoot": "table", "tr": "table", "td": "cell", "th": "cell", "blockquote": "quote",
    "figcaption": "figure",
}
# Words in class, id, role and short texts, by what they tell.
CUES = {
    "nav": ("nav", "navigation", "menu", "breadcrumb", "breadcrumbs", "navbar", "topbar", "pagination", "pager", "toc"),
    "header": ("header", "masthead", "banner", "logo", "branding", "top"),
    "footer": ("footer", "copyright", "legal", "colophon", "contentinfo", "bottom", "imprint"),
    "side": (
        "sidebar", "side", "aside", "widget", "related", "recommended", "rail", "complementary", "trending", "popular", "more",
        "secondary", "latest", "tags",
    ),
    "advert": ("ad", "ads", "advert", "advertisement", "adverts", "sponsor", "sponsored", "promo", "promotion", "banner", "adslot"),
    "notice": (
        "cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "overlay",
        "privacy", "warning", "signup",
    ),
    "comment": (
        "comment", "comments", "commentlist", "reply", "replies", "discussion", "disqus", "responses", "respond",
        "kommentar", "kommentare", "antworten", "commentaire", "commentaires", "comentario", "comentarios", "commento", "commenti",
    ),
    "share": ("share", "social", "sharing", "follow", "tweet"),
    "form": ("form", "search", "login", "signin", "register", "contact"),
    "content": ("article", "content", "post", "entry", "story", "main", "body", "text", "prose", "articlebody"),
}
CUE_OF: dict[str, list[str]] = {}
for _kind, _words in CUES.items():
    for _word in _words:
        CUE_OF.setdefault(_word, []).append(_kind)
BOILERPLATE = tuple(k for k in CUES if k != "content")

NAMES = (
    *(f"tag:{t}" for t in TAGS),
    *(f"named:{k}" for k in CUES),
    *(f"says:{k}" for k in BOILERPLATE),
    "bias", "hidden", "copyright",
    *(f"own:{i}" for i in range(5)),
    *(f"below:{i}" for i in range(5)),
    "own links some", "own links most", "below links some", "below links most", "ends like a sentence",
    "first tenth", "last tenth", "text siblings", "content and other names", "no names",
    *(f"share:{i}" for i in range(4)),
    "boilerplate tag, much text", "boilerplate name, much text", "boilerplate tag, most text", "boilerplate name, most text",
    "after comment heading", "begins with comment heading", "list after text",
)
INDEX = {n: i for i, n in enumerate(NAMES)}
EDGES = (
    "any", "child boilerplate tag", "child boilerplate name", "child content", "parent body", "child p", "parent boilerplate tag",
    "parent boilerplate name", "parent content tag", "parent most text", "parent content name", "parent begins with comment heading",
)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    __slots__ = ("tag", "parent", "depth", "named", "hidden", "gold", "own", "linked", "below", "below_linked", "first", "short", "kids")

    def __init__(self, tag, parent, depth, attributes, place):
        self.tag, self.parent, self.depth, self.first = tag, parent, depth, place
        self.own = self.linked = self.below = self.below_linked = self.kids = 0
        self.short = ""
        names, self.hidden, self.gold = [], False, None
        for key, value in attributes:
            if key in ("class", "id", "role", "itemprop") and value:
                names += [w.lower() for w in _SPLIT.findall(value[:300])]
            elif key == "hidden" or key == "aria-hidden" and value == "true":
                self.hidden = True
            elif key == "style" and value and "none" in value and "display" in value:
                self.hidden = True
            elif key == "data-gold":
                self.gold = value == "1"
        self.named = {k for w in names for k in CUE_OF.get(w, ())}


class PageParser(HTMLParser):
    """``nodes`` in page order with the root first, and ``blocks``: (node, text) with white space collapsed."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1, 0, (), 0)]
        self.blocks: list[tuple[int, str]] = []
        # Inline elements carry the node around them, and so do dropped ones with all inside (the flag).
        self._open: list[tuple[str, int, bool]] = [("html", 0, False)]
        self._links = 0
        self._text: list[str] = []
        self._linked = 0

    def _flush(self):
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                at = self._open_node()
                node = self.nodes[at]
                node.own += len(text)
                node.linked += min(self._linked, len(text))
                if len(text) < 120 and len(node.short) < 240:
                    node.short += " " + text
                self.blocks.append((at, text))
        self._text, self._linked = [], 0

    def _open_node(self) -> int:
        return self._open[-1][1]

    def _pop_to(self, at: int):
        for tag, _, dropped in self._open[at:]:
            if tag == "a" and not dropped:
                self._links -= 1
        if any(tag not in INLINE and not dropped for tag, _, dropped in self._open[at:]):
            self._flush()
        del self._open[at:]

    def _close(self, kinds, stops):
        for at in range(len(self._open) - 1, 0, -1):
            tag = self._open[at][0]
            if tag in kinds:
                self._pop_to(at)
                return
            if tag in stops:
                return

    def _start_in_dropped(self, tag):
        """What a start tag ends while an element is dropped, as browsers do."""
        if self._open[-1][0] == "head" and tag not in HEAD and tag not in VOID:
            self._pop_to(len(self._open) - 1)  # an unclosed head ends where the body begins
            return
        if tag in ENDS_SVG:
            self._close(("svg",), ("desc", "foreignobject", "template"))
        if tag in ENDS_DROPPED:
            self._close(ENDS_DROPPED[tag], ("template",))
        kinds, stops = CLOSES.get(tag, ((), ()))
        for _ in range(2):
            if kinds and self._open[-1][2]:
                self._close(kinds, (*stops, "template"))

    def handle_starttag(self, tag, attrs):
        if self._open[-1][2]:
            if self._open[-1][0] in RAW:
                return
            self._start_in_dropped(tag)
            if self._open[-1][2]:
                if tag not in VOID:
                    self._open.append((tag, self._open_node(), True))
                return
        if tag in DROPPED:
            self._open.append((tag, self._open_node(), True))
            self._text.append(" ")
            return
        if tag in INLINE:
            if tag in VOID:
                if tag == "br":
                    self._text.append(" ")
                return
            if tag == "a":
                self._links += 1
            self._open.append((tag, self._open_node(), False))
            return
        if tag in VOID:
            if tag == "hr":
                self._flush()
            return
        if tag in ("html", "body") and any(t == tag for t, *_ in self._open):
            return
        kinds, stops = CLOSES.get(tag, ((), ()))
        if kinds:
            for _ in range(2):  # a row ends its open cell as well
                self._close(kinds, stops)
        self._close(("p",), ("article", "aside", "body", "button", "div", "li", "main", "nav", "section", "table", "td", "th"))
        self._flush()
        parent = self._open_node()
        self.nodes[parent].kids += 1
        self.nodes.append(Node(tag, parent, self.nodes[parent].depth + 1, attrs, len(self.blocks)))
        self._open.append((tag, len(self.nodes) - 1, False))

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif tag not in DROPPED:
            self.handle_starttag(tag, attrs)
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._open[-1][2] and self._open[-1][0] in RAW and tag != self._open[-1][0]:
            return
        for at in range(len(self._open) - 1, 0, -1):
            name, _, dropped = self._open[at]
            if name == tag:
                self._pop_to(at)
                return
            if dropped and (name == "template" or name == "button" and tag == "p"):
                return
            if tag in INLINE and name not in INLINE and not (dropped and name not in HOLDS and name not in TAG_GROUP):
                return

    def handle_data(self, data):
        if not self._open[-1][2]:
            self._text.append(data)
            if self._links > 0:
                self._linked += len(data)

    def finish(self):
        self.close()
        self._flush()
        nodes = self.nodes
        for node in nodes:
            node.below += node.own
            node.below_linked += node.linked
        for node in reversed(nodes[1:]):
            nodes[node.parent].below += node.below
            nodes[node.parent].below_linked += node.below_linked
        return self


def parse(html: str) -> PageParser:
    page = PageParser()
    page.feed(html)
    return page.finish()


def _size(n: int) -> int:
    """0 for no text, then 1 to 4 in steps of four times the length."""
    return 0 if n == 0 else 1 if n < 20 else min(4, 2 + int(math.log(n / 20, 4)))


def _says(node: Node) -> set[str]:
    if not node.short or len(node.short) >= 100:
        return set()
    return {k for w in re.findall(r"[a-z]+", node.short.lower()) for k in CUE_OF.get(w, ()) if k in _SAYS}


def features(page: PageParser) -> tuple[list[list[int]], list[list[int]]]:
    """Numbers of the active node features and edge features of every node; all features are 0 or 1.

    Names and tags count at their own element only, weighed against its share of the page's unlinked
    text; they reach other elements through the edges.  The names of html and body tell of the site,
    not of a part of the page, and count nowhere.
    """
    nodes, total = page.nodes, max(1, len(page.blocks))
    plain = max(1, nodes[0].below - nodes[0].below_linked)
    texts = [0] * len(nodes)
    said = [_says(node) for node in nodes]
    heads_comments, after_heading, after_text = ([False] * len(nodes) for _ in range(3))
    text_seen = [False] * len(nodes)
    opened = [False] * len(nodes)
    for at, node in enumerate(nodes[1:], 1):
        up = node.parent
        texts[up] += node.own > 60
        after_heading[at], after_text[at] = opened[up], text_seen[up]
        if "comment" in said[at] and len(node.short.split()) <= 4 and TAG_GROUP.get(node.tag) in ("heading", "div", "p"):
            opened[up] = True
            if not text_seen[up] and nodes[up].own == 0:
                heads_comments[up] = True
        if node.own > 60:
            text_seen[up] = True
    traits, found, edges = [], [], []
    for at, node in enumerate(nodes):
        group = TAG_GROUP.get(node.tag, "other")
        named = set() if group == "body" else node.named
        share = (node.below - node.below_linked) / plain
        much = 0 if share < 0.02 else 1 if share < 0.25 else 2 if share < 0.5 else 3
        bad_tag = group in ("nav", "header", "footer", "aside", "form")
        bad_name = bool(named - {"content"})
        content_tag, content_name = group in ("article", "main"), "content" in named
        active = ["bias", f"tag:{group}", f"own:{_size(node.own)}", f"below:{_size(node.below)}", f"share:{much}"]
        active += [f"named:{k}" for k in named]
        active += [f"says:{k}" for k in said[at]]
        if bad_name and content_name:
            active.append("content and other names")
        if not named:
            active.append("no names")
        if much >= 2:
            kinds = (("boilerplate tag", bad_tag), ("boilerplate name", bad_name))
            active += [f"{kind}, " + ("most text" if much == 3 else "much text") for kind, on in kinds if on]
        if node.hidden:
            active.append("hidden")
        if "©" in node.short:
            active.append("copyright")
        for name, linked, size in (("own", node.linked, node.own), ("below", node.below_linked, node.below)):
            if size and linked > 0.25 * size:
                active.append(f"{name} links " + ("most" if linked > 0.6 * size else "some"))
        if node.own > 30 and node.short[-1:] in ".!?" or node.own > 150:
            active.append("ends like a sentence")
        if node.first < 0.1 * total:
            active.append("first tenth")
        elif node.first >= 0.9 * total:
            active.append("last tenth")
        if after_heading[at]:
            active.append("after comment heading")
        if heads_comments[at]:
            active.append("begins with comment heading")
        if group == "list" and after_text[at]:
            active.append("list after text")
        if node.parent >= 0 and texts[node.parent] > 2:
            active.append("text siblings")
        traits.append((bad_tag and much < 2, bad_name and not content_name and much < 2, content_tag, much == 3, content_name, heads_comments[at]))
        found.append([INDEX[a] for a in active])
        tied = [0]
        if bad_tag and much < 2:
            tied.append(1)
        if bad_name and not content_name and much < 2:
            tied.append(2)
        if content_tag or content_name:
            tied.append(3)
        if node.parent >= 0 and nodes[node.parent].tag in ("html", "body"):
            tied.append(4)
        if group == "p":
            tied.append(5)
        if node.parent >= 0:
            tied += [6 + i for i, on in enumerate(traits[node.parent]) if on]
        edges.append(tied)
    return found, edges


_SAYS = frozenset(BOILERPLATE)
