"""Pages in layouts of sites seen in the wild, written apart from the training pages: (html, lines of the article)."""

import random

WORDS = (
    "the council voted on Tuesday to close a bridge over river Mersey after engineers found cracks in two of its main beams "
    "traffic will use another road until repairs end in spring and local shops fear fewer visitors while schools plan longer "
    "bus rides each morning officials said money comes from state funds but costs may rise if steel prices do not fall soon"
).split()
NAMES = ("Anna", "Jürgen", "Marta", "Li Wei", "Sam", "Oluwaseun", "Pierre")


class Writer:
    def __init__(self, seed):
        self.r = random.Random(f"independent {seed}")

    def s(self, low=8, high=18):
        words = [self.r.choice(WORDS) for _ in range(self.r.randint(low, high))]
        return " ".join(words).capitalize() + "."

    def p(self):
        return " ".join(self.s() for _ in range(self.r.randint(2, 5)))

    def title(self):
        return " ".join(self.r.choice(WORDS) for _ in range(6)).capitalize()

    def article(self, n=None):
        return [self.title()] + [self.p() for _ in range(n or self.r.randint(2, 8))]


def body(lines):
    return f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x}</p>" for x in lines[1:])


NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/world">World</a></li><li><a href="/money">Money</a></li></ul></nav>'
FOOT = '<footer><p>&copy; 2021 Example Media. All rights reserved.</p><a href="/terms">Terms</a></footer>'


def form_around(w):
    t = w.article()
    return f"<body><form id='aspnetForm' method='post' action='x.aspx'>{NAV}<div id='ctl00_main'><article>{body(t)}</article></div>{FOOT}</form></body>", t


def long_form_around(w):
    t = w.article(20)
    return f"<body><form id='aspnetForm'>{NAV}<article>{body(t)}</article>{FOOT}</form></body>", t


def banner_body(w):
    t = w.article()
    return f"<body class='has-top-banner logged-out'>{NAV}<article>{body(t)}</article>{FOOT}</body>", t


def comments_open(w):
    t = w.article()
    return f"<body>{NAV}<article class='post comments-open tag-news'>{body(t)}</article>{FOOT}</body>", t


def alert_weather(w):
    t = w.article()
    return f"<body>{NAV}<article class='post alert-weather'>{body(t)}</article>{FOOT}</body>", t


def link_list(w):
    t = w.article(1)
    links = [w.title() for _ in range(10)]
    made = body(t) + "<ul>" + "".join(f"<li><a href='/{i}'>{x}</a></li>" for i, x in enumerate(links)) + "</ul>"
    return f"<body>{NAV}<main>{made}</main>{FOOT}</body>", t + links


def unnamed_comments(w):
    t = w.article()
    said = "".join(f"<div><b>{w.r.choice(NAMES)}</b><p>{w.s(5, 12)}</p></div>" for _ in range(3))
    return f"<body>{NAV}<article>{body(t)}</article><div><h3>3 Kommentare</h3>{said}</div>{FOOT}</body>", t


def blog(w):
    t = w.article()
    side = "<aside id='secondary' class='widget-area'><h2>Recent Posts</h2><ul><li><a href='/a'>One more bridge</a></li><li><a href='/b'>Roads</a></li></ul></aside>"
    reply = f"<div id='comments' class='comments-area'><h2>2 thoughts</h2><ol><li><p>{w.s()}</p></li><li><p>{w.s()}</p></li></ol></div>"
    top = "<header id='masthead' class='site-header'><p class='site-title'><a href='/'>My blog</a></p></header>"
    entry = f"<article id='post-12' class='post type-post hentry'><header class='entry-header'><h1 class='entry-title'>{t[0]}</h1></header><div class='entry-content'>" + "".join(f"<p>{x}</p>" for x in t[1:]) + "</div></article>"
    return f"<body class='single single-post'><div id='page' class='site'>{top}<div id='content' class='site-content'><main id='main'>{entry}{reply}</main></div>{side}{FOOT}</div></body>", t


def plain_divs(w):
    t = w.article()
    menu = "<div id='menu'><a href='/'>Start</a> <a href='/x'>Archive</a> <a href='/y'>Contact</a></div>"
    return f"<body>{menu}<div id='content'>{body(t)}</div><div id='footer'>Copyright 2009 Example</div></body>", t


def cookie_and_advert(w):
    t = w.article()
    bar = "<div class='cookie-consent'><p>We use cookies to make this site better.</p><button>Accept</button></div>"
    ad = f"<div class='advertisement'><p>{w.s(6, 9)}</p></div>"
    made = f"<h1>{t[0]}</h1><p>{t[1]}</p>{ad}" + "".join(f"<p>{x}</p>" for x in t[2:])
    return f"<body>{bar}<header><div class='logo'>Daily News</div>{NAV}</header><main><article>{made}</article></main>{FOOT}</body>", t


def manual(w):
    t = w.article(3)
    steps = [w.s(4, 9) for _ in range(5)]
    side = "<div class='sidebar'><ul><li><a href='/1'>Install</a></li><li><a href='/2'>Set up</a></li><li><a href='/3'>Run</a></li></ul></div>"
    made = f"<h1>{t[0]}</h1><p>{t[1]}</p><ol>" + "".join(f"<li>{x}</li>" for x in steps) + f"</ol><p>{t[2]}</p><blockquote><p>{t[3]}</p></blockquote>"
    return f"<body>{NAV}<div class='container'>{side}<div class='documentation main' role='main'>{made}</div></div>{FOOT}</body>", t[:2] + steps + t[2:]


def newsletter_inside(w):
    t = w.article(6)
    box = "<section class='newsletter-signup'><h4>Stay informed</h4><p>Get our letter every Friday.</p><form><input><button>Go</button></form></section>"
    made = f"<h1>{t[0]}</h1>" + "".join(f"<p>{x}</p>" for x in t[1:4]) + box + "".join(f"<p>{x}</p>" for x in t[4:])
    return f"<body class='menu-open'>{NAV}<div class='story-wrapper'><article>{made}</article></div><aside><h3>Most read</h3><p>{w.s()}</p></aside>{FOOT}</body>", t


def table_layout(w):
    t = w.article()
    left = "<td width='20%'><a href='/1'>Start</a><br><a href='/2'>Team</a><br><a href='/3'>Links</a></td>"
    return f"<body bgcolor='white'><table><tr>{left}<td>{body(t)}</td></tr></table><p align='center'>Copyright 2003 Example</p></body>", t


def comments_inside(w):
    t = w.article(5)
    said = "".join(f"<li class='comment'><p>{w.r.choice(NAMES)} wrote:</p><p>{w.s()}</p></li>" for _ in range(4))
    made = body(t) + f"<section id='discussion'><h2>Comments</h2><ol>{said}</ol><form id='respond'><label>Name</label><input><textarea></textarea></form></section>"
    return f"<body class='no-sidebar'><div class='wrap'>{NAV}<article class='entry'>{made}</article>{FOOT}</div></body>", t


def pictures_and_share(w):
    t = w.article(4)
    caption = w.s(4, 8)
    share = "<div class='social-share'><a href='#'>Share</a> <a href='#'>Tweet</a></div>"
    modal = "<div class='modal' style='display:none'><h3>Subscribe</h3><p>Read without limits.</p></div>"
    made = f"<h1>{t[0]}</h1>{share}<p>{t[1]}</p><figure><img src='a.jpg'><figcaption>{caption}</figcaption></figure>" + "".join(f"<p>{x}</p>" for x in t[2:])
    related = "<section class='related'><h3>More stories</h3><ul><li><a href='/q'>A road too far</a></li><li><a href='/z'>Steel again</a></li></ul></section>"
    return f"<body>{modal}<header class='top-bar'>{NAV}</header><div id='main-content'><div class='article-body'>{made}</div>{related}</div>{FOOT}</body>", t[:2] + [caption] + t[2:]


LAYOUTS = (
    form_around, long_form_around, banner_body, comments_open, alert_weather, link_list, unnamed_comments, blog, plain_divs,
    cookie_and_advert, manual, newsletter_inside, table_layout, comments_inside, pictures_and_share,
)


def independent_pages(each=10):
    """(layout, html, lines) of every layout."""
    head = "<!doctype html><html><head><title>A page</title></head>"
    return [(f.__name__, head + page + "</html>", lines) for f in LAYOUTS for i in range(each) for page, lines in [f(Writer(f"{f.__name__}{i}"))]]
