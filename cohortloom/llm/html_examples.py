"""The small labelled table of the page classifier: invented pages, and the main text of each.

A block of a page counts as main text if the text on the right holds it.
"""

from __future__ import annotations

_MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/c">Contact us</a></li></ul></nav>'
_FOOT = '<footer><p>&copy; 2020 The Valley Press. All rights reserved.</p><p><a href="/t">Terms</a> <a href="/p">Privacy</a></p></footer>'
_COOKIE = '<div id="cookie-notice"><p>We use cookies to make this site work for you. By staying here you agree to all of them.</p><button>Fine</button></div>'
_AD = '<div class="ad">Buy two of our garden chairs today and get a third one free until the end of this week.</div>'
_SIDE = '<aside><h3>Most read</h3><ul><li><a href="/1">Bridge closed for repair</a></li><li><a href="/2">New school opens</a></li></ul><p>Our reporters choose the stories of the day for you.</p></aside>'
_COMMENTS = '<section class="comments"><h2>Comments</h2><div class="comment"><p>Anna</p><p>I walked there last year and it was just as you say, a lovely place to spend a long day.</p></div><div class="comment"><p>Me too.</p></div></section>'
_FORM = '<form action="/join"><p>Get our letter every week, with all that is new in the valley and the hills around it.</p><label>Mail</label><input name="m"><button>Join</button></form>'

_RIVER = (
    "The river rose by two metres overnight and took the old footbridge with it.",
    "Nobody was hurt.",
    "Workers from three towns began to clear the banks in the morning, and they expect to finish before the weekend.",
    "More rain is on its way.",
)
_BREAD = (
    "Bread for beginners",
    "Flour, water, salt and time are all it takes, and of these time is the one most people forget to give.",
    "Wait.",
    "Fold the dough four times over two hours, then leave it in a cool place until the next day.",
    "Bake it hot.",
)
_STARS = (
    "Looking up",
    "On a clear night away from town you can see about three thousand stars without any help at all.",
    "Start with the brightest.",
    "From there each pattern leads to the next, much as streets lead through a city that you come to know.",
)


def _p(lines: tuple[str, ...]) -> str:
    return "".join(f"<p>{x}</p>" for x in lines)


def _page(body: str) -> str:
    return f"<!DOCTYPE html><html><head><title>Page</title></head><body>{body}</body></html>"


PAGES: tuple[tuple[str, str], ...] = (
    # an article between menu and footer
    (_page(f"{_MENU}{_AD}<article><h1>Flood</h1>{_p(_RIVER)}</article>{_FOOT}"), " ".join(("Flood", *_RIVER))),
    (_page(f"<header><h2>The Valley Press</h2><p>News since 1901 from all over the valley</p></header>{_MENU}{_COOKIE}"
           f"<main><h1>{_BREAD[0]}</h1>{_p(_BREAD[1:])}</main>{_SIDE}{_FORM}{_FOOT}"), " ".join(_BREAD)),
    (_page(f"{_MENU}<article><header><h1>{_STARS[0]}</h1></header>{_p(_STARS[1:3])}{_AD}{_p(_STARS[3:])}{_COMMENTS}</article>{_FOOT}"), " ".join(_STARS)),
    (_page(f"{_COOKIE}<article><h1>{_BREAD[0]}</h1>{_p(_BREAD[1:3])}{_SIDE}{_p(_BREAD[3:])}{_FORM}</article>{_COMMENTS}{_FOOT}"), " ".join(_BREAD)),
    # containers named by their layout or state
    (_page(f'<div class="layout has-sidebar with-footer">{_MENU}<article class="post comments-open"><h1>Flood</h1>{_p(_RIVER)}</article>{_SIDE}{_FOOT}</div>'),
     " ".join(("Flood", *_RIVER))),
    (_page(f'{_MENU}<div class="related-topic"><article><h1>{_BREAD[0]}</h1>{_p(_BREAD[1:])}</article>{_COMMENTS}</div>{_FOOT}'), " ".join(_BREAD)),
    # links inside the main text
    (_page(f'{_MENU}<article><h1>Flood</h1><p><a href="/r">{_RIVER[0]}</a></p>{_p(_RIVER[1:])}<ul><li>{_STARS[2]}</li><li>Boots.</li></ul></article>{_FOOT}'),
     " ".join(("Flood", *_RIVER, _STARS[2], "Boots."))),
    # articles of one block, and pages of an article alone
    (_page(f"<article><p>{_RIVER[1]}</p></article>"), _RIVER[1]),
    (_page(f"<article><p>{_RIVER[0]}</p></article>"), _RIVER[0]),
    (_page("<main>On.</main>"), "On."),
    (_page(f"{_MENU}<article><h1>Rain</h1></article>{_FOOT}"), "Rain"),
    (_page(f'<article><h1>{_STARS[0]}</h1><p><a href="/s">{_STARS[2]}</a></p><p><a href="/m">More.</a></p></article>{_FOOT}'), " ".join((_STARS[0], _STARS[2], "More."))),
    (_page(f"<article>{_p(_RIVER[:2])}</article><p>Valley Press</p>"), " ".join(_RIVER[:2])),
    (_page(f"<p>Valley Press, the paper for all who live between the two rivers</p><article>{_p(_STARS[2:])}</article>"), " ".join(_STARS[2:])),
    # text outside of the article
    (_page(f"<p>Welcome back, dear reader, this is your valley and these are your pages for the day.</p><article>{_p(_STARS)}</article>"
           "<p>More from this paper</p><p>Sign up and read ten more pieces each month without any charge at all.</p>"), " ".join(_STARS)),
    (_page(f"<div><p>Some of our pages are free and some of them are for members of the paper only.</p></div><main>{_p(_RIVER)}</main><div>Top</div>"), " ".join(_RIVER)),
    (_page(f"<div>{_p((_RIVER[0], _RIVER[2], _BREAD[1]))}</div><article><h1>{_STARS[0]}</h1>{_p(_STARS[1:])}</article><div>{_p((_BREAD[3], _RIVER[3]))}</div>"),
     " ".join(_STARS)),
    (_page(f"<section>{_p((_STARS[1], _STARS[3], _RIVER[2]))}</section><main>{_p(_BREAD)}</main><section>{_p((_RIVER[0], _STARS[2]))}</section>"), " ".join(_BREAD)),
    # no element for the main text: words and links of the block and its neighbours
    (_page(f'<div><a href="/">Home</a> <a href="/n">News</a></div><div>{_p((_RIVER[0], _RIVER[2], _BREAD[1], _BREAD[3]))}</div>'
           '<div><a href="/1">Older news</a></div><div><a href="/2">Newer news</a></div>'), " ".join((_RIVER[0], _RIVER[2], _BREAD[1], _BREAD[3]))),
    (_page(f'<table><tr><td><a href="/">Home</a></td><td><a href="/a">About</a></td></tr></table>{_p((_STARS[1], _STARS[3], _BREAD[1]))}{_FOOT}'
           '<p><a href="/x">Next page of this site</a></p>'), " ".join((_STARS[1], _STARS[3], _BREAD[1]))),
    (_page(f"{_MENU}{_COOKIE}<div>{_p((_BREAD[1], _BREAD[2], _BREAD[3], _RIVER[1], _RIVER[2]))}</div>{_SIDE}{_FORM}{_FOOT}"),
     " ".join((_BREAD[1], _BREAD[2], _BREAD[3], _RIVER[1], _RIVER[2]))),
    (_page(f'<ul><li><a href="/a">Sports</a></li><li><a href="/b">Arts</a></li><li><a href="/c">Letters</a></li></ul>{_p((_STARS[1], _STARS[2], _STARS[3]))}'
           '<ul><li><a href="/d">Imprint</a></li><li><a href="/e">Jobs</a></li></ul>'), " ".join((_STARS[1], _STARS[2], _STARS[3]))),
)
