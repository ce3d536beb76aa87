"""The small labelled table that the block classifier of ``html_text`` learns from.

Each page is a list of (markup around the text, text, label); label 1 is main text. ``{}``
in the markup stands for the text; markup without it opens or closes containers.
"""

_MENU = [("<nav><ul>", None, 0), ('<li><a href="/a">{}</a></li>', "Home", 0), ('<li><a href="/b">{}</a></li>', "News and views", 0), ('<li><a href="/c">{}</a></li>', "About", 0), ("</ul></nav>", None, 0)]
_FOOT = [("<footer>{}</footer>", "© example.org · All rights reserved. Terms of use and privacy.", 0)]
_ADVERT = [('<div class="ad">{}</div>', "Buy two lamps today and pay for one.", 0)]
_LONG = "The river rose for three days before anyone in the valley thought of leaving, and by then the bridge was gone."
_MID = "Nobody had measured it since the war."
_BODY = [("<h1>{}</h1>", "The flood", 1), ("<p>{}</p>", _LONG, 1), ("<p>{}</p>", "Rain.", 1), ('<p>{} <a href="/x">see the map</a></p>', _MID, 1), ("<p>{}</p>", _MID, 1), ("<ul><li>{}</li></ul>", "two boats", 1)]
_SHORT = [("<h1>{}</h1>", "A note", 1), ("<p>{}</p>", "To the point.", 1)]
#: A menu and a list of links that no container or class gives away; plain labels stand among the links.
_LINKS = [('<div><a href="/1">{}</a></div>', "Weather", 0), ('<div><a href="/2">{}</a></div>', "Sport and games", 0), ("<div>{}</div>", "Sections", 0), ('<div><a href="/3">{}</a></div>', "Letters to the editor", 0), ("<div>{}</div>", "Follow the paper", 0), ('<div><a href="/4">{}</a></div>', "Archive", 0)]
_PROSE = [("<h2>{}</h2>", "After the flood", 1), ("<p>{}</p>", _LONG, 1), ("<p>{}</p>", "Rain.", 1), ("<p>{}</p>", _LONG, 1), ("<p>{}</p>", _MID, 1), ('<p>{} <a href="/x">see the map</a></p>', _LONG, 1), ("<p>{}</p>", "Nothing.", 1), ("<p>{}</p>", _LONG, 1)]
_LINKED = [('<p><a href="/m">{}</a></p>', "Map", 1), ("<p>{}</p>", "Rain.", 1), ('<p><a href="/f">{}</a></p>', "Photographs of the bridge as it stood before the water came", 1), ("<p>{}</p>", _LONG, 1), ('<p><a href="/g">{}</a></p>', "Gauges along the river", 1), ("<p>{}</p>", _MID, 1), ('<p><a href="/h">{}</a></p>', "Help", 1)]
_STORIES = [('<div><a href="/8">{}</a></div>', "The bridge that went before anyone in the valley thought of leaving", 0), ("<div>{}</div>", "More stories of the week for you", 0), ('<div><a href="/9">{}</a></div>', "Nobody had measured the river since the war and now it is too late", 0)]
_FEW = [("<p>{}</p>", "To the point.", 1), ("<p>{}</p>", "Yes.", 1), ("<p>{}</p>", "No one came.", 1)]
#: Links in a list that nothing names; a paragraph made of links amid prose; an advert that its class does not give away.
_LISTED = [('<ul><li><a href="/1">{}</a></li>', "Weather", 0), ('<li><a href="/2">{}</a></li>', "Sport and games", 0), ('<li><a href="/3">{}</a></li></ul>', "Letters to the editor of the paper", 0)]
_WOVEN = [("<p>{}</p>", _LONG, 1), ("<p>{}</p>", 'See the <a href="/m">map of the valley</a> and the <a href="/g">gauge readings</a>.', 1), ("<p>{}</p>", _LONG, 1), ("<p>{}</p>", '<a href="/t">The tables</a> say more.', 1), ("<p>{}</p>", _MID, 1)]
_OFFER = [('<div class="x1"><a href="/b">{}</a></div>', "Two lamps for the price of one, only today and only here", 0)]
_CLOSE = [("<p>{}</p>", "That was all.", 1)]
#: Prose whose paragraphs are no elements of text.
_BARE = [("<div>{}</div>", _LONG, 1), ("<div>{}</div>", "Rain.", 1), ("<div>{}</div>", _LONG, 1), ("<div>{}</div>", _MID, 1), ('<div>{} <a href="/x">see the map</a></div>', _LONG, 1), ("<div>{}</div>", _MID, 1), ("<div>{}</div>", "Nothing.", 1), ("<div>{}</div>", _LONG, 1)]
#: The same containers with as much text as an article's.
_HEAVY = [("<footer>{}</footer>", "© example.org · " + _LONG, 0), ('<div class="footer">{}</div>', _LONG + " " + _MID, 0), ("<aside>{}</aside>", _LONG, 0), ('<form action="/s">{}</form>', _LONG, 0), ('<div class="newsletter">{}</div>', _MID, 0), ("<nav>{}</nav>", _MID + " " + _LONG, 0), ("<footer><p>{}</p></footer>", _LONG + " " + _LONG, 0)]

PAGES = [
    [*_HEAVY, *_BARE, *_HEAVY],
    [*_HEAVY, ("<article>", None, 0), *_BARE, ("</article>", None, 0), *_HEAVY],
    [*_HEAVY, ("<article>", None, 0), *_PROSE, ("<footer>{}</footer>", _LONG + " " + _MID, 0), ("</article>", None, 0), *_HEAVY],
    [*_LISTED, ("<main>", None, 0), *_BARE, *_HEAVY, *_BARE, ("</main>", None, 0), *_LINKS, *_HEAVY],
    [*_LISTED, *_PROSE, *_CLOSE, *_LISTED],
    [*_LINKS, *_PROSE, ("<p>{}</p>", "Nobody came back to the valley.", 1), *_LINKS],
    [("<div>", None, 0), *_WOVEN, ("</div>", None, 0), *_LISTED],
    [*_LISTED, ("<h1>{}</h1>", "The flood", 1), *_WOVEN, *_CLOSE, *_STORIES],
    [*_MENU, ("<article>", None, 0), ("<p>{}</p>", _LONG, 1), *_OFFER, ("<p>{}</p>", _LONG, 1), ("<p>{}</p>", "Rain.", 1), ("</article>", None, 0), *_FOOT],
    [*_LINKS, ("<main>", None, 0), *_WOVEN, *_OFFER, *_BODY, ("</main>", None, 0), *_LISTED],
    [("<div>", None, 0), *_PROSE, ("</div>", None, 0), *_OFFER, *_LISTED],
    [*_LINKS, *_BARE, *_LINKS],
    [*_STORIES, ("<h1>{}</h1>", "The flood", 1), *_BARE, *_LISTED],
    [*_MENU, ("<article>", None, 0), *_BARE, *_OFFER, *_BARE, ("</article>", None, 0), *_FOOT],
    [*_LISTED, ("<main>", None, 0), ("<h1>{}</h1>", "The flood", 1), *_BARE, ("</main>", None, 0), *_STORIES],
    [*_MENU, ("<article>", None, 0), ("<div>{}</div>", "Yes.", 1), ("<div>{}</div>", "No one came.", 1), ("</article>", None, 0), *_FOOT],
    [*_MENU, *_ADVERT, ("<article>", None, 0), *_BODY, ("</article>", None, 0), *_FOOT],
    [*_MENU, *_ADVERT, ("<article>", None, 0), *_SHORT, ("</article>", None, 0), *_FOOT],
    [("<header>{}</header>", "The Valley Paper, since 1907, every morning at your door", 0), *_MENU, ("<main>", None, 0), *_BODY, ("</main>", None, 0), *_FOOT],
    [*_MENU, ("<article>", None, 0), ("<p>{}</p>", _LONG, 1), ('<div class="ad">{}</div>', _LONG, 0), ("<p>{}</p>", "Rain.", 1), ('<aside class="related"><a href="/r">{}</a></aside>', "Read next: the drought", 0), ("<p>{}</p>", _LONG, 1), ("</article>", None, 0), *_FOOT],
    [*_MENU, ('<div class="content">', None, 0), ("<h2>{}</h2>", "After the flood", 1), ("<p>{}</p>", _LONG, 1), ("<p>{}</p>", _LONG, 1), ("<p>{}</p>", _MID, 1), ("</div>", None, 0), ('<div class="sidebar">', None, 0), ("<p>{}</p>", _LONG, 0), ('<p><a href="/z">{}</a></p>', "More stories from the valley", 0), ("</div>", None, 0), *_FOOT],
    [('<div class="cookie-notice">{}</div>', "This site uses cookies to make your visit better. By reading on you agree to that.", 0), *_MENU, ("<article>", None, 0), *_BODY, ("</article>", None, 0), ('<section class="comments">', None, 0), ("<h3>{}</h3>", "Comments", 0), ("<p>{}</p>", _LONG, 0), ("<p>{}</p>", "I was there.", 0), ("</section>", None, 0), *_FOOT],
    [*_MENU, ("<main><article>", None, 0), *_BODY, ('<form action="/s"><p>{}</p></form>', "Leave us your address and we write to you once a week.", 0), ('<div id="comments">', None, 0), ("<p>{}</p>", _LONG, 0), ("</div>", None, 0), ("</article></main>", None, 0), *_FOOT],
    [('<div id="menu"><a href="/1">{}</a>', "One", 0), ('<div><a href="/2">{}</a></div></div>', "Two and three", 0), ("<div>", None, 0), ("<p>{}</p>", _LONG, 1), ("<p>{}</p>", _LONG, 1), ("</div>", None, 0), ('<div><a href="/q">{}</a></div>', "Imprint", 0)],
    [("<div>", None, 0), ("<p>{}</p>", _LONG, 1), ("<p>{}</p>", _MID, 1), ("<p>{}</p>", _LONG, 1), ("</div>", None, 0), *_FOOT],
    [("<p>{}</p>", _LONG, 1), ('<p><a href="/m">{}</a></p>', "Archive of all numbers", 0), ("<p>{}</p>", _LONG, 1)],
    [*_MENU, ('<div class="banner">{}</div>', _LONG, 0), ("<article>", None, 0), ("<header><h1>{}</h1></header>", "A small flood", 1), ('<p><a href="/p">{}</a></p>', "The whole paragraph is a link to the map of the valley.", 1), ("<p>{}</p>", _MID, 1), ("</article>", None, 0), ("<aside><p>{}</p></aside>", _LONG, 0), *_FOOT],
    [*_LINKS, ("<div>", None, 0), *_PROSE, ("</div>", None, 0), *_LINKS],
    [('<div class="layout-with-sidebar page-header-fixed">', None, 0), *_LINKS, *_PROSE, *_LINKS, ("</div>", None, 0)],
    [('<div class="post has-comments no-ads">', None, 0), *_PROSE, ("</div>", None, 0), ('<div class="comment-list">', None, 0), ("<p>{}</p>", _LONG, 0), ("<p>{}</p>", "I was there.", 0), ("</div>", None, 0), *_LINKS],
    [("<div>", None, 0), *_FEW, ("</div>", None, 0)],
    [*_LINKS, ("<article>", None, 0), *_LINKED, ("</article>", None, 0), *_STORIES, *_LINKS],
    [*_STORIES, ("<main>", None, 0), *_LINKED, *_LINKED, ("</main>", None, 0), *_LINKS],
    [*_LINKS, *_STORIES, *_PROSE, *_STORIES, *_LINKS],
    [("<header><p>{}</p>", _LONG, 0), ("<p>{}</p></header>", _MID, 0), *_PROSE, *_FOOT],
    [("<header><h1>{}</h1></header>", "The Valley Paper", 0), ("<main>", None, 0), *_FEW, ("</main>", None, 0), *_FOOT],
    [("<header>{}</header>", _LONG, 0), *_PROSE, *_LINKS],
    [("<div>{}</div>", "The Paper", 0), *_LINKS, *_PROSE, *_LINKS, ("<div>{}</div>", "Imprint", 0), *_STORIES],
    [("<header>{}</header>", "The Paper", 0), *_LINKS, *_PROSE, *_STORIES],
    [*_MENU, ("<article>", None, 0), *_LINKED, ('<div class="share-buttons"><a href="/sh">{}</a></div>', "Share", 0), *_LINKED, ('<ul class="related-posts"><li><a href="/r1">{}</a></li>', "The drought of that year and what came after it", 0), ('<li><a href="/r2">{}</a></li></ul>', "Dams", 0), ("</article>", None, 0), *_FOOT],
    [("<h1>{}</h1>", "A note", 1), *_FEW, *_LINKS],
    [*_LINKS, *_PROSE, ('<div>{} <a href="/t">terms</a> <a href="/p">privacy</a></div>', "2020", 0), *_LINKS],
    [*_MENU, ('<article class="post sidebar-left">', None, 0), *_BODY, ('<ul><li><a href="/s">{}</a></li></ul>', "the survey of the valley", 1), ("</article>", None, 0), ('<article class="comment">', None, 0), ("<p>{}</p>", _LONG, 0), ("</article>", None, 0), *_FOOT],
    [*_MENU, ("<article>", None, 0), ("<p>{}</p>", "7", 1), ("<p>{}</p>", "Yes.", 1), ("<p>{}</p>", _LONG, 1), ("<footer><p>{}</p></footer>", "Written by the desk.", 0), ("</article>", None, 0), *_FOOT],
]
#: Adverts and notices of all lengths before headings of all lengths, by name and set apart by tags.
PAGES += [
    [*before, (mark, text, 0), ("<article>" if named else "<div>", None, 0), ("<h1>{}</h1>", head, 1), *body, ("</article>" if named else "</div>", None, 0), *_HEAVY[:k], *_LISTED]
    for k, (mark, text) in enumerate(zip(['<div class="ad">{}</div>', '<section class="promo">{}</section>', '<div class="cookie-notice"><p>{}</p></div>', "<aside>{}</aside>"] * 2, ["Buy now.", _MID, _LONG, _LONG + " " + _MID, _LONG, "Buy two lamps today and pay for one.", _MID, "Only today."], strict=True))
    for head in ("Rain", "The flood", "What the valley said after the water had gone down again")
    for named, before, body in ((True, _MENU, _PROSE), (False, _LISTED, _BARE))
]


def labelled_pages() -> list[tuple[str, list[int]]]:
    """(html, label of each text block in page order)."""
    out = []
    for page in PAGES:
        html = "".join(mark if text is None else mark.replace("{}", text) for mark, text, _ in page)
        out.append((f"<!DOCTYPE html><html><head><title>x</title></head><body>{html}</body></html>", [label for _, text, label in page if text is not None]))
    return out
