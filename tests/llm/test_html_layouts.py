"""Layouts that the labelled table does not have: what is kept, what goes, and that neighbours decide."""

import numpy as np
import pytest

from arborlake.llm import html_text

LONG = "The town hall opened its doors at nine and closed them at noon because no one had come to see the plans. "
SECOND = "It went on for most of the year until the council met again, heard both sides and changed the rules. "


@pytest.fixture(scope="module")
def tree(spark):
    return html_text.train(spark)


@pytest.mark.parametrize(
    ("page", "kept"),
    [
        ('<article><div class="post-header"><h1>Flood takes the bridge</h1></div><p>{a}</p></article>', ["Flood takes the bridge", "{a}"]),
        ('<div><div class="section-header"><h2>Second day</h2></div><p>{a}</p><p>{b}</p></div>', ["Second day", "{a}", "{b}"]),
        ("<div><p>{a}</p><p>That was the end of it.</p></div><ul><li><a href='/1'>One thing</a></li><li><a href='/2'>Another thing</a></li></ul>", ["{a}", "That was the end of it."]),
        ("<div><p>{a}</p><p>See the <a href='/m'>map of the valley</a> and the <a href='/g'>gauge readings</a>.</p><p>{b}</p></div>", ["{a}", "See the map of the valley and the gauge readings.", "{b}"]),
        ("<article><p>{a}</p><div class='outbrain'><a href='/x'>Ten pans that chefs keep at home</a></div><p>{b}</p></article>", ["{a}", "{b}"]),
        ("<main><div class='zz9'><a href='/x'>Cheap flights to the sea from here</a></div><p>{a}</p></main>", ["{a}"]),
        ("<div><div>{a}</div><div>Short.</div><div>{b}</div></div>", ["{a}", "Short.", "{b}"]),
        ("<div><a href='/1'>Home</a></div><div>Topics</div><div><a href='/2'>World and local news</a></div><div>{a}</div><div>{b}</div>", ["{a}", "{b}"]),
        ("<div class='site-header'>{b}</div><article><header><h1>A title</h1></header><p>{a}</p></article><footer>{b}</footer>", ["A title", "{a}"]),
        ("<article><p>{a}</p></article><section id='comments'><p>{b}</p></section>", ["{a}"]),
    ],
)
def test_layouts(tree, page, kept):
    fill = lambda s: s.replace("{a}", LONG.strip()).replace("{b}", SECOND.strip())
    assert html_text.main_text(f"<html><body>{fill(page)}</body></html>", tree) == "\n".join(fill(k) for k in kept)


def test_neighbours_decide(tree):
    """The same short block without a name is a label among links and a paragraph amid prose."""
    among = "<div><a href='/1'>Home</a></div><div>Topics</div><div><a href='/2'>World and local news</a></div>"
    amid = f"<div>{LONG}</div><div>Topics</div><div>{SECOND}</div>"
    assert "Topics" not in html_text.main_text(among, tree) and "Topics" in html_text.main_text(amid, tree)
    texts, x = html_text.blocks_of(amid + among)
    blind = x.copy()
    blind[:, 2:6] = 0
    assert (html_text.classified(tree, x) != html_text.classified(tree, blind)).any() and len(texts) == len(x)
    used = set(np.unique([html_text.FEATURES[n[0]] for n in _nodes(tree)]))
    assert {"words", "links"} <= used and used & {"words_before", "links_before", "words_after", "links_after"}


def _nodes(node):
    return [node, *_nodes(node[2]), *_nodes(node[3])] if isinstance(node, tuple) else []


def test_no_pages(spark):
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
