"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A block is the text between two block-level tags. Its features are word count and link
density, the same of the blocks before and after it, and the containers it stands in; the
tree is trained by Spark on the labelled table of ``html_labels`` and applied in one pass
over the pages, without a shuffle. Markup is read in one pass of linear time: containers hand
their flags down when they open, and no place of a page is searched twice.

A container counts as set aside if a whole word of its class, id or role names what is not main text,
alone or with words such as "site" or "list" ("cookie-notice", "site-footer"; not "no-sidebar" or
"layout-with-sidebar"); body and html never count, article and main only as a reader's comment.

Defined results: a null or empty page, or one without main blocks, has the text ""; broken
markup never raises: a tag without an end is dropped, as browsers do, an unclosed comment, script, style,
textarea or title runs to the end of the page, other unclosed elements to the end of what they stand
in, a "<" that begins no tag is text; references are decoded in each piece of text between two tags;
repeated rows each get a result; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from arborlake.llm.html_labels import labelled_pages
from arborlake.llm.text import pieces

_TAG = re.compile(r"""<(/?)([a-z][^\s/>]*)((?:=\s*(?:"[^"]*"|'[^']*')|[^>])*+)>""", re.I)
#: Where quotes do not add up, a tag ends at the first ">".
_PLAIN_TAG = re.compile(r"<(/?)([a-z][^\s/>]*)([^>]*)>", re.I)
_HINT = re.compile(r"""(?<![^\s"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HREF = re.compile(r"(?<![^\s\"'])href\s*=", re.I)
#: Elements whose content is no markup, and elements whose content is not shown as text.
_RAW = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in ("script", "style", "textarea", "title")}
_HIDDEN = frozenset("noscript template select iframe svg object canvas video audio button".split())
_BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_BOILER = frozenset("nav footer aside form dialog menu".split())
_MAIN = frozenset("article main".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are made for text, unlike those that hold others.
_OF_TEXT = _HEADING | frozenset("p li dd dt blockquote pre td th figcaption summary legend".split())
#: An element that opens ends those of these names right above it.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"td", "th", "tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
_COMMENT = frozenset("comment comments commentlist disqus".split())
#: Words of class, id or role that name what is not main text, and words that may stand beside them.
_AWAY = _COMMENT | frozenset("ad ads advert advertisement advertising adverts alert banner breadcrumb breadcrumbs complementary contentinfo consent cookie cookies dialog footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets".split())
_BESIDE = frozenset("area bar block bottom box buttons container content footer global inner item items left link links list main page panel post posts primary right row section secondary site slot text thread top unit wrap wrapper".split())
#: Words that say that a header is an article's or a section's.
_OF_ARTICLE = frozenset("content main panel post posts section text thread".split())
_WORD = re.compile(r"\S+")
_PARTS = re.compile(r"[-_:]+|(?<=[a-z])(?=[A-Z])|\d+")
FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "in_main", "in_boiler", "in_away", "in_header", "heading", "of_text"]
MAX_DEPTH = 7


def _away(name: str, attrs: str, in_main: bool) -> bool:
    if "=" not in attrs or name in ("body", "html"):
        return False
    # A header is the site's own where no article has begun and nothing beside the word says whose it is.
    named = _COMMENT if name in _MAIN else _AWAY if in_main else _AWAY | {"header"}
    beside = _BESIDE if in_main else _BESIDE - _OF_ARTICLE | {"header"}
    for value in _HINT.findall(attrs):
        for token in "".join(value).split():
            parts = {p.lower() for p in _PARTS.split(token) if p}
            if not parts.isdisjoint(named) and parts <= _AWAY | (beside if "header" in parts else _BESIDE):
                return True
    return False


class _Page:
    """Walks the markup of one page and gathers its blocks."""

    def __init__(self) -> None:
        self.blocks: list[tuple[str, list[float]]] = []
        #: Open elements: name, then in_main, in_boiler, in_away, in_header, heading, hidden.
        self.open: list[tuple] = [("", False, False, False, False, False, False)]
        self.names: Counter[str] = Counter()
        self.parts: list[str] = []
        self.linked, self.link = 0, 0  # link: how many elements were open when the link began

    def text(self, raw: str) -> None:
        if raw and not self.open[-1][6]:
            raw = unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.link:
                self.linked += len(_WORD.findall(raw))

    def end_block(self) -> None:
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                self.blocks.append((" ".join(words), [len(words), min(1.0, self.linked / len(words)), 0, 0, 0, 0, *self.open[-1][1:6], self.open[-1][0] in _OF_TEXT]))
            self.parts = []
        self.linked = 0

    def push(self, name: str, attrs: str) -> None:
        _, main, boiler, away, header, heading, hidden = self.open[-1]
        main = main or name in _MAIN
        self.open.append((name, main, boiler or name in _BOILER, away or _away(name, attrs, main), header or name == "header" and not main, heading or name in _HEADING, hidden or name in _HIDDEN))
        self.names[name] += 1

    def pop(self) -> str:
        name = self.open.pop()[0]
        self.names[name] -= 1
        if self.link > len(self.open):
            self.link = 0
        return name

    def tag(self, name: str, close: bool, attrs: str) -> None:
        if name == "a":
            self.link = 0 if close or not _HREF.search(attrs) else len(self.open)
        elif name == "br":
            self.text(" ")
        elif name in _BLOCK or name in _HIDDEN:
            if name in _BLOCK:
                self.end_block()
            if close:
                while self.names[name] and self.pop() != name:
                    pass
            elif name != "hr" and not (name in _HIDDEN and attrs.endswith("/")):
                if name in _BLOCK and self.open[-1][0] == "p":  # a block ends the paragraph before it
                    self.pop()
                while self.open[-1][0] in _ENDS.get(name, ()):
                    self.pop()
                self.push(name, attrs)


def blocks_of(page: str) -> tuple[list[str], np.ndarray]:
    """The text blocks of a page and their features."""
    walk, at, last, pattern = _Page(), 0, page.rfind(">"), _TAG
    while True:
        begin = page.find("<", at)
        if begin < 0:
            walk.text(page[at:])
            break
        walk.text(page[at:begin])
        kind = page[begin + 1 : begin + 2]
        if not (kind.isascii() and kind.isalpha()) and kind not in ("/", "!", "?"):
            walk.text("<")
            at = begin + 1
        elif page.startswith("<!--", begin):
            end = page.find("-->", begin + 2)
            at = end + 3 if end >= 0 else len(page)
        elif begin > last:
            break
        elif m := pattern.match(page, begin) or _PLAIN_TAG.match(page, begin):
            if m.re is not pattern:  # the quotes of the rest do not add up
                pattern = _PLAIN_TAG
            at, name = m.end(), m[2].lower()
            if name in _RAW and not m[1]:
                if not m[3].endswith("/"):
                    end = _RAW[name].search(page, at)
                    at = end.start() if end else len(page)
            else:
                walk.tag(name, bool(m[1]), m[3])
        else:
            at = page.find(">", begin) + 1
    walk.end_block()
    x = np.array([f for _, f in walk.blocks], dtype=float).reshape(-1, len(FEATURES))
    x[1:, 2:4], x[:-1, 4:6] = x[:-1, 0:2], x[1:, 0:2]
    return [t for t, _ in walk.blocks], x


def train(spark: SparkSession, max_depth: int = MAX_DEPTH):
    """The tree as nested (feature, threshold, left, right) tuples; a leaf is its label."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.linalg import Vectors

    rows = []
    for page, labels in labelled_pages():
        texts, x = blocks_of(page)
        if len(texts) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(texts)} blocks")
        rows += [(Vectors.dense(v), float(y)) for v, y in zip(x.tolist(), labels, strict=True)]
    table = spark.createDataFrame(rows, ["features", "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=1, seed=7).fit(table)

    def exported(node):
        if node.subtreeDepth() == 0:
            return int(node.prediction())
        split = node.split()
        return split.featureIndex(), split.threshold(), exported(node.leftChild()), exported(node.rightChild())

    return exported(model._call_java("rootNode"))


def classified(tree, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), dtype=bool)

    def walk(node, rows: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] = node == 1
        elif len(rows):
            feature, threshold, left, right = node
            low = x[rows, feature] <= threshold
            walk(left, rows[low])
            walk(right, rows[~low])

    walk(tree, np.arange(len(x)))
    return out


@lru_cache(maxsize=4)
def _trained(application: str, max_depth: int):
    return train(SparkSession.getActiveSession(), max_depth)


def main_text(page: str, tree) -> str:
    texts, x = blocks_of(page)
    return "\n".join(t for t, keep in zip(texts, classified(tree, x).tolist(), strict=True) if keep)


def extract(pages: DataFrame, tree=None) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points)."""
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(tree or _trained(spark.sparkContext.applicationId, MAX_DEPTH))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in pieces(batches, "html"):
            texts = [main_text(r.decode(), shared.value) for r in raw]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select("page_id", "url", "html")
    return rows.mapInArrow(run, rows.select("page_id", "url").schema.add("text", "string").add("n_chars", "long"))
