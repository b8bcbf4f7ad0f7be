"""Main text of web pages by tree scoring.

A tolerant parser builds a small tree.  Paragraphs give points for length and commas to their
ancestors, less with each step up; a node's points are discounted by its link density.  The best
container is kept, and those of its siblings that score well or read like text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
SPACES = re.compile(r"[\x20\x09-\x0D]+")
NAMES = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")
RAW = {k: re.compile(rf"</{k}(?=[\s/>])", re.I) for k in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")}
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe noembed noframes object button select textarea title svg math dialog menu canvas audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rp rt s samp small span strike strong sub sup time tt u var".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
P_SCOPE = ENDS_P - {"p"} | {"table", "td", "th", "button"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
BAD = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription newsletter signup share sharing social comment comments commentlist respond disqus footer masthead topbar toolbar related recommended recommendations pagination pager paging widget widgets skip login".split()
)
NEUTRAL = frozenset(("with", "has", "no", "without", "is", "js"))


def boilerplate(tag: str, attributes: str) -> bool:
    """Whether an element is a menu, notice, advert and so on by its tag or its names."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for kind, a, b, c in NAMES.findall(attributes):
        for name in (a or b or c).split():
            words = [w.lower() for w in WORDS.findall(name)]
            if kind.lower() == "role":
                if name.lower() in ROLES:
                    return True
            elif words and words[0] not in NEUTRAL and not BAD.isdisjoint(words):
                return True
    return False


class Open:
    """The open elements: a stack, and for each tag its places in the stack, so that the nearest
    one of a name is found without a walk.  Each element is taken off once."""

    def __init__(self) -> None:
        self.nodes, self.tags = [0], ["#root"]
        self.places: dict[str, list[int]] = {}

    def push(self, node: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.nodes))
        self.nodes.append(node)
        self.tags.append(tag)

    def last(self, names: frozenset[str] | set[str]) -> int:
        """The highest place of an element with one of some names; 0 if there is none."""
        found = 0
        for name in names if len(names) < len(self.places) else self.places:
            if name in names and (own := self.places.get(name)) and own[-1] > found:
                found = own[-1]
        return found

    def cut(self, place: int) -> None:
        """Close the element at a place and all within."""
        for tag in self.tags[place:]:
            self.places[tag].pop()
        del self.nodes[place:], self.tags[place:]

    def close(self, tag: str, scope: frozenset[str] | set[str] = frozenset()) -> None:
        """Close the nearest element of a name, unless one of the scope lies nearer."""
        own = self.places.get(tag)
        if own and own[-1] > self.last(scope):
            self.cut(own[-1])


class Tree:
    """Parents and tags of the nodes, and the texts in page order: ``(node, text)``; a text of
    None is a break."""

    def __init__(self, page: str):
        self.tags, self.parents, self.texts = ["#root"], [-1], []
        opened, tags, parents, texts = Open(), self.tags, self.parents, self.texts
        stack = opened.nodes
        dead = at = 0  # dead: depth of the stack at which a dropped element began
        scan = TOKEN.scanner(page)
        while (m := scan.search()) is not None:
            if m.start() > at and not dead:
                texts.append((stack[-1], page[at : m.start()]))
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, attributes = name.lower(), m[3] or m[6] or ""
            if m[1] or m[4]:
                opened.close(tag)
                if dead and len(stack) < dead:
                    dead = 0
                if not dead and tag not in INLINE:
                    texts.append((stack[-1], None))
                continue
            if tag in ENDS_P:
                opened.close("p", P_SCOPE)
            if tag in CLOSES:
                own, scope = CLOSES[tag]
                # a row ends its cells and the row before, others end one element
                while (place := opened.last(own)) > opened.last(scope):
                    opened.cut(place)
                    if tag != "tr":
                        break
            if dead and len(stack) < dead:
                dead = 0
            if not dead and tag not in INLINE:
                texts.append((stack[-1], None))
            if tag in VOID:
                continue
            tags.append(tag)
            parents.append(stack[-1])
            opened.push(len(tags) - 1, tag)
            if not dead and boilerplate(tag, attributes):
                dead = len(stack)
            if tag in RAW:  # no markup until the end tag
                end = RAW[tag].search(page, at)
                at = end.start() if end else len(page)
                scan = TOKEN.scanner(page, at)
        if at < len(page) and not dead:
            texts.append((stack[-1], page[at:]))


def extract(page: str) -> str:
    """The main text of a page; empty if it has none."""
    if "<" not in page:
        return SPACES.sub(" ", html.unescape(page)).strip(" ")
    tree = Tree(page)
    tags, parents = tree.tags, tree.parents
    n = len(tags)
    texts = [(node, t if t is None or "&" not in t else html.unescape(t)) for node, t in tree.texts]
    size, linked, own, commas = [0] * n, [0] * n, [0] * n, [0] * n
    block = list(range(n))  # the nearest node that is not inline
    link = [False] * n
    for k in range(1, n):
        up = parents[k]
        link[k] = link[up] or tags[k] == "a"
        if tags[k] in INLINE:
            block[k] = block[up]
    for node, t in texts:
        if t is None or not (length := len(t.strip())):
            continue
        size[node] += length
        own[block[node]] += length
        commas[block[node]] += t.count(",") + t.count("、") + t.count("，")
        if link[node]:
            linked[node] += length
    for k in range(n - 1, 0, -1):
        size[parents[k]] += size[k]
        linked[parents[k]] += linked[k]
    score, given = [0.0] * n, [0.0] * n  # given: what a node has from below, halved with each step up
    for k in range(n - 1, 0, -1):
        points = 0.0
        # paragraphs, and other blocks that hold text of their own
        if own[k] and tags[k] not in HEADINGS and tags[k] not in INLINE:
            points = (1 + commas[k] + min(own[k] / 100, 3)) * (1 - linked[k] / max(1, size[k]))
        score[k] = given[k] + (0.0 if tags[k] in PARAGRAPHS else points)
        given[parents[k]] += points + given[k] / 2
    if own[0]:
        score[0] = (1 + commas[0] + min(own[0] / 100, 3)) * (1 - linked[0] / max(1, size[0]))
    for k in range(n):
        score[k] *= 1 - linked[k] / max(1, size[k])
    best = max(range(n), key=lambda k: (score[k], -k))
    if score[best] <= 0:
        best = next((k for k in range(n) if tags[k] in ("article", "main") and size[k]), 0)
    up = best
    while up > 0:  # a part of an article stands for all of it
        if tags[up] in ("article", "main"):
            best = up
        up = parents[up]
    keep = [False] * n
    keep[best] = True
    if best and tags[best] not in ("body", "html"):
        bar = max(10.0, score[best] * 0.2)
        for k in range(1, n):
            if k != best and parents[k] == parents[best] and size[k]:
                density = linked[k] / size[k]
                if score[k] >= bar or (tags[k] == "p" and (size[k] > 80 and density < 0.25)):
                    keep[k] = True
    for k in range(1, n):
        keep[k] = keep[k] or keep[parents[k]]
    return SPACES.sub(" ", "".join([" " if t is None else t for node, t in texts if t is None or keep[node]])).strip(" ")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` for each row.

    Null and empty pages, and pages without text, give an empty text; broken markup is read as
    browsers do, as far as it matters here; repeated rows each give a row; other columns are
    ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "html", 4 << 20):
            found = [extract(p or "") for p in b.column("html").to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = [f.dataType.simpleString() for f in plain.schema]
    return plain.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
