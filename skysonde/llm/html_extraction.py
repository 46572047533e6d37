"""Main text of web pages by tree scoring.

Every block of text passes points for its length and its commas, less the share of it
that is links, to the containers above it: all to the next one, half to the one above
that, and less the further up.  The container with most points is the article; siblings
of it that score well, or are paragraphs of prose, belong to it too.  Pages are worked
on one by one and need no shuffle.
"""

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skysonde.llm.common import small_batches

# Element names of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | set("p li dt dd td th pre blockquote figcaption caption summary address".split())
CONTAINERS = set("html body main article section div td center details fieldset".split())
OTHER_BLOCKS = set(
    "ul ol dl table thead tbody tfoot tr figure header footer nav aside form hgroup dialog menu noscript template "
    "select option optgroup button object svg canvas audio video hr search".split()
)
BLOCKS = PARAGRAPHS | CONTAINERS | OTHER_BLOCKS
DROPPED = set("nav aside footer form dialog menu noscript template select button object svg canvas audio video search".split())
TABLE_PARTS = set("table thead tbody tfoot tr".split())
CELLS = {"td", "th", "caption", "table", "button", "object"}
#: Opening one of these ends an open element of the first set that is above all of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"} | CELLS),
    "dt": ({"dt", "dd"}, {"dl"} | CELLS),
    "dd": ({"dt", "dd"}, {"dl"} | CELLS),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, set()),
} | {name: ({"thead", "tbody", "tfoot"}, {"table"}) for name in ("thead", "tbody", "tfoot")}

# Words in class, id and role that mark what is no part of an article.
NOISE = set(
    "ad ads advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promotion banner "
    "sidebar sidenav rail menu nav navbar navigation breadcrumb breadcrumbs masthead header footer contentinfo "
    "complementary cookie cookies consent gdpr notice notices notification popup modal overlay dialog alert toast "
    "newsletter subscribe subscription signup login share sharing social related recommended recommendations "
    "comment comments commentlist respond replies disqus widget widgets toolbar pagination pager search skip".split()
)
#: Class names such as has-sidebar or without-banner speak of the layout around an element.
LAYOUT = {"has", "with", "no", "without", "is"}
COMMAS = ",，、،"
#: Shares of the points of a block that the containers above it get, from the next one up.
SHARES = (1.0, 0.5, *(1 / (3 * level) for level in range(2, 12)))
#: A sibling of the best container is kept from this share of its points on.
SIBLING_SHARE = 0.2
#: So much of a list is links, in so many items, that it is a menu.
MENU_DENSITY, MENU_ITEMS = 0.9, 3

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?)")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node(NamedTuple):
    """A block element: what is above it (-1: nothing), its name, and whether its attributes mark it as noise."""

    parent: int
    tag: str
    noise: bool


class Block(NamedTuple):
    """A run of text between two ends of blocks, the node it is in, and its characters inside links."""

    node: int
    text: str
    linked: int


def is_noise(attributes: dict[str, str]) -> bool:
    """Whether class, id, role or visibility say that an element is no part of an article."""
    style = attributes.get("style", "").replace(" ", "").lower()
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in style:
        return True
    for name in ("class", "id", "role"):
        for value in attributes.get(name, "").split():
            words = {w.lower() for w in _WORD.findall(value)}
            if words & NOISE and not words & LAYOUT:
                return True
    return False


class _Tree:
    """Nodes and blocks of a page, in page order, as tags and texts come in."""

    def __init__(self) -> None:
        self.nodes, self.blocks = [Node(-1, "html", False)], []
        self.stack = [("html", 0, False)]  # name, innermost node, whether text is left out
        self.open = defaultdict(list)  # places in the stack by name
        self.block_places = [0]
        self.pieces, self.linked = [], 0

    def text(self, text: str) -> None:
        if not self.stack[-1][2]:
            text = unescape(text) if "&" in text else text
            self.pieces.append(text)
            if self.open["a"]:
                self.linked += len(" ".join(text.split()))

    def flush(self) -> None:
        """A block ends here."""
        text = " ".join("".join(self.pieces).split())
        if text:
            self.blocks.append(Block(self.stack[-1][1], text, self.linked))
        self.pieces, self.linked = [], 0

    def _last(self, names: set[str]) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def _cut(self, place: int) -> None:
        """Close everything from a place of the stack on."""
        if self.block_places[-1] >= place:
            self.flush()
        while self.block_places[-1] >= place:
            self.block_places.pop()
        while len(self.stack) > place:
            self.open[self.stack.pop()[0]].pop()

    def start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ("html", "body", "head"):
            return  # a page has one of each, whatever it says
        block = tag in BLOCKS
        if block:
            self.flush()
            paragraph = self._last({"p"})
            if paragraph > self._last(CELLS):
                self._cut(paragraph)
            if self.stack[-1][0] in HEADINGS and tag in HEADINGS:
                self._cut(len(self.stack) - 1)
        if tag in ENDS:
            ended, barrier = ENDS[tag]
            place = self._last(ended)
            if place > max(self._last(barrier), self.block_places[-1] if tag == "a" else 0):
                self._cut(place)
        if tag == "br":
            self.pieces.append(" ")
        if tag in VOID:
            return
        _, node, muted = self.stack[-1]
        noise = bool(attributes) and is_noise(attributes)
        if block:
            self.nodes.append(Node(node, tag, noise))
            node = len(self.nodes) - 1
            self.block_places.append(len(self.stack))
        else:
            muted = muted or noise
        self.open[tag].append(len(self.stack))
        self.stack.append((tag, node, muted))

    def end(self, tag: str) -> None:
        if tag == "p" and not self.open["p"]:
            self.flush()
        if not self.open.get(tag):
            return
        if tag not in BLOCKS:  # ends in its own block only
            barrier = self.block_places[-1]
        elif tag in TABLE_PARTS:
            barrier = 0 if tag == "table" else self._last({"table"})
        else:  # a cell keeps open what is outside of it
            barrier = self._last(CELLS - {tag})
        if self.open[tag][-1] > barrier:
            self._cut(self.open[tag][-1])


def parsed(html: str) -> tuple[list[Node], list[Block]]:
    """Block elements and runs of text of a page, however broken it is, in linear time."""
    tree, at, n = _Tree(), 0, len(html)
    while at < n:
        opening = html.find("<", at)
        opening = n if opening < 0 else opening
        if opening > at:
            tree.text(html[at:opening])
        tag = _TAG.match(html, opening)
        if tag is None:
            mark = html[opening + 1 : opening + 2]
            if html.startswith("<!--", opening):
                end = html.find("-->", opening + 2)  # <!--> is a whole comment
                at = n if end < 0 else end + 3
            elif mark and mark in "!?/":
                end = html.find(">", opening)
                at = n if end < 0 else end + 1
            else:
                tree.text(html[opening : opening + 1])
                at = opening + 1
            continue
        name, at, attributes = tag[2].lower(), tag.end(), {}
        while True:
            item = _ATTRIBUTE.match(html, at)
            if item is None:  # the page ends inside a tag
                at, name = n, ""
                break
            at = item.end()
            if item[1]:
                break
            attributes.setdefault(item[2].lower(), unescape(item[3] or item[4] or item[5] or ""))
        if not name:
            break
        if tag[1]:
            tree.end(name)
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
            at = end.start() if end else n
        else:
            tree.start(name, attributes)
    tree.flush()
    return tree.nodes, tree.blocks


def _summed_up(nodes: list[Node], values: list) -> list:
    """Values of nodes with those of everything below them."""
    total = list(values)
    for i in range(len(nodes) - 1, 0, -1):
        total[nodes[i].parent] += total[i]
    return total


def _kept(nodes: list[Node], sizes: list[int]) -> list[str]:
    """For every node "yes", "no", or "headings" where only headings below it are kept.

    An element that holds all articles of the page, or its main part, or being a form most
    of its text, is a frame around the page and stays.
    """
    articles = _summed_up(nodes, [x.tag == "article" and not x.noise for x in nodes])
    mains = _summed_up(nodes, [x.tag == "main" for x in nodes])
    kept, inside = ["yes"] * len(nodes), [False] * len(nodes)
    for i, (parent, tag, noise) in enumerate(nodes[1:], 1):
        inside[i] = inside[parent] or tag in ("article", "main")
        kept[i] = kept[parent]
        frame = mains[i] or (articles[i] and articles[i] == articles[0])
        if tag == "form":
            frame = frame or sizes[i] * 2 > sizes[0]
        if (noise or tag in DROPPED) and not frame:
            kept[i] = "no"
        elif tag == "header" and kept[i] == "yes" and not frame:
            kept[i] = "headings" if inside[i] else "no"
    return kept


def main_text(html: str) -> str:
    """Text of the article of one page: its blocks, joined by empty lines."""
    nodes, blocks = parsed(html)
    sizes = [0] * len(nodes)
    for b in blocks:
        sizes[b.node] += len(b.text)
    kept = _kept(nodes, _summed_up(nodes, sizes))
    blocks = [b for b in blocks if kept[b.node] == "yes" or (kept[b.node] == "headings" and nodes[b.node].tag in HEADINGS)]
    if not blocks:
        return ""
    page = _Scores(nodes, blocks)
    best = page.best()
    chosen = page.with_siblings(best, kept)
    taken, menu = [False] * len(nodes), [False] * len(nodes)
    for i, x in enumerate(nodes):
        taken[i] = i in chosen or (i > 0 and taken[x.parent])
        menu[i] = page.is_menu(i) or (i > 0 and menu[x.parent])
    return "\n\n".join(b.text for b in blocks if taken[b.node] and not menu[b.node])


class _Scores:
    """Points of the nodes of a page, from its blocks."""

    def __init__(self, nodes: list[Node], blocks: list[Block]) -> None:
        self.nodes = nodes
        n = len(nodes)
        size, linked, items, own, self.points = [0] * n, [0] * n, [0] * n, [0.0] * n, [0.0] * n
        box = [0] * n  # the container that is, or is next above, each node
        for i, x in enumerate(nodes[1:], 1):
            box[i] = i if x.tag in CONTAINERS else box[x.parent]
        for node, text, links in blocks:
            size[node] += len(text)
            linked[node] += links
            items[node] += 1
            worth = (len(text) / 100 + sum(map(text.count, COMMAS))) * (1 - min(links / len(text), 1.0))
            own[node] += worth
            at = box[nodes[node].parent if nodes[node].tag in PARAGRAPHS else node]
            for share in SHARES:
                self.points[at] += worth * share
                if at == 0:
                    break
                at = box[nodes[at].parent]
        self.size, self.linked, self.items, self.own = (_summed_up(nodes, v) for v in (size, linked, items, own))

    def density(self, i: int) -> float:
        return min(self.linked[i] / self.size[i], 1.0) if self.size[i] else 0.0

    def is_menu(self, i: int) -> bool:
        is_list = self.nodes[i].tag in ("ul", "ol")
        return is_list and self.items[i] >= MENU_ITEMS and self.density(i) >= MENU_DENSITY

    def best(self) -> int:
        """The container with most points; the article, or main part, around it where the page marks one."""
        best = max(range(len(self.nodes)), key=lambda i: (self.points[i] * (1 - self.density(i)), -i))
        above, at = [], best
        while at >= 0:
            above.append(at)
            at = self.nodes[at].parent
        for name in ("article", "main"):
            marked = [i for i in above if self.nodes[i].tag == name and not self.nodes[i].noise]
            if marked:
                return marked[-1]
        return best

    def with_siblings(self, best: int, kept: list[str]) -> set[int]:
        """The best container and those of its siblings that belong to it, or all that holds them."""
        up = self.nodes[best].parent
        siblings = [i for i, x in enumerate(self.nodes) if x.parent == up and kept[i] == "yes" and self.size[i]]
        if up < 0:
            return {best}
        chosen = {best}
        for i in siblings:
            worth = self.own[i] * (1 - self.density(i))
            if worth >= SIBLING_SHARE * self.own[best] > 0 or (self.nodes[i].tag == "p" and self.density(i) < 0.25):
                chosen.add(i)
        if sum(self.nodes[i].tag in CONTAINERS for i in chosen) > 2:
            return {up}  # parts of one whole
        following = False
        for i in reversed(siblings):  # headings stand before what they belong to
            if self.nodes[i].tag in HEADINGS and following and self.density(i) < 0.5:
                chosen.add(i)
            following = i in chosen
        return chosen


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page of (page_id, url, html).

    Elements for menus, headers (but for the headings of an article's own header), footers,
    sidebars, forms, scripts and styles are left out, as is what class, id or role name as
    such, as an advert, a notice or reader comments, what is hidden, and lists of links.  An
    element that holds all articles of a page isn't left out for its name.  Character references are decoded, white space in a block becomes one space, and
    blocks are joined by two line feeds; nothing is cut, however long a page is.
    A null or empty page, and one without text, gives an empty text.  A null page_id or url
    stays null.  Repeated rows give a row each, no rows give none; other columns, whatever
    their names, are left behind.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(html) if html else "" for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())],
                names=["page_id", "url", "text"],
            )

    wanted = small_batches(pages).select("page_id", "url", "html")
    schema = f"page_id {wanted.schema['page_id'].dataType.simpleString()}, url string, text string"
    return wanted.mapInArrow(extract, schema).withColumn("n_chars", F.length("text").cast("long"))
