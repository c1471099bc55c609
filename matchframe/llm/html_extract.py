"""Main text of web pages by tree scoring.

Each paragraph gives points to its ancestors: one, one more per comma and per hundred characters (three at most);
the parent gets all of them, the grandparent half, further ones a third of their distance's share. The nearest
article or main element gets them whole, and a tenth more, and the distance counts anew from there. A container's
points are discounted by the share of its text that lies in links. The container with the best score is taken, with
those of its siblings that are headings or more text than links, or, where it is an article, the other articles.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out wherever
they stand: by element, role or hidden state, and by the first or last part of a class or id. As names can mislead
(`sidebar-right` for a layout), an element that holds most of the points stays where its going would leave the page
without paragraphs; a form that holds most of them (some sites wrap the page in one) stays in any case. Within an
article, words that also begin other names (`related-work`, `notice-board`) count only where the rest of the name is a
plain word for a container or a quarter of the text lies in links.

Null html gives an empty text. Rows are independent: repeated rows and repeated urls stay. An empty table gives
an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, parts_of, rows_of

#: Element names and class words, by their part in the method.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("head title script style noscript template iframe nav header footer aside select option textarea input dialog menu".split())
DROPPED_BLOCKS = frozenset("nav header footer aside form dialog menu".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLES = frozenset(("article", "main"))
#: The share of links under which an element is read as text.
READS = 0.25
CLOSES_ITEM = {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
NOISE = re.compile(
    r"(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner|sidebar|aside|widget\w*|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|notice|gdpr|alert|newsletter|subscribe|signup|popup|modal|overlay|share|sharing|social|related|recommended|footer|masthead|toolbar|pagination|pager|comments?|commentlist|replies|reply|respond|disqus|login|search)",
    re.I,
)
#: Words before a noise word that make it a flag of what holds it.
FLAGS = frozenset("has no with without show hide is not".split())
#: Noise words that also begin names of other things, and words for a container or its place.
BEGINNINGS = frozenset("related notice alert search share sharing comment comments reply replies menu social banner navigation recommended consent login header".split())
CONTAINERS = frozenset("area article articles bar block body box buttons card cards column container content copy feed form group icons inner inline item items left links list message module msg outer panel post posts region results right row section slot stories story text thread title top bottom tools unit wrap wrapper zone".split())
SITE_HEADER = re.compile(r"^(?:site-|page-|global-|main-|top-)?header$", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("children", "parent", "points", "tag")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent, self.children, self.points = tag, parent, [], 0.0


def _named_noise(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """What a class or id says by its first or last part: "noise", "maybe" or nothing."""
    if tag in ("body", "html", "article", "main"):
        named = tag == "article" and any(n in ("class", "id") and re.search(r"(?:^|\s)comments?(?:$|[\s_-])", v or "", re.I) for n, v in attrs)
        return "noise" if named else ""
    said = ""
    for name, value in attrs:
        for token in (value or "").split() if name in ("class", "id") else ():
            parts = re.split("[-_]+", token.strip("-_").lower())
            if SITE_HEADER.match(token) or len(parts) > 1 and parts[0] not in FLAGS and NOISE.fullmatch(parts[-1]):
                return "noise"
            if parts[0] == "skip" or NOISE.fullmatch(parts[0]):
                if parts[0] not in BEGINNINGS or all(p in CONTAINERS or p.isdigit() or NOISE.fullmatch(p) for p in parts[1:]):
                    return "noise"
                said = "maybe"
    return said


def _noise(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in DROPPED:
        return True
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value or ""):
            return True
        if name == "role" and value in ("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu"):
            return True
    return False


class Tree(HTMLParser):
    """Builds the tree without what is noise; unclosed elements end where a browser would end them."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("root", None)
        self.dropped: list[str] = []  # open elements inside noise, the outermost first
        self.named: dict[Node, str] = {}  # forms and noise by name, judged when the page is read

    def _pop_to(self, tag: str, bounds: tuple[str, ...]) -> None:
        node = self.at
        while node is not self.root and node.tag not in bounds:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.dropped:
            if tag not in VOID:
                self.dropped.append(tag)
            return
        if tag in BLOCKS or tag in DROPPED_BLOCKS:
            self._pop_to("p", ("td", "th", "li", "div", "section", "article", "main", "blockquote", "body", "table"))
        if tag in CLOSES_ITEM:
            self._pop_to(tag, CLOSES_ITEM[tag])
        if tag in ("br", "hr"):
            self.at.children.append(" ")
        if tag in VOID:
            return
        if tag == "body" or tag == "html":
            return
        if _noise(tag, attrs):
            self.dropped.append(tag)
            return
        node = Node(tag, self.at)
        self.at.children.append(node)
        self.at = node
        said = "form" if tag == "form" else _named_noise(tag, attrs)
        if said:
            self.named[node] = said

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and (self.dropped or self.at.tag == tag):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or tag in ("body", "html"):
            return
        if self.dropped:
            if tag in self.dropped:
                del self.dropped[len(self.dropped) - 1 - self.dropped[::-1].index(tag) :]
            elif tag in ("article", "main", "section", "div") and self._open(tag):
                self.dropped.clear()  # the noise was never closed, but what it stands in is
                self._pop_to(tag, ())
            return
        self._pop_to(tag, ())

    def _open(self, tag: str) -> bool:
        node = self.at
        while node is not self.root:
            if node.tag == tag:
                return True
            node = node.parent
        return False

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.at.children.append(data)


def _blocks(node: Node, without: Collection[Node] = ()) -> list[tuple[Node, str, int]]:
    """(block element, text, characters in links) in page order, without empty ones and what stands in the nodes of `without`."""
    out: list[tuple[Node, str, int]] = []
    pieces: list[str] = []
    linked = 0

    def flush(owner: Node) -> None:
        nonlocal linked
        text = _SPACE.sub(" ", "".join(pieces)).strip()
        if text:
            out.append((owner, text, linked))
        pieces.clear()
        linked = 0

    stack: list[tuple[Node, int, Node, bool]] = [(node, 0, node, False)]
    while stack:
        at, k, owner, in_link = stack.pop()
        if k == 0 and at.tag in BLOCKS:
            flush(stack[-1][2] if stack else owner)
        if k < len(at.children):
            stack.append((at, k + 1, owner, in_link))
            child = at.children[k]
            if isinstance(child, str):
                pieces.append(child)
                if in_link:
                    linked += len(child.strip())
            elif child in without:
                if child.tag in BLOCKS:
                    flush(owner)
            else:
                stack.append((child, 0, child if child.tag in BLOCKS else owner, in_link or child.tag == "a"))
        elif at.tag in BLOCKS or at is node:
            flush(owner)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    blocks = _blocks(tree.root)
    without = _unwanted(blocks, tree.named)
    if without:
        blocks = _blocks(tree.root, without)
    if not blocks:
        return ""
    best, score, link_share = _scored(blocks)
    kept = [best]
    if best.parent is not None:
        near = [c for c in best.parent.children if isinstance(c, Node) and c in link_share]
        if best.tag in ARTICLES:
            kept = [c for c in near if c is best or c.tag == best.tag and link_share[c] < READS]
        else:
            kept = [c for c in near if c is best or c.tag in HEADINGS or link_share[c] < READS]
    return "\n".join(text for n in kept for _, text, _ in _blocks(n, without))


def points_of(owner: Node, text: str) -> float:
    return 0.0 if owner.tag in HEADINGS else 1.0 + text.count(",") + min(len(text) // 100, 3)


def _within_article(node: Node) -> bool:
    while node is not None and node.tag not in ARTICLES:
        node = node.parent
    return node is not None


def _unwanted(blocks: list[tuple[Node, str, int]], named: dict[Node, str]) -> set[Node]:
    """Of the forms and the nodes that are noise by name, those that go."""
    maybe = {n for n, said in named.items() if said == "maybe" and _within_article(n)}
    sizes = {n: [0, 0] for n in maybe}
    for owner, text, linked in blocks if maybe else ():
        node: Node | None = owner
        while node is not None:
            if node in sizes:
                sizes[node][0] += len(text)
                sizes[node][1] += linked
            node = node.parent
    judged = {n for n in named if n not in maybe or sizes[n][1] >= READS * max(sizes[n][0], 1)}
    if not judged:
        return judged
    held, total, outside = dict.fromkeys(judged, 0.0), 0.0, 0.0
    for owner, text, _ in blocks:
        points, free, node = points_of(owner, text), True, owner
        while node is not None:
            if node in held:
                held[node] += points
                free = False
            node = node.parent
        total += points
        outside += points * free
    forms = {n for n in judged if named[n] == "form" and held[n] > total / 2}
    if forms:  # the page is in the form: what is noise within or beside it is judged by itself
        return {n for n in judged if held[n] <= total / 2}
    return judged if outside else {n for n in judged if held[n] <= total / 2}


def _scored(blocks: list[tuple[Node, str, int]]) -> tuple[Node, dict[Node, float], dict[Node, float]]:
    """The best container, and the score and the share of links of every container."""
    sizes: dict[Node, list[int]] = {}
    for owner, text, linked in blocks:
        points = points_of(owner, text)
        node = (owner.parent or owner) if owner.tag in ("p", "pre", "td", "li", "dd", "blockquote") or owner.tag in HEADINGS else owner
        level, inside = 0, True
        if node is not owner:
            held = sizes.setdefault(owner, [0, 0])
            held[0] += len(text)
            held[1] += linked
        while node is not None:
            if inside and node.tag in ARTICLES:
                node.points += 1.1 * points
                level, inside = 0, False
            else:
                node.points += points if level == 0 else points / 2 if level == 1 else points / (3 * level)
            held = sizes.setdefault(node, [0, 0])
            held[0] += len(text)
            held[1] += linked
            node, level = node.parent, level + 1
    link_share = {n: linked / max(size, 1) for n, (size, linked) in sizes.items()}
    score = {n: n.points * (1 - link_share[n]) for n in sizes}
    return max(score, key=lambda n: (score[n], n.tag in ARTICLES, -len(n.children))), score, link_share


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars."""

    bounded_batches(pages.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, urls, htmls in rows_of(parts_of(batches, 2)):
            texts = [main_text(h) for h in htmls]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(urls, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col)).mapInArrow(run, "page_id long, url string, text string, n_chars long")
