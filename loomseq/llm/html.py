"""Main text of web pages by tree scoring.

A page becomes a tree; elements that are never content go with all they hold. Each paragraph-like
block earns points for its length and commas and hands them to its parent, half to the grandparent
and a third above; a container's points are discounted by the share of its text that is inside
links, and raised a little for article and main. The best container, or the article element around it, is
kept. Then every container around it is looked at, up to the page's body: branches beside the one that leads to
the best and whose blocks earn at least STRONG of what is kept so far are kept as well, or which are the same kind of
piece (element and class) with unlinked text, and the prose and headings between them; so an article in rows, columns or sections, each in wrappers of its own, comes out whole. Beside an
article element only other article elements are, or what earns more than it does. Ties go to the container that
ends first.

Marks in class, id and role count by where they stand. Outside an article element one telling word
removes a container; inside, and for paragraphs, headings and list items anywhere, all words of a mark
must be telling or neutral ("comment-list", not "ad-hoc-methods" or "side-note"). Words that articles use
themselves (DOUBTFUL, and within an article WIDGETS) remove a container only where it holds no prose. Boxes that are nearly all links
go, but not numbered lists and those under a heading in an article element: these are its references.

Character references are decoded, white space inside a block becomes one blank, and blocks are
joined by one newline in page order. Null and empty pages give the empty text; broken mark-up never
fails, and work grows in proportion to the page whatever its nesting. An unclosed quote ends at the next
angle bracket, a comment or script that isn't closed at the page's end. Rows that repeat are extracted
each; extra columns are ignored, an empty table gives an empty one, and pages are read whole.
"""

from __future__ import annotations

import gc
import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from loomseq.llm.common import map_batches, texts_of

#: Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
GONE = frozenset("script style textarea title noscript iframe xmp noframes template head nav footer aside form button select option input svg canvas object audio video dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SCORED = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6 figcaption".split())
CLOSED_BY = {  # an open element of the key ends where one of these starts
    "p": BLOCKS - {"body", "html", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "dd", "dt"},
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"},
}
CLOSES = {name: [k for k, by in CLOSED_BY.items() if name in by] for name in frozenset().union(*CLOSED_BY.values())}
LIMITS = frozenset("table td th ul ol dl article section div main body html blockquote".split())
HEADINGS = frozenset("h2 h3 h4 h5 h6".split())
#: Words in class, id or role that mark what isn't the article.
TELLING = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial adsense sponsor sponsored promo promotion banner nav navbar navigation "
    "menu breadcrumb breadcrumbs masthead footer sidebar notice notices cookie cookies consent gdpr "
    "alert popup modal overlay newsletter subscribe subscription signup login comment comments commentlist disqus replies reply "
    "share sharing pagination pager toolbar paywall contentinfo".split()
)
#: Such words that name controls, in which an article's own prose may stand all the same.
WIDGETS = frozenset("share sharing toolbar pagination pager banner masthead menu breadcrumb breadcrumbs".split())
#: Such words that articles use for parts of their own, too.
DOUBTFUL = frozenset("header foot aside rail widget discussion respond social related recommended recommendations trending search complementary hidden side responses disclaimer copyright skip".split())
#: Words that may stand beside telling ones in a mark.
NEUTRAL = frozenset(
    "box block container wrapper wrap section area list panel slot unit bar row top bottom left right inline links link form thread item items body text main inner outer "
    "content module group button buttons icons post article entry page site user reader author the of for in on left right small large sticky fixed primary secondary".split()
)
#: Words that turn such a mark into a remark about the layout, as in "no-sidebar".
LAYOUT = frozenset("has no with without".split())
#: Whole classes that make an article element something else.
NOT_ARTICLE = frozenset("comment reply response ad ads advert advertisement promo sponsored teaser related".split())
_QUOTED = re.compile(r"</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"(?<![^\s\"'/])([a-zA-Z-]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Unlinked characters that make a block prose, and the gain of elements that name the article.
PROSE, GAIN = 80, {"article": 1.2, "main": 1.1}
#: Points of a branch beside the best container, at least, and its share of what is kept so far.
LEAST, STRONG = 10.0, 0.2


class Node:
    __slots__ = ("name", "parent", "kids", "attrs", "points", "chars", "linked", "commas", "links", "prose", "stays", "mass")

    def __init__(self, name, parent, attrs=None):
        self.name, self.parent, self.attrs = name, parent, attrs or {}
        self.kids: list = []
        self.points = self.mass = 0.0
        self.chars = self.linked = self.commas = self.links = self.prose = 0
        self.stays = False


class Open:
    """The open elements, and where in them each name and each limit stands."""

    def __init__(self, root: Node):
        self.nodes, self.of, self.limits = [root], {}, [0]

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.of.setdefault(node.name, []).append(at)
        if node.name in LIMITS:
            self.limits.append(at)

    def last(self, name: str) -> int:
        at = self.of.get(name)
        return at[-1] if at else 0

    def cut(self, upto: int) -> None:
        """End all elements from this place on."""
        while len(self.nodes) > upto:
            self.of[self.nodes.pop().name].pop()
        while self.limits[-1] >= upto:
            self.limits.pop()


def tag_end(page: str, at: int, quoted: bool) -> tuple[int, bool]:
    """The end of the tag at this place, or 0, and whether quotes still count: once a quote swallows the
    rest of the page, tags end at the next angle bracket."""
    if quoted:
        m = _QUOTED.match(page, at)
        if m:
            return m.end(), True
    return page.find(">", at) + 1, False


def parse(page: str) -> Node:
    """A forgiving tree: unknown ends are dropped, open elements end with their parents."""
    root = Node("#root", None)
    opened, at, seen, quoted, n = Open(root), 0, 0, True, len(page)
    while True:
        start = page.find("<", seen)
        if start < 0 or start + 1 >= n:
            break
        sign = page[start + 1]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4) + 3
            end = n if end < 3 else end
        elif sign in "!?":
            end = page.find(">", start) + 1
        elif sign.isascii() and (sign.isalpha() or sign == "/" and page[start + 2 : start + 3].isascii() and page[start + 2 : start + 3].isalpha()):
            end, quoted = tag_end(page, start, quoted)
        else:
            seen = start + 1
            continue
        if not end:  # no angle bracket follows: the rest is text
            break
        here = opened.nodes[-1]
        if start > at:
            here.kids.append(page[at:start])
        token = page[start:end]
        at = seen = end
        if sign in "!?":
            continue
        named = _NAME.match(token)
        name = named.group(1).lower()
        if sign == "/":
            place = opened.last(name)
            if place and (name in BLOCKS or place >= opened.limits[-1]):  # an inline end doesn't close a container
                opened.cut(place)
            continue
        if name in CLOSES:
            place = max(opened.last(k) for k in CLOSES[name])
            if place and place >= opened.limits[-1]:
                opened.cut(place)
                here = opened.nodes[-1]
        rest = named.end()
        attrs = {}
        if end - start - rest > 1:
            for a, b, c, d in _ATTR.findall(token[:-1], rest):
                attrs.setdefault(a.lower(), b or c or d or "")
        node = Node(name, here, attrs)
        here.kids.append(node)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
            node.kids.append(page[at : close.start() if close else n])
            at = page.find(">", close.end()) + 1 if close else n
            at = seen = at or n
        elif name not in VOID and not token.endswith("/>"):
            opened.push(node)
    if at < n:
        opened.nodes[-1].kids.append(page[at:])
    return root


def mark(node: Node, in_article: bool) -> str | None:
    """"gone" or "doubtful" by the element's name and marks."""
    attrs = node.attrs
    if node.name in GONE or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return "gone"
    if node.name == "header":
        return None if in_article else "gone"
    if not attrs or node.name in ("html", "body", "h1"):
        return None
    if node.name in ("article", "main"):
        return None if NOT_ARTICLE.isdisjoint(attrs.get("class", "").lower().split()) else "gone"
    style = attrs.get("style", "").replace(" ", "").lower()
    if "display:none" in style or "visibility:hidden" in style:
        return "gone"
    strict, found = in_article or node.name in SCORED, None
    for m in " ".join(attrs.get(a, "") for a in ("class", "id", "role", "aria-label")).split():
        words = {w.lower() for w in _WORDS.findall(m)}
        if not LAYOUT.isdisjoint(words):
            continue
        telling = words & TELLING
        if telling and (not strict or words <= TELLING | DOUBTFUL | NEUTRAL):
            if not in_article or not telling <= WIDGETS or node.name in SCORED:
                return "gone"
            found = "doubtful"
        if node.name not in SCORED and not DOUBTFUL.isdisjoint(words) and (not strict or words <= DOUBTFUL | NEUTRAL):
            found = "doubtful"
    return found


def prune(root: Node) -> None:
    """Drop unwanted elements; count text, linked text, commas, links and prose of the others."""
    stack, order = [(root, False, False)], []
    doubtful: set[int] = set()
    while stack:
        node, article, link = stack.pop()
        link = link or node.name == "a"
        article = article or node.name == "article"
        order.append((node, link))
        kids, before = [], ""
        for k in node.kids:
            if not isinstance(k, str):
                k.stays = node.stays or article and (k.name in ("ol", "dl") or before in HEADINGS)
                before = k.name
                m = mark(k, article)
                if m == "gone":
                    continue
                if m:
                    doubtful.add(id(k))
                stack.append((k, article, link))
            kids.append(k)
        node.kids = kids
    for node, link in reversed(order):
        kept = []
        for k in node.kids:
            if isinstance(k, str):
                n = len(k.strip())
                node.chars += n
                node.linked += n if link else 0
                node.commas += k.count(",")
            elif id(k) in doubtful and (not k.prose or density(k) > 0.5):
                continue
            else:
                node.chars += k.chars
                node.linked += k.linked
                node.commas += k.commas
                node.links += k.links + (k.name == "a")
                node.prose += k.prose
            kept.append(k)
        node.kids = kept
        node.prose += node.name in SCORED and not node.prose and node.chars - node.linked >= PROSE


def density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def score(root: Node) -> list[Node]:
    """Containers with points, each block's handed upwards."""
    found: dict[int, Node] = {}
    stack, order = [root], []
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in node.kids if not isinstance(k, str)]
        if node.name in SCORED:
            size, commas, up = node.chars, node.commas, node.parent
        elif node.name in ("div", "section", "article", "main", "body"):
            own = [k for k in node.kids if isinstance(k, str)]
            size, commas, up = sum(len(k.strip()) for k in own), sum(k.count(",") for k in own), node
        else:
            continue
        if not size:
            continue
        points, share = (1.0 + commas + min(size / 100.0, 3.0)) * (1.0 - density(node)), 1
        node.mass += points
        while up is not None and share <= 4:
            up.points += points / share
            found[id(up)] = up
            up, share = up.parent, share + 1
    for node in reversed(order):
        if node.parent is not None:
            node.parent.mass += node.mass
    for node in found.values():
        node.points *= GAIN.get(node.name, 1.0) * (1.0 - density(node))
    return list(found.values())


LINK_BOXES = frozenset("ul ol dl table div section".split())


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks in page order."""
    out: list[str] = []
    parts: list[str] = []

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(nodes))
    while stack:
        k = stack.pop()
        if k is None:
            flush()
        elif isinstance(k, str):
            parts.append(k)
        elif k.name == "br":
            parts.append(" ")
        elif k.name in BLOCKS:
            flush()
            if k.name in LINK_BOXES and not k.stays and density(k) > 0.8 and k.links > 1:
                continue
            stack.append(None)
            stack += reversed(k.kids)
        else:
            stack += reversed(k.kids)
    flush()
    return out


def extract(page: str) -> str:
    """The main text; without any container that scores, all text that is left after pruning."""
    on = gc.isenabled()
    gc.disable()  # a page's tree is alive until its end, and looking for garbage in it costs more than making it
    try:
        return main_blocks(parse(page))
    finally:
        if on:
            gc.enable()


def main_blocks(root: Node) -> str:
    prune(root)
    named = score(root)
    if not named:
        return "\n".join(blocks([root]))
    best = max(named, key=lambda n: n.points)
    up = best
    while up is not None and up.name != "article":
        up = up.parent
    best = up or best  # a part of an article stands for all of it
    keep, mass, branch = [best], best.mass, best
    while branch.parent is not None and branch.name not in ("body", "html"):
        around = branch.parent
        others = {id(k) for k in around.kids if not isinstance(k, str) and k is not branch and strong(k, best, mass)}
        alike = {id(k) for k in around.kids if not isinstance(k, str) and k is not branch and best.name != "article" and shaped(k, branch)}
        if others or alike or around is best.parent and best.name not in ("article", "main"):
            others |= alike
            new = []
            for k in around.kids:
                if k is branch:
                    new += keep
                elif not isinstance(k, str) and (id(k) in others or best.name != "article" and beside(k)):
                    new.append(k)
                    mass += k.mass
            keep = new
        branch = around
    return "\n".join(blocks(keep))


def strong(k: Node, best: Node, mass: float) -> bool:
    """A branch that is as much the article as what is kept."""
    if best.name == "article" and k.name != "article":
        return k.mass > mass and density(k) < 0.5
    least = LEAST / 2 if best.name == "article" else LEAST  # the element says that it is one
    return k.mass * (1.0 - density(k)) >= max(least, STRONG * mass)


def shaped(k: Node, branch: Node) -> bool:
    """A piece like the one that holds the best container, with text that isn't linked: the same element and class."""
    named = k.attrs.get("class")
    same = k.name == branch.name and named == branch.attrs.get("class")
    return same and (named or k.name == "section" or k.prose > 0) and k.name in ("div", "section", "p", "blockquote") and k.mass > 0 and density(k) < 0.25


def beside(k: Node) -> bool:
    """Prose or a heading of the article, by itself."""
    if k.name == "p":
        return k.chars > PROSE and density(k) < 0.25 or k.chars > 0 and not k.linked
    return k.name in ("h1", "h2") and density(k) < 0.25


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""

    def run(b: pa.RecordBatch):
        out = [extract(t.decode("utf-8", "replace")) for t in texts_of(b, "html")]
        return {"page_id": b.column("page_id"), "url": b.column("url"), "text": out, "n_chars": [len(t) for t in out]}

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
