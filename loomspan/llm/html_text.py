"""Main text of web pages by composite text density.

Every element gets a density: characters per tag, adjusted by its share of link text. Sums
of the children's densities pick the subtree; the least density on the path from it to the
body is the threshold that a wider subtree must meet (Sun, Song, Liao: DOM based content
extraction via text density, SIGIR 2011).

Defined cases: null or empty html gives an empty text; a page without a text gives an empty
one; class and id names are evidence alone (``weigh_marks``); unclosed or stray tags are closed or
ignored as browsers do; very long and very deep pages are read whole, in time that grows with their
length; of subtrees with equal sums the outer, earlier one counts; repeated rows each give a row; a null
page_id or url is carried; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import table

# Fixed values of HTML: elements by how their tags nest and whether their text is shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg object canvas select".split())
BLOCKS = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th pre "
    "blockquote figure figcaption header footer nav aside form fieldset address details summary hr center hgroup search dialog menu".split()
)
CLOSES_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
P_SCOPE = frozenset("p table td th button body html article section div".split())
HEADINGS = frozenset("h1 h2 h3 hgroup".split())
HEADS = HEADINGS | {"h4", "h5", "h6", "header"}
#: An opening tag ends an open element of these names, up to the given scope.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "option": ({"option"}, {"select"}),
}
#: Elements that are never part of an article's text.
OUTSIDE = frozenset("head nav footer aside form button menu dialog search label fieldset annotation annotation-xml".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar".split())
#: Words of class and id names that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar aside footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription "
    "signup login comment comments commentlist disqus respond reply replies discussion related recommended recommendations share sharing social "
    "toolbar pagination pager widget copyright disclaimer skip".split()
)
#: Marks that no share of the text outweighs; readers' comments and adverts are told beside any other words too.
NEVER = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies consent gdpr comment comments commentlist disqus".split())
BESIDE_ANY = frozenset("ad ads advert adverts advertisement comment comments commentlist disqus".split())
#: Beside these a mark tells of the page's state, not of a region: has-comments, comments-open.
STATES = frozenset("no not has with without open opened closed on off enabled disabled allow allowed count counter number".split())
#: A list of links with labels longer than this is no menu.
LABEL_CHARS = 25
#: Words that leave a mark's meaning as it is: comment-list, site-footer, relatedPosts.
NEUTRAL = frozenset(
    "list lists item items box bar block blocks area container wrapper wrap section inner outer widget panel site page main global top bottom left right header "
    "links link button buttons icons posts articles stories form primary secondary active js wp ui".split()
)
#: Marks that also name a part of an article; with a heading and running text they are one.
WEAK = frozenset("discussion related recommendation recommendations recommended copyright disclaimer notice notices alert promotion reply social".split())
KEEP = frozenset("html body main article".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
_RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
_ATTR = re.compile(r"([^\s\"'<>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("name", "children", "parent", "scope", "outside", "mark", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, name: str, parent: Node | None, outside: bool, mark: str = ""):
        self.name, self.parent, self.outside, self.mark = name, parent, outside, mark
        # The nearest element from here up that an open paragraph cannot reach beyond, or is one.
        self.scope: Node | None = self if name in P_SCOPE else parent.scope if parent else None
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _is_outside(name: str, attrs: str) -> bool:
    if name in OUTSIDE:
        return True
    if name in KEEP or not attrs:
        return False
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true":
            return True
        if key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|$|=|/)", attrs, re.I))


def _mark(attrs: str) -> str:
    """"never", "strong" or "weak" if a whole name of class or id is a mark, with neutral words at most; "never" for some beside others too."""
    found = ""
    for m in _ATTR.finditer(attrs) if attrs else ():
        if m[1].lower() in ("class", "id"):
            for name in (m[2] or m[3] or m[4] or "").split():
                parts = {x.lower() for x in _SPLIT.split(name) if len(x) > 1}
                marks = parts & MARKS
                if parts & STATES:
                    continue
                if parts & BESIDE_ANY or parts & NEVER and parts <= MARKS | NEUTRAL:
                    return "never"
                if marks and parts <= MARKS | NEUTRAL:
                    found = "strong" if not marks <= WEAK else found or "weak"
    return found


def weigh_marks(root: Node) -> None:
    """Puts outside what is marked, unless the mark is outweighed.

    A mark does not count on a node that holds the page's article or main element (itself in no
    article) or most of its text without links, as long as no other article or main stands outside
    of all marks; a weak one does not count on a part with its own heading and mostly running text.
    Comments, adverts and questions of consent stay outside whatever their share, unless they hold
    the article element.
    """
    order, stack, free, marked = [], [(root, False, False)], [], []
    while stack:
        node, below, linked = stack.pop()
        linked = linked or node.name == "a"
        order.append((node, linked))
        if node.name in ("article", "main"):
            if not below and not node.mark:
                free.append(node)
        elif node.mark and node.name not in KEEP:
            marked.append(node)
            below = True
        stack.extend((c, below, linked) for c in node.children if not isinstance(c, str) and not c.outside)
    if not marked:
        return
    own, links, inside = {}, {}, {}
    for node, linked in reversed(order):
        texts = sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        parts = [id(c) for c in node.children if not isinstance(c, str) and not c.outside]
        own[id(node)] = (0 if linked else texts) + sum(own[c] for c in parts)
        links[id(node)] = (texts if linked else 0) + sum(links[c] for c in parts)
        inside[id(node)] = node.name in ("article", "main") and not node.mark or any(inside[c] for c in parts)
    free = {id(a) for a in free if own[id(a)]}
    above: dict[int, int] = {}  # how many of them hold the node, itself included
    within: dict[int, bool] = {}  # whether an article element is among those
    for node, _ in order:
        above[id(node)] = above.get(id(node.parent), 0) + (id(node) in free)
        within[id(node)] = within.get(id(node.parent), False) or id(node) in free and node.name == "article"
    for node in marked:
        elsewhere = len(free) > above[id(node)]
        outweighed = not elsewhere and (inside[id(node)] and not within[id(node)] or node.mark != "never" and own[id(node)] * 2 > own[id(root)])
        titled = node.mark == "weak" and own[id(node)] > links[id(node)] and any(not isinstance(c, str) and c.name in HEADS for c in node.children) and any(not isinstance(c, str) and c.name not in HEADS and not c.outside and own[id(c)] for c in node.children)
        node.outside = not outweighed and not titled


def parse(page: str) -> Node:
    """The element tree; text pieces keep their place among the children."""
    root = Node("html", None, False)
    now, at, size = root, 0, len(page)
    open_names: Counter[str] = Counter()

    def close(outer: Node) -> Node:
        """Ends all open elements inside outer."""
        up = now
        while up is not outer:
            open_names[up.name] -= 1
            up = up.parent
        return outer

    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            now.children.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            now.children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        name = m["name"]
        if name is None:
            if m["cdata"]:
                now.children.append(m["cdata"])
            continue
        name = name.lower()
        if m["end"]:
            if open_names[name]:  # else a stray end tag, which is told without a look at the path
                up = now
                while up.name != name:
                    up = up.parent
                now = close(up.parent)
            continue
        if name in ("html", "body"):
            while now.parent is not None and now.name in ("head", "p", "title", "meta"):
                now = close(now.parent)
            if name == "html" or any(isinstance(c, Node) and c.name == "body" for c in root.children):
                continue
        if name in CLOSES_P:
            up = now.scope
            if up is not None and up.name == "p":
                now = close(up.parent)
        if name in ENDS and any(open_names[x] for x in ENDS[name][0]):
            ended, scope = ENDS[name]
            up, last = now, None
            while up is not None and up.name not in scope:
                if up.name in ended:
                    last = up
                up = up.parent
            if last is not None:
                now = close(last.parent)
        node = Node(name, now, _is_outside(name, m["attrs"]), _mark(m["attrs"]))
        now.children.append(node)
        if name in VOID or m["attrs"].endswith("/") and name not in BLOCKS:
            continue
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            node.outside = True
            at = size if end is None else page.find(">", end.end()) + 1 or size
            continue
        now = node
        open_names[name] += 1
    weigh_marks(root)
    return root


def _in_order(root: Node, use_marks: bool) -> list[Node]:
    """Shown elements, parents before children."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str) and not (c.outside and (use_marks or c.name in RAW or c.name in OUTSIDE)))
    return found


def measure(nodes: list[Node]) -> None:
    """Composite densities and their sums over the children."""
    shown = set(map(id, nodes))
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len("".join(c.split()))
            elif id(c) in shown:
                chars, tags, link_chars, link_tags = chars + c.chars, tags + c.tags + 1, link_chars + c.link_chars, link_tags + c.link_tags
        if node.name == "a":
            link_chars, link_tags = chars, tags + 1
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    whole = nodes[0]
    ratio = whole.link_chars / max(whole.chars, 1)
    for node in reversed(nodes):
        if node.chars:
            c, lc = node.chars, node.link_chars
            base = c / max(node.tags, 1)
            plain = max(c - lc, 1)
            log_base = math.log(c * lc / plain + ratio * c + math.e)
            inner = (c / max(lc, 1)) * (max(node.tags, 1) / max(node.link_tags, 1))
            node.density = base * max(0.0, math.log(max(inner, 1.0)) / log_base) if lc else base * (math.log(max(c * max(node.tags, 1), 1)) / log_base)
        text_here = any(isinstance(c, str) and c.strip() for c in node.children)
        node.total = sum(c.density for c in node.children if not isinstance(c, str) and id(c) in shown) + (node.density if text_here else 0.0)


def select(nodes: list[Node]) -> Node:
    """The subtree of the greatest sum; then the widest one above it that the path allows.

    The least density between it and the body is the threshold: an ancestor at least as
    dense whose other children are as dense, are its headings, or have a main heading of their own
    (a title and lead beside the text, a further section), takes its place.
    """
    best = max((n for n in nodes if n.chars), key=lambda n: n.total, default=nodes[0])
    if best.name in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "b", "i", "em", "strong", "span", "td", "blockquote", "pre", "a") and best.parent is not None:
        best = best.parent
    path, up = [], best
    while up is not None and up.name not in ("body", "html"):
        path.append(up)
        up = up.parent
    body = up if up is not None else nodes[0]
    threshold = min([n.density for n in [*path, body] if n.density > 0], default=0.0)
    chosen = best
    shown = set(map(id, nodes))
    headed: set[int] = set()
    for n in reversed(nodes):
        if n.name in ("h1", "h2") and n.chars or any(not isinstance(c, str) and id(c) in headed for c in n.children):
            headed.add(id(n))
    for node in path:
        rest = [
            c for c in node.children
            if not isinstance(c, str) and id(c) in shown and c is not chosen and c.chars and (c.density >= threshold or c.name in HEADINGS or id(c) in headed) and c.link_chars * 2 < c.chars
        ]
        if node is not best and rest:
            chosen = node
    for node in path:  # an article or main element is the author's own mark
        if node.name in ("article", "main"):
            chosen = node
            break
    return chosen


def _blocks(root: Node, use_marks: bool) -> list[str]:
    found: list[str] = []
    now: list[str] = []

    def end():
        if now:
            text = " ".join("".join(now).split())
            if text:
                found.append(text)
            now.clear()

    stack: list[Node | str | None] = [root]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        else:
            if x is not root and x.outside and (use_marks or x.name in RAW or x.name in OUTSIDE):
                continue
            if root.name in ("html", "body") and x is not root and x.name in ("ul", "dl", "div", "section", "table") and x.chars and x.link_chars * 10 > x.chars * 7 and x.link_chars <= LABEL_CHARS * x.link_tags:
                continue  # a menu, where no article was told from the page
            if x.name == "br":
                now.append("\n")
                continue
            if x.name in BLOCKS:
                end()
                stack.append(None)
            stack.extend(reversed(x.children))
    end()
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    for use_marks in (True, False):
        nodes = _in_order(root, use_marks)
        measure(nodes)
        if nodes[0].chars:
            return "\n\n".join(_blocks(select(nodes), use_marks))
    return ""


TEXTS = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; rows stay in their partitions."""
    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_extract, TEXTS)


def op7_text_density(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
