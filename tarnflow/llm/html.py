"""Main text of web pages by composite text density.

Each DOM node gets the characters per tag below it, lowered where links hold them; a node's density sum
adds up its children's densities. The subtree with the largest sum is the article's body. The least
density on the way from there up to <body> is the page's threshold: siblings along that way that reach it
(a headline beside the body) belong to the article too. What a page's author marks as something else -
menus, headers, footers, sidebars, notices, adverts, forms, comments - is left out before, unless it
is or holds an article, a main part, a headline or most of the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.llm.tables import table

#: Elements without text of the article.
DROPPED = frozenset(
    "head title script style noscript template nav footer button select option textarea input label iframe object embed "
    "applet svg canvas audio video map menu dialog frameset noframes datalist".split()
)
RAW = frozenset("script style textarea title noscript iframe noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these open elements, as far up as the given bounds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Words in class or id, and roles, of what is not the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices "
    "alert nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager sidebar aside rail widget widgets footer masthead topbar toolbar "
    "comment comments commentlist respond replies reply disqus discussion share sharing social related recommended recommendations subscribe subscription "
    "newsletter signup login popup modal overlay paywall disclaimer skip search searchform complementary contentinfo dialog form".split()
)
COMMENTS = frozenset("comment comments commentlist reply replies".split())
#: Elements that are marked by their name: they can be a page's frame as well as a part beside the text.
FRAMES = frozenset("form fieldset aside header".split())
#: Articles below these are not the page's own.
OTHERS = COMMENTS | frozenset("related recommended recommendations".split())
#: Marks that also name parts of a text: they count as whole names only, and not within an article.
AMBIGUOUS = frozenset("notice notices alert discussion disclaimer consent gdpr form search skip rail promotion banner dialog".split())
#: Names that tell a state of an element or what else the page has.
STATE = re.compile(r"(?:has|have|no|not|non|with|without|is|hide|show|enable|disable|supports|allow|can)[-_].*|.*[-_](?:open|opened|closed|enabled|disabled|active|inactive|visible|on|off|true|false)")
WHOLE = frozenset("html body main".split())
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
#: The rest of a tag: quoted values may hold its end sign.
REST = re.compile(r"""((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


class Node:
    __slots__ = ("tag", "parent", "inside", "chars", "tags", "link_chars", "link_tags", "density", "total", "marks", "within")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent = tag, parent
        self.inside: list[Node | str] = []
        self.marks: frozenset[str] = frozenset()
        self.within: bool = tag in ("article", "main") or parent is not None and parent.within
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def marks_of(attributes: str, marks: frozenset[str], within: bool) -> frozenset[str] | None:
    """Those of the marks that class, id and role hold; None if the element is hidden. Within an article ambiguous ones don't count."""
    if "=" not in attributes and "hidden" not in attributes.lower():
        return frozenset()
    found = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value.strip() == "true" or name == "style" and HIDDEN.search(value):
            return None
        if name in ("class", "id", "role"):
            for x in value.split():
                if not STATE.fullmatch(x):
                    found.update(w for w in re.split(r"[^a-z]+", x) if w in marks and (w not in AMBIGUOUS or w == x and not within))
    return frozenset(found)


def pieces_of(page: str) -> Iterator[tuple[str, str, str, int]]:
    """(text before, name, attributes, end) of each tag, names of closing tags behind a slash; comments and declarations have no name. The last one is the text behind all tags.

    Each place is looked at a bounded number of times: a tag without an end sign behind it is text.
    """
    pos = at = 0
    last = page.rfind(">")
    end = len(page)
    while 0 <= (start := page.find("<", at)):
        if page.startswith("<!--", start):
            stop = page.find("-->", start + 4)
            stop = end if stop < 0 else stop + 3
            yield page[pos:start], "", "", stop
        elif start > last:
            break
        elif page[start + 1 : start + 2] in ("!", "?"):
            stop = page.find(">", start) + 1
            yield page[pos:start], "", "", stop
        elif m := NAME.match(page, start + 1):
            rest = REST.match(page, m.end())
            stop = rest.end() if rest else page.find(">", m.end()) + 1
            yield page[pos:start], (m[1] + m[2]).lower(), rest[1] if rest else page[m.end() : stop - 1], stop
            name = m[2].lower()
            if name in RAW and not m[1]:
                # What such an element holds is no markup; its closing tag ends it.
                close = re.compile(f"</{name}", re.I).search(page, stop)
                stop = (page.find(">", close.start()) + 1 or end) if close else end
        else:
            at = start + 1
            continue
        pos = at = stop
    yield page[pos:], "", "", end


def tree(page: str) -> Node:
    """The page's elements without those that are dropped or hidden, each with its marks. Text pieces stand decoded between them."""
    root = at = Node("#root", None)
    skipped: list[str] = []  # the open elements from one that is left out
    inside: Counter[str] = Counter()  # their number by name
    opened: Counter[str] = Counter()  # number of open elements by name

    def up_to(node: Node) -> None:
        """Closes elements until the node is the innermost open one."""
        nonlocal at
        while at is not node:
            opened[at.tag] -= 1
            at = at.parent

    for text, name, attributes, _ in pieces_of(page):
        if text and not skipped:
            at.inside.append(html.unescape(text))
        if not name:
            continue
        if name[0] == "/":
            name = name[1:]
            if skipped:
                if inside[name]:
                    while (popped := skipped.pop()) != name:
                        inside[popped] -= 1
                    inside[name] -= 1
                elif name in WHOLE or name == "article":  # what was left open ends here
                    if opened[name]:
                        skipped, inside = [], Counter()
                        while at.tag != name:
                            up_to(at.parent)
                        up_to(at.parent)
                continue
            if opened[name]:
                while at.tag != name:
                    up_to(at.parent)
                up_to(at.parent)
            elif name in ("p", "br"):
                at.inside.append(Node(name, at))
            continue
        if name in RAW:
            continue
        if skipped:
            if name not in VOID and not attributes.endswith("/"):
                skipped.append(name)
                inside[name] += 1
            continue
        if name in VOID:
            if name in ("br", "hr"):
                at.inside.append(Node(name, at))
            continue
        if name in CLOSES:
            ends, bounds = CLOSES[name]
            if left := sum(opened[x] for x in ends):
                up, to = at, None
                while left and up is not root and up.tag not in bounds:
                    if up.tag in ends:
                        to, left = up.parent, left - 1
                    up = up.parent
                if to is not None:
                    up_to(to)
        elif name in BLOCKS and opened["p"]:
            up = at
            while up is not root and up.tag not in BLOCKS:
                up = up.parent
            if up.tag == "p":
                up_to(up.parent)
        marks = frozenset() if name in WHOLE else marks_of(attributes, COMMENTS if name == "article" else MARKS, at.within)
        if marks is not None and name in FRAMES and not (name == "header" and at.within):
            marks |= {name}
        if name in DROPPED or marks is None:
            if name != "head":
                skipped, inside = [name], Counter([name])
            continue
        child = Node(name, at)
        child.marks = marks
        at.inside.append(child)
        if not attributes.endswith("/") or name in BLOCKS:
            opened[name] += 1
            at = child
    return root


def _order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in node.inside if isinstance(x, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Sets the counts, densities and density sums of all nodes; the nodes, parents first."""
    nodes = _order(root)
    for node in nodes:
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = 0.0
    for node in reversed(nodes):
        node.chars += sum(len(x.strip()) for x in node.inside if isinstance(x, str))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    ratio = root.link_chars / max(root.chars, 1)
    for node in nodes:
        chars, tags, linked, links = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if chars:
            base = math.log(chars * linked / max(chars - node.link_chars, 1) + ratio * chars + math.e)
            # Where links hold a small share of characters and tags, the logarithm's value is over 1 and lifts the density.
            node.density = max(0.0, chars / tags * math.log(max(chars / linked * tags / links, 1.0)) / base)
    for node in nodes:
        node.total = sum(x.density for x in node.inside if isinstance(x, Node))
        if not any(isinstance(x, Node) for x in node.inside):
            node.total = node.density
    return nodes


def without_marked(root: Node) -> None:
    """Takes marked elements out, but for those that are or hold the page's article, main part or headline, or most of its unlinked text.

    A header outside the article isn't kept for a headline, which may be the site's. Articles of comments and of related pages are not the page's. If nothing would be left, nothing is taken out.
    """
    nodes = measure(root)
    if not any(n.marks for n in nodes):
        return
    text = root.chars - root.link_chars
    own: set[int] = set()  # nodes that are or hold a main part or a headline
    articles: set[int] = set()
    for node in reversed(nodes):
        if node.tag in ("main", "h1") and node.chars:
            own.add(id(node))
        if node.tag == "article" and not node.marks and node.chars:
            articles.add(id(node))
        if node.parent is not None:
            if id(node) in own:
                own.add(id(node.parent))
            if id(node) in articles and node.marks.isdisjoint(OTHERS):
                articles.add(id(node.parent))

    def stays(n: Node) -> bool:
        if not n.marks or id(n) in own and "header" not in n.marks or n.marks.isdisjoint(OTHERS) and id(n) in articles:
            return True
        return n.marks.isdisjoint(COMMENTS) and (n.chars - n.link_chars) * 2 > text

    before = [(n, n.inside) for n in nodes]
    for node in nodes:
        node.inside = [x for x in node.inside if isinstance(x, str) or stays(x)]
    if text and not any(x.strip() for n in _order(root) for x in n.inside if isinstance(x, str)):
        for node, inside in before:
            node.inside = inside


def article(root: Node) -> list[Node]:
    """The nodes whose text is the article, in page order."""
    without_marked(root)
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    inner = _order(body)
    best = max(inner, key=lambda n: n.total)  # the outermost of equal ones
    # Paragraphs of which one is long, or holds markup: the text around belongs with it.
    while best.parent is not None and best is not body and best.tag in INNER:
        best = best.parent
    way, node = [], best
    while node is not None and node is not body:
        way.append(node)
        node = node.parent
    threshold = min([body.density, *(n.density for n in way)])
    # The outermost article or main part around the body is whole; else the way starts at the body itself.
    first = max((i for i, n in enumerate(way) if n.tag in ("article", "main")), default=0)
    kept = [way[first] if way else best]
    for node in way[first:]:
        if node.parent is not None:
            for x in node.parent.inside:
                if isinstance(x, Node) and x is not node and (x.density >= threshold or x.tag == "article") and x.chars and x.link_chars * 2 < x.chars:
                    kept.append(x)
    place = {id(n): i for i, n in enumerate(_page_order(body))}
    return sorted(kept, key=lambda n: place[id(n)])


#: Elements that are part of a text, never the whole of it.
INNER = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong span a u s small big code sub sup q cite abbr mark font li dt dd tr td th tbody thead blockquote pre br".split())


def _page_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [x for x in reversed(node.inside) if isinstance(x, Node)]
    return out


def blocks(node: Node) -> list[str]:
    """Texts of a node's blocks; white space is one space."""
    out, now = [], []

    def close() -> None:
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            now.append(x)
        elif x.tag == "br":
            now.append(" ")
        else:
            if x.tag in BLOCKS:
                close()
                stack.append(None)
            stack += reversed(x.inside)
    close()
    return out


def main_text(page: str | None) -> str:
    """The article's blocks, joined by empty lines; an empty string if there is none."""
    return "\n\n".join(b for n in article(tree(page)) for b in blocks(n)) if page else ""


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """df without the html, with text and n_chars (code points).

    A null or empty page, or one without text of an article, has an empty text. Repeated rows are repeated;
    columns named text or n_chars are replaced; a table without rows gives none.
    """
    rest = [c for c in df.columns if c not in (html_col, "text", "n_chars")]
    read = df.select(*rest, F.col(html_col).alias("html"))
    schema = df.select(*rest, F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([*map(part.column, rest), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*rest, "text", "n_chars"])

    return read.mapInArrow(run, schema)


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
