"""HTML extraction by tree scoring.

The page becomes a tree (end tags that HTML leaves out are implied). Elements whose tag or attributes take them off
the article -- menus, page headers, footers, asides, forms, scripts, hidden parts -- go. Class, id and role names
(sidebar, comments, cookie notice, advert ...) are evidence only, and a name of state ("has-sidebar", "no-comments")
is none: an article or main element never goes by its name; another element so named goes if an article or main
element holds real text outside such elements (beside it: any text of a twentieth of its own), or if it holds a third
of the page's text at most (names of reader comments and notices: four fifths); else it stays, at half its points. Each paragraph passes points for its length and commas to the
elements above it (whole to the parent, half to the next, less further up); a container's points are discounted by
the share of its text that stands in links. The best container is kept with its siblings of any kind and length,
unless a quarter of their text or more stands in links and their points are few. From there on up to the article or main
element around it, or else the body, what stands beside is kept as well if few links and comparable points (or, in an
article or main element, any text) tell that it belongs to the article: other columns, parts in wrappers of their own. A
button or label in the middle of a paragraph's sentence is prose. The text is that of the kept elements in page order: references decoded, white space inside a block (any Unicode white space, no-break spaces
included) made one space, blocks joined by one space; nothing is capped.

Defined results: null or empty html, or a page without text outside the removed parts, gives empty text; a page cut
off anywhere is read as far as it goes; repeated rows give repeated results; an empty table gives an empty one; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import col, only, slices

# Element names of HTML by role, and words of class, id and role that name a removed part.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
GONE = frozenset(
    "script style noscript template head title nav footer aside form button select textarea input iframe object "
    "embed svg canvas video audio map dialog menu label fieldset option datalist".split()
)
INLINE = frozenset(("button", "label"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("td th tr tbody thead tfoot body html".split())
PARAGRAPHS = frozenset("p pre blockquote td li dd figcaption h1 h2 h3 h4 h5 h6".split())
NEGATIVE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner breadcrumb breadcrumbs "
    "comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert "
    "footer header masthead menu nav navbar navigation navigate pagination pager popup modal overlay newsletter "
    "subscribe subscription signup login related recommended recommendations share sharing social sidebar sidebars "
    "widget widgets toolbar search complementary contentinfo skip tags outbrain taboola hidden feedback".split()
)
FIRM = frozenset("comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices".split())
STATE = frozenset("has no not with without show hide enable disable".split())
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


#: Text of an article or main element, in characters, from which it is taken for the article; how many times its text a
#: named element beside it may hold and go; nested named elements that :func:`judge` looks into (deeper names do not count);
#: characters of a paragraph, and share of the best points, from which a block further off belongs to the article.
REAL, BESIDE, ROUNDS, FAR, COMPARABLE = 140, 20, 50, 80, 0.1


class Node:
    __slots__ = ("tag", "parent", "kids", "dropped", "named", "firm", "weight", "length", "linked", "clean", "commas", "score", "solid")

    def __init__(self, tag: str, parent: Node | None, dropped: bool, names: set[str]):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.named, self.firm, self.weight = bool(names), bool(names & FIRM), 1.0
        self.kids: list[Node | str] = []
        self.length = self.linked = self.clean = self.commas = 0
        self.score = 0.0
        self.solid = False


def _hidden(attrs: list[tuple[str, str | None]]) -> bool:
    return any(n == "hidden" or n == "aria-hidden" and v == "true" or n == "style" and v and _INVISIBLE.search(v) for n, v in attrs)


def _names(attrs: list[tuple[str, str | None]]) -> set[str]:
    """Words of class, id and role that speak against the element, without names of state."""
    found: set[str] = set()
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            for token in value.split():
                parts = [w.lower() for w in _WORDS.findall(token)]
                if parts and parts[0] not in STATE:
                    found.update(NEGATIVE.intersection(parts))
    return found


class Tree(HTMLParser):
    """Builds the tree while the page is read."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html", None, False, set())
        self.nodes: list[Node] = [self.root]
        self.controls: list[Node] = []
        self.open: dict[str, int] = {"html": 1}

    def _close(self, stop: Node) -> None:
        """Close the open elements up to and with ``stop``."""
        while True:
            node = self.at
            self.open[node.tag] -= 1
            if node.parent is None:
                self.open[node.tag] += 1
                return
            self.at = node.parent
            if node is stop:
                return

    def _find(self, tags: set[str], limit: frozenset[str] | set[str]) -> Node | None:
        if not any(self.open.get(t) for t in tags):
            return None
        node: Node | None = self.at
        found = None
        while node is not None and node.tag not in limit:
            if node.tag in tags:
                found = node
            node = node.parent
        return found

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag == "body" and (head := self._find({"head"}, set())):
            self._close(head)
        if tag in CLOSES_P and (p := self._find({"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "main", "body", "button"})):
            self._close(p)
        if tag in IMPLIED:
            same, limit = IMPLIED[tag]
            if old := self._find(same, limit):
                self._close(old)
        if tag == "br":
            self.at.kids.append("\n")
            return
        inside = any(self.open.get(t) for t in ("article", "main"))
        dropped = tag in GONE or tag == "header" and not inside or tag not in ("html", "body") and _hidden(attrs)
        names = set() if dropped or tag in ("html", "body", "article", "main") else _names(attrs)
        node = Node(tag, self.at, dropped, names)
        self.at.kids.append(node)
        if tag in INLINE and self.open.get("p") and not self.open.get("form"):
            self.controls.append(node)
        if tag not in VOID:
            self.nodes.append(node)
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.at.tag == tag:
            self._close(self.at)

    def handle_endtag(self, tag: str) -> None:
        if not self.open.get(tag) or tag == "html":
            return
        node: Node | None = self.at
        while node is not None and node.tag != tag:
            if tag not in BLOCKS and node.tag in BLOCKS:  # an inline end tag closes nothing outside its block
                return
            node = node.parent
        if node is not None:
            self._close(node)

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def _spread(nodes: list[Node]) -> None:
    """What stands in a dropped part is dropped."""
    for node in nodes:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True


def _measure(nodes: list[Node]) -> None:
    """Length, length in links and commas of each element without dropped parts (children come after parents)."""
    for node in reversed(nodes):
        if node.dropped:
            continue
        node.length = node.linked = node.commas = 0
        for kid in node.kids:
            if isinstance(kid, str):
                n = len(" ".join(kid.split()))
                node.length += n
                node.commas += sum(map(kid.count, ",،、，"))
                node.solid = node.solid or n > 0
            elif not kid.dropped:
                node.length += kid.length
                node.linked += kid.linked
                node.commas += kid.commas
        if node.tag == "a":
            node.linked = node.length


def judge(nodes: list[Node]) -> None:
    """Drop elements by their names where the rest of the page bears it."""
    root = nodes[0]
    total = root.length - root.linked
    for _ in range(ROUNDS):
        outer, real = [], 0
        for node in reversed(nodes):  # text outside links and named elements
            if not node.dropped:
                own = node.length - node.linked
                node.clean = 0 if node.tag == "a" else own - sum(k.length - k.linked - (0 if k.named else k.clean) for k in node.kids if not isinstance(k, str) and not k.dropped)
        inside: set[int] = set()
        article: set[int] = set()
        for node in nodes:
            if node.dropped:
                continue
            if node.tag in ("article", "main") or node.parent is not None and id(node.parent) in article:
                article.add(id(node))
            if node.parent is not None and id(node.parent) in inside:
                inside.add(id(node))
            elif node.named:
                inside.add(id(node))
                outer.append(node)
            elif node.tag in ("article", "main"):
                real = max(real, node.clean)
        if not outer:
            return
        sure = real >= REAL or real * 3 >= total > 0
        stay = []
        for node in outer:
            own = node.length - node.linked
            beside = id(node) not in article and own <= BESIDE * real
            if sure or beside or own * 3 <= total or node.firm and own * 5 <= total * 4:
                node.dropped = True
            else:
                stay.append(node)
        _spread(nodes)
        if not stay:
            return
        for node in stay:  # what is named below it is judged next
            node.named, node.weight = False, 0.5


def prose(controls: list[Node]) -> None:
    """Keep controls that stand inside a sentence: with words of their paragraph before and after them."""
    for node in controls:
        if not node.dropped or any(not isinstance(k, str) for k in node.kids):
            continue
        step, above = node, node.parent
        while above is not None and above.tag not in BLOCKS:
            step, above = above, above.parent
        if above is None or above.tag != "p":
            continue
        at = next(i for i, k in enumerate(above.kids) if k is step)
        spoken = lambda kids: any(isinstance(k, str) and any(c.isalpha() for c in k) for k in kids)
        node.dropped = not (spoken(above.kids[:at]) and spoken(above.kids[at + 1 :]))


def _density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def kept(tree: Tree) -> list[Node | str]:
    """The elements and bare text that are the article, in page order."""
    nodes = tree.nodes
    prose(tree.controls)
    _spread(nodes)
    _measure(nodes)
    judge(nodes)
    _measure(nodes)
    live = [n for n in nodes if not n.dropped]
    for node in live:
        block = node.tag in PARAGRAPHS or node.solid and node.tag in BLOCKS
        if not block or not node.length:
            continue
        points = (1 + node.commas + min(node.length / 100, 3)) * (1 - _density(node))
        if node.tag not in PARAGRAPHS:  # a container with text of its own is its own paragraph
            node.score += points
        share, above, level = points, node.parent, 0
        while above is not None and level < 4:
            above.score += share
            level += 1
            share = points / (2 * level)
            above = above.parent
    holders = [n for n in live if n.score > 0 and n.tag not in PARAGRAPHS and n.tag in BLOCKS]
    if not holders:
        return [tree.root] if tree.root.length else []
    best = max(holders, key=lambda n: n.score * n.weight * (1 - _density(n)))
    above = best.parent
    while above is not None and above.tag not in ("body", "html"):  # a heading or a part may stand beside the best
        if above.tag in ("article", "main") and best.length * 2 > above.length:
            best = above
            break
        above = above.parent
    if best.parent is None or best.tag == "body":
        return [best]
    top = best.score * (1 - _density(best))
    out = beside(best.parent, best, [best], lambda kid: kid.weight == 1 and _near(kid, top), lambda n: True)
    if best.tag in ("article", "main"):
        return out
    article, at = False, best.parent
    while at is not None and not article:
        article, at = at.tag in ("article", "main"), at.parent
    fits = (lambda kid: kid.weight == 1 and _near(kid, top)) if article else (lambda kid: kid.weight == 1 and _far(kid, top))
    inner, scope = best.parent, best.parent.parent
    while scope is not None and inner.tag not in ("article", "main", "body"):
        out = beside(scope, inner, out, fits, lambda n: article or n >= FAR)
        inner, scope = scope, scope.parent
    return out


def _near(kid: Node, top: float) -> bool:
    """A block beside the best container: few links, or the points of another container."""
    return _density(kid) < 0.25 or kid.tag in ("article", "section", "div", "main") and kid.score * (1 - _density(kid)) >= max(10.0, 0.2 * top)


def _far(kid: Node, top: float) -> bool:
    """A block beside a wrapper of the best container: few links, and comparable points or a real paragraph somewhere in it."""
    if _density(kid) >= 0.25:
        return False
    left = [kid]
    while left:
        node = left.pop()
        if node.dropped or not node.length or _density(node) >= 0.25:
            continue
        if node.score * (1 - _density(node)) >= COMPARABLE * top or node.tag in ("p", "pre", "blockquote") and node.length >= FAR:
            return True
        left += [k for k in node.kids if not isinstance(k, str)]
    return False


def beside(scope: Node, own: Node, inner: list[Node | str], block, text) -> list[Node | str]:
    """``inner`` with what is kept of the other children of ``scope``, in page order: blocks by ``block``, bare text and inline
    elements between blocks by the length that ``text`` takes, headings with the block after them."""
    out: list[Node | str] = []
    heads: list[Node | str] = []
    run: list[Node | str] = []  # bare text and inline elements up to the next block
    for kid in [*scope.kids, None]:
        if kid is not None and kid is not own and (isinstance(kid, str) or kid.tag not in BLOCKS):
            run.append(kid)
            continue
        shown = [x for x in run if isinstance(x, str) or not x.dropped]
        length = sum(len(" ".join(x.split())) if isinstance(x, str) else x.length for x in shown)
        if length and text(length) and sum(x.linked for x in shown if not isinstance(x, str)) < 0.25 * length:
            out += shown
        run = []
        if kid is None or kid is not own and (kid.dropped or not kid.length):
            continue
        if kid is own or block(kid):
            out += [*heads, *(inner if kid is own else [kid])]
            heads = []
        elif kid.tag in HEADINGS and kid.weight == 1 and _density(kid) < 0.25:
            heads.append(kid)
        else:
            heads = []
    return out


def text_of(roots: list[Node | str]) -> str:
    """Text of the elements without dropped parts; blocks are set apart by white space, then all of it collapses."""
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(roots))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.dropped:
            if item.tag in BLOCKS:
                parts.append("\n")
                stack.append("\n")
            stack.extend(reversed(item.kids))
    return " ".join("".join(parts).split())


def extract(html: str | None) -> str:
    """Main text of a page."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    return text_of(kept(tree))


def with_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text string, n_chars long) for every page."""
    own = only(df, id_col, url_col)
    df = df.select(col(id_col).alias("0"), col(url_col).alias("1"), col(html_col).alias("2"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "2"):
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return df.mapInArrow(read, StructType([*own.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
