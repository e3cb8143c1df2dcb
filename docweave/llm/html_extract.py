"""Main text of web pages by composite text density.

Every node of a page's tree gets the density of its characters per tag, less
what stands in links, and the sum of its children's densities. The node of the
largest sum holds the article; an <article> or <main> around it bounds it. The
length of its paragraphs sets a threshold of characters a tag outside links:
parts of the node, and subtrees beside its path to the body, that fall below are
left out, as are lists of links. Nodes that are never content
(scripts, menus, forms, adverts, comments of readers ...) are left out first.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that hold no article text.
DROPPED = frozenset("script style noscript template textarea title head iframe noembed noframes object embed svg math canvas video audio map select option datalist button input label fieldset form nav footer header aside menu dialog".split())
#: Elements that start and end a block of text.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: A start tag of one of these ends an open <p>.
ENDS_P = BLOCKS - frozenset("body br caption html tbody td tfoot th thead tr legend".split())
#: A start tag that ends an open element of the same kind, up to the element that holds them.
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table tbody thead tfoot"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
            "tbody": ("tbody thead tfoot tr td th", "table"), "thead": ("tbody thead tfoot tr td th", "table"), "tfoot": ("tbody thead tfoot tr td th", "table"), "option": ("option", "select"), "head": ("", "")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
#: Of these, what may be wrapped around a whole page all the same.
WRAPPERS = frozenset("label fieldset form nav footer header aside menu".split())
NEVER = DROPPED - WRAPPERS
#: A class, id or role that names what is not the article: the whole of it, its beginning, or after a word of place.
OFF = re.compile(r"(?:(?:site|page|main|global|top|bottom|left|right|primary|secondary)[_-]+)?(?:ad|ads|advert|adverts|advertisement|advertising|banner|breadcrumb|breadcrumbs|comment|comments|comment-list|cookie|cookies|consent|disqus|discussion|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|related|replies|respond|share|sharing|sidebar|social|sponsor|sponsored|subscribe|toolbar|widget|alert|contentinfo|complementary|search|form)(?:[_-].*)?", re.I)
#: The same for what readers wrote, which may be longer than the article.
READERS = re.compile(r"(?:comment|comments|disqus|discussion|replies|respond)(?:[_-].*)?", re.I)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text, that hold others, and that say nothing of what they hold.
RUNNING = frozenset("p pre blockquote".split()) | HEADINGS
HOLDERS = frozenset("html body div section center table tbody tr td".split())
PLAIN = frozenset("div section center".split())
#: A paragraph beside the article is text from this many characters on, or if it ends as a sentence does.
LINE = 80
SENTENCE = re.compile(r"[.!?…。！？][\"'»”’)]*$")
#: A quote counts after = only.
TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<(?:!|\?)[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]+)))?")
SPACES = re.compile(r"[ \t\n\r\f\v   -     　\x1c-\x1f\x85]+")


class Node:
    __slots__ = ("tag", "parent", "items", "off", "doubt", "readers", "link", "chars", "tags", "linked", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, off: bool, link: bool) -> None:
        self.tag, self.parent, self.off, self.link = tag, parent, off, link
        self.items: list = []
        self.doubt = self.readers = False
        self.chars = self.tags = self.linked = self.link_tags = 0
        self.density = self.total = 0.0


def attributes_of(text: str) -> dict[str, str]:
    """Names and values of a start tag's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def is_hidden(given: dict[str, str]) -> bool:
    return "hidden" in given or given.get("aria-hidden", "").lower() == "true" or HIDDEN.search(given.get("style", "")) is not None


def names(given: dict[str, str]) -> list[str]:
    return [re.sub(r"(?<=[a-z])(?=[A-Z])", "-", word) for name in ("class", "id", "role") for word in given.get(name, "").split()]


def judged(tag: str, text: str, node: Node) -> Node:
    """``node`` with what its own tag and attributes say; settled() decides on what is doubtful."""
    given = attributes_of(text) if text else {}
    node.off = node.off or tag in NEVER or is_hidden(given)
    if tag not in ("body", "html", "article", "main"):
        words = names(given)
        node.readers = any(map(READERS.fullmatch, words))
        node.doubt = tag in WRAPPERS or node.readers or any(map(OFF.fullmatch, words))
    return node


def settled(nodes: list[Node]) -> None:
    """Mark off what its tag or name says is not content, unless it holds the content.

    It does if no <article> or <main> stands outside all such elements and it
    holds one, or if it holds most of the characters outside links of the page
    (of the <article> or <main> around it). Readers' comments may hold most.
    """
    words: dict[int, int] = {}
    inside: set[int] = set()
    for n in reversed(nodes):
        if n.off:
            continue
        own = 0 if n.link else sum(len(c) - c.count(" ") - c.count("\n") for c in n.items if isinstance(c, str))
        kids = [c for c in n.items if not isinstance(c, str) and not c.off]
        words[id(n)] = own + sum(words[id(c)] for c in kids)
        if any(c.tag in ("article", "main") or id(c) in inside for c in kids):
            inside.add(id(n))
    scope: dict[int, Node | None] = {}
    under: set[int] = set()
    free = False
    for n in nodes:
        up = n.parent
        scope[id(n)] = None if up is None else up if up.tag in ("article", "main") else scope[id(up)]
        if n.doubt or up is not None and id(up) in under:
            under.add(id(n))
        free = free or n.tag in ("article", "main") and not n.off and id(n) not in under
    for n in nodes:
        if n.parent is not None and n.parent.off:
            n.off = True
        if not n.doubt or n.off:
            continue
        within = scope[id(n)]
        whole = words[id(within or nodes[0])]
        most = 2 * words[id(n)] > whole and not (n.readers and words[id(n)] < whole)
        n.off = not (most or id(n) in inside and not n.readers) if within is None and not free else within is None or not most


class Builder:
    """Where the next node goes, and how many elements of each name are open there, so that nothing is looked for in vain."""

    def __init__(self) -> None:
        self.root = self.here = Node("html", None, False, False)
        self.open: Counter[str] = Counter()

    def push(self, node: Node) -> None:
        self.here = node
        self.open[node.tag] += 1

    def up_to(self, node: Node) -> None:
        """Closes what is open within ``node``."""
        while self.here is not node:
            self.open[self.here.tag] -= 1
            self.here = self.here.parent

    def nearest(self, tags: frozenset, stop: frozenset) -> Node | None:
        """The nearest open element of these names, if none of ``stop`` is nearer."""
        if not any(self.open[t] for t in tags):
            return None
        node = self.here
        while node.parent is not None and node.tag not in tags:
            if node.tag in stop:
                return None
            node = node.parent
        return node if node.tag in tags and node.parent is not None else None

    def ended(self, tag: str) -> None:
        """An end tag; one of inline markup does not reach beyond the block it is in."""
        node = self.nearest(frozenset((tag,)), frozenset() if tag in BLOCKS or tag in DROPPED else BLOCKS)
        if node is not None:
            self.up_to(node.parent)
        elif tag == "br":
            self.here.items.append(Node("br", self.here, False, False))

    def started(self, tag: str) -> None:
        """Ends what a start tag ends."""
        if tag in ENDS_P and (p := self.nearest(ONLY_P, P_HOLDERS)) is not None:
            self.up_to(p.parent)
        if tag in SIBLINGS:
            ends, within = SIBLINGS[tag]
            # the farthest of those that are open inside what holds them
            while (node := self.nearest(ends, within)) is not None:
                self.up_to(node.parent)
        if tag == "a" and (a := self.nearest(ONLY_A, BLOCKS)) is not None:
            self.up_to(a.parent)


ONLY_P, ONLY_A = frozenset(("p",)), frozenset(("a",))
P_HOLDERS = frozenset("table td th button caption".split())


def tree(page: str) -> Node:
    """The page's tree, in time in proportion to the page, however deep it nests."""
    b = Builder()
    root = b.root
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            b.here.items.append(page[at:])
            break
        if m.start() > at:
            b.here.items.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue  # a comment or declaration
        tag = m[2].lower()
        if m[1]:
            b.ended(tag)
            continue
        if tag in ("html", "body"):
            if tag == "body" and b.here is root:
                new = Node("body", root, False, False)
                root.items.append(new)
                b.push(new)
            continue
        b.started(tag)
        node = judged(tag, m[3], Node(tag, b.here, b.here.off, b.here.link or tag == "a"))
        b.here.items.append(node)
        if tag in VOID or (m[3] or "").rstrip().endswith("/") and tag not in BLOCKS and tag not in RAW:
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        b.push(node)
    return root


def in_order(root: Node) -> list[Node]:
    """All nodes, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.items if not isinstance(c, str))
    return out


def weigh(nodes: list[Node]) -> None:
    """Characters, tags and densities of all nodes, children first."""
    for node in reversed(nodes):
        if node.off:
            continue
        for c in node.items:
            if isinstance(c, str):
                n = len(c) - c.count(" ") - c.count("\n")
                node.chars += n
                if node.link:
                    node.linked += n
            elif not c.off:
                node.chars += c.chars
                node.tags += c.tags + (c.tag != "br")  # which only parts lines
                node.linked += c.linked
                node.link_tags += c.link_tags + (c.tag == "a")
    body = nodes[0]
    ratio = body.linked / max(1, body.chars)
    for node in reversed(nodes):
        if node.off or not node.chars:
            continue
        tags, plain = max(1, node.tags), max(1, node.chars - node.linked)
        base = node.chars / plain * node.linked + ratio * node.chars + math.e
        node.density = node.chars / tags * math.log(max(node.chars * tags / (max(1, node.linked) * max(1, node.link_tags)), 1.0) + 1, max(math.log(base), 1.0 + 1e-9))
        node.total = sum(c.density for c in node.items if not isinstance(c, str)) or node.density


def spread(node: Node) -> float:
    """Characters outside links for each tag."""
    return (node.chars - node.linked) / max(1, node.tags)


def in_links(node: Node) -> bool:
    return 2 * node.linked > node.chars


def paragraph(node: Node) -> float:
    """How long the blocks of a node are, as the mean over its characters outside links."""
    total = squares = 0
    for n in in_order(node):
        if n.off or n.tag not in BLOCKS:
            continue
        own = n.chars - n.linked - sum(c.chars - c.linked for c in n.items if not isinstance(c, str) and not c.off and c.tag in BLOCKS)
        total += own
        squares += own * own
    return squares / total if total else float(node.chars - node.linked)


def cut(node: Node, least: float) -> None:
    """Mark off what stands in a node of paragraphs and is not running text."""
    kids = [c for c in node.items if not isinstance(c, str) and not c.off and c.chars and c.tag in BLOCKS]
    loose = sum(len(c.strip()) for c in node.items if isinstance(c, str))
    lines = loose + sum(c.chars - c.linked for c in kids if c.tag in PLAIN and is_bare(c))
    dense = [i for i, c in enumerate(kids) if spread(c) >= least and not in_links(c)]
    for i, c in enumerate(kids):
        if spread(c) >= least:
            continue
        edge = not dense or not dense[0] < i < dense[-1]
        if in_links(c):
            c.off = edge or c.tag not in RUNNING
        elif c.tag in PLAIN and dense:
            # among <p>s a short <div> is none; among <div>s it may be a paragraph
            c.off = edge and not (is_bare(c) and is_line(c)) if 2 * lines > node.chars - node.linked else edge or is_bare(c)


def content(root: Node) -> Node | None:
    """The node that holds the article; what is not of it is marked off."""
    nodes = in_order(root)
    settled(nodes)
    weigh(nodes)
    seen = [n for n in nodes if not n.off and n.chars]
    if not seen:
        return None
    best = max(seen, key=lambda n: n.total)
    node = best
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    if node is not None:  # the element bounds the article, density says what in it is of it
        cut(node, paragraph(node) / 3)
        return node
    # a block or more: the sum of a paragraph's inline tags says nothing of the page
    while best.parent is not None and best.tag not in HOLDERS:
        best = best.parent
    least = paragraph(best) / 3
    cut(best, least)
    whole, node = True, best
    while node.parent is not None:
        here = node.parent
        others = [c for c in here.items if not isinstance(c, str) and c is not node and not c.off and c.chars]
        rest = sum(c.chars - c.linked for c in others) / max(1, sum(c.tags + 1 for c in others))
        if whole and others and rest >= least and not any(map(in_links, others)):
            for c in others:  # as dense: the article goes on in them, but not in scraps
                c.off = c.tag in PLAIN and spread(c) < least and is_bare(c) and not is_line(c)
            node = here
            continue
        whole = whole and not others
        beside(here, node, least)
        node = here
    return root


def beside(here: Node, node: Node, least: float) -> None:
    """Mark off what stands in ``here`` beside the article's ``node`` and is not of it; inline items in a row are judged as one."""
    at, follows, i = here.items.index(node), False, len(here.items)
    while i:
        i -= 1
        c = here.items[i]
        if c is node:
            follows = True
        elif not isinstance(c, str) and c.tag in BLOCKS:
            if not c.off and c.chars:
                running = c.tag in RUNNING - HEADINGS and is_line(c)
                title = c.tag in HEADINGS and (follows or c.tag == "h1" and i < at)
                follows = not in_links(c) and (spread(c) >= least or running or title)
                c.off = not follows
        else:
            end = i + 1
            while i and here.items[i - 1] is not node and (isinstance(here.items[i - 1], str) or here.items[i - 1].tag not in BLOCKS):
                i -= 1
            run = Node("p", None, False, False)
            run.items = here.items[i:end]
            weigh([run])
            if run.chars and (in_links(run) or not is_line(run)):
                here.items[i:end] = [""] * (end - i)
                follows = False


def is_bare(node: Node) -> bool:
    return not any(not isinstance(c, str) and c.tag in BLOCKS and c.chars for c in node.items)


def is_line(node: Node) -> bool:
    return node.chars >= LINE or SENTENCE.search(text_of(node)) is not None


def text_of(node: Node) -> str:
    """Blocks in page order, joined by a space."""
    blocks: list[str] = []
    run: list[str] = []

    def flush() -> None:
        joined = SPACES.sub(" ", html.unescape("".join(run))).strip(" ") if run else ""
        run.clear()
        if joined:
            blocks.append(joined)

    stack: list = [(node, False)]
    while stack:
        item, done = stack.pop()
        if isinstance(item, str):
            run.append(item)
        elif item.off:
            if item.tag in BLOCKS:
                flush()
        elif done:
            flush()
        else:
            if item.tag in BLOCKS:
                flush()
                stack.append((item, True))
            stack.extend((c, False) for c in reversed(item.items))
    flush()
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    """The article's text; empty if the page is null, empty or has none."""
    if not page:
        return ""
    node = content(tree(page.replace("\x00", "")))
    return text_of(node) if node is not None else ""


def extracted(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null and empty pages give empty text; pages of any length and depth are read
    whole, in time in proportion to their length; unclosed and stray tags are closed or
    ignored as browsers do. Of nodes of equal density sums (a tie) the first
    counts. Null ids and urls are kept; repeated rows give
    repeated results; an empty table gives no rows; other columns are ignored,
    whatever their names.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": b.column(0), "url": b.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col(html_column).cast("string").alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
