"""Main text of web pages by site style trees.

All pages of a host are merged into one style tree. Its elements are the block-level
paths (tag, class and id, digits dropped) that the host's pages have, page furniture and
articles alike; the text that stands in an element is a leaf below it. Over the host's
pages of distinct main content (the blocks under article or main elements, else all
blocks; copies of one article count once, whatever else differs in them) are counted:

* presentation of an element: the entropy of the sequences of child elements below it
  (runs of equal children as one);
* content of a leaf: the entropy of its texts, 0 where all pages carry the same and 1
  where every page has its own.

Entropies are raised to ``SHARP``: furniture that is drawn from a few dozen variants has an entropy
not far from 1, while main content has one of 1. With few pages they are drawn towards
one half (``NEUTRAL_PAGES``). What names and elements say is a prior weight, added to the
entropy's log-odds: ``LEAN`` for article and main elements, against for furniture (menus, headers, footers, side
bars, notices, adverts, forms, comments), nothing elsewhere, and up to
``LINKED`` against a leaf for the share of its text that is links. A prior moves the decision, the
leaf's entropy can't be read without it, and where neither is known the text stays.

Composite importances go from the leaves upward: a branch has the mean of what is below
it, weighed by pages and by ``DECAY`` for each level, down to ``LEVELS`` levels. A
leaf is worth its own importance with ``BRANCH`` of its branch's, and what is worth less
than ``KEEP`` is removed; a branch all of whose leaves are removed goes as a whole.

An article inside an article that has paragraphs of its own is a reader's comment, and
so is all that is named as comments, whatever elements it has. Other names don't make
furniture of html, body, main and article elements, of what holds a main or article
element, or of what is named content as well. Leaves that one page alone has are judged
by their prior. Where nothing is left of a page, names are wrong: it keeps what the tree
finds important without them, outside the furniture's elements.

Scale: a page becomes one small row per node; those are counted with partial
aggregation, so a host with a third of all pages reaches no task as a whole. A
host's tree is one row with its dropped leaves (of two pages at least), joined to the pages by host; Spark
broadcasts it if it is small, and splits a hot host's partition if not. Reading a page
takes time linear in its tags, and a node carries at most ``LEVELS`` ancestors.

Defined results: null or empty html gives the empty text; a null or odd url is a
host of its own name ''; repeated rows get equal texts; unclosed, unopened and
truncated tags are taken as they stand, without recursion; an empty table gives
an empty result. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import stage_table

NEUTRAL_PAGES, SHARP = 4, 12
#: Log-odds of article and main elements, and of furniture with a minus; of a text that is all links. Entropies are read between EDGE and 1 - EDGE.
LEAN, LINKED, EDGE = 3.9, 3.5, 0.05
KEEP = 0.5
#: Levels of a branch that its importance is made of, and a level's weight against the one above.
LEVELS, DECAY = 6, 0.5
#: Share of the branch in a block's importance.
BRANCH = 0.2
#: Importances are sums of floating point numbers.
ROUNDING = 1e-9
#: Hosts whose dropped nodes a worker keeps.
CACHE_HOSTS = 256

#: One tag, comment or declaration; only a value that begins with a quote may hold '>'.
TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)|[^>=])*+)>?|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
DIGITS = re.compile(r"\d+")
NAME = re.compile(r"[a-z]+")
#: Names of the kind has-sidebar speak of another element.
OF_OTHERS = re.compile(r"\b(?:has|with|no|without|is)[-_][a-z_-]+")

#: Elements whose content is no text at all; they end at their own end tag only.
RAW = {"script", "style", "noscript", "template", "svg", "iframe", "object", "textarea", "select", "button", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption",
}
#: An element that a start tag closes first, up to the nearest of the elements behind the colon.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
#: Page furniture by element, and by the words of class, id and role.
FURNITURE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
FURNITURE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "form", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "related", "respond", "search",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
#: Names that are never in doubt.
COMMENT_NAMES = {"comment", "comments", "disqus", "respond"}
CONTENT_TAGS = {"article", "main"}
CONTENT_NAMES = {"article", "body", "content", "entry", "main", "post", "story"}


def host_of(url: str | None) -> str:
    found = HOST.match(url or "")
    return found[1].lower() if found else ""


class _Node:
    __slots__ = ("tag", "path", "leaf", "parent", "named", "comments", "content", "holds", "lean", "sure", "article", "own", "style", "last")

    def __init__(self, tag: str, path: int, parent: _Node | None, own: set[str]):
        self.tag, self.path, self.parent = tag, path, parent
        self.leaf = xxhash.xxh64_intdigest(f"{path}#")
        self.named, self.comments, self.content = bool(own & FURNITURE_NAMES) and tag not in ("html", "body"), bool(own & COMMENT_NAMES), bool(own & CONTENT_NAMES)
        #: Whether it holds an article or main element; log-odds of names and elements; whether an element, no name, gave them.
        self.holds, self.lean, self.sure, self.style, self.last = False, 0.0, True, 0, 0
        #: The innermost article around it, and whether that has paragraphs of its own.
        self.article: _Node | None = self if tag == "article" else parent.article if parent else None
        self.own = False

    def above(self) -> list[int]:
        found, node = [], self.parent
        while node and node.parent and len(found) < LEVELS:
            found.append(_signed(node.path))
            node = node.parent
        return found


def _child(parent: _Node, tag: str, attributes: str) -> _Node:
    names = [DIGITS.sub("", " ".join(g for g in m.groups()[1:] if g)).lower() for m in ATTRIBUTE.finditer(attributes)]
    words = {w for n in names for w in NAME.findall(n)}
    own = {w for n in names for w in NAME.findall(OF_OTHERS.sub(" ", n))}
    path = xxhash.xxh64_intdigest(f"{parent.path}/{tag}/{' '.join(sorted(words))}")
    node = _Node(tag, path, parent, own)
    if parent.last != path:
        parent.style, parent.last = xxhash.xxh64_intdigest(f"{parent.style}/{path}"), path
    above: _Node | None = node if tag in CONTENT_TAGS and not (node.named and not node.content) else None
    while above and not above.holds:
        above.holds, above = True, above.parent
    return node


def _weigh(node: _Node) -> None:
    """Prior of a node, its parent's being known; all of the page must be read, as ``holds`` and ``own`` depend on what follows."""
    parent, around = node.parent, node.parent.article
    # readers' articles stand in one that has a text of its own
    comment = node.comments or (node.tag == "article" and around is not None and around.own)
    doubt = node.named and (node.holds or node.content or node.tag in CONTENT_TAGS)
    if parent.lean < 0:
        node.lean, node.sure = parent.lean, parent.sure
    elif node.tag in FURNITURE_TAGS or (node.tag == "header" and not parent.lean):
        node.lean = -LEAN
    elif (node.named and not doubt) or (comment and node.tag not in ("html", "body", "main")):
        node.lean, node.sure = -LEAN, comment
    elif node.tag in CONTENT_TAGS and not doubt:
        node.lean = LEAN
    else:
        node.lean = 0.0 if doubt else parent.lean


#: End tags of raw elements; nothing else ends them, whatever looks like a tag in their content.
RAW_END = {tag: re.compile(rf"</{tag}(?![^\s/>])[^>]*>?", re.I) for tag in RAW}


class _Page:
    """Elements and blocks of one page, tags taken as they stand."""

    def __init__(self, page: str):
        self.root = _Node("", 0, None, set())
        self.stack, self.made = [self.root], []
        #: Where in the stack the open elements of a tag are.
        self.open: dict[str, list[int]] = {}
        #: Node, text, and the share of it inside links.
        self.blocks: list[tuple[_Node, str, float]] = []
        self.text: list[str] = []
        self.link, self.linked = -1, 0
        at = 0
        while m := TAG.search(page, at):
            self.text.append(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if tag in RAW:
                if not m[1] and not m[3].rstrip().endswith("/"):
                    end = RAW_END[tag].search(page, at)
                    at = end.end() if end else len(page)
            elif tag == "br":
                self.text.append(" ")
            elif tag == "a":
                self.unlink()
                self.link = -1 if m[1] else len(self.text)
            elif tag in BLOCK:
                self.flush()
                if m[1]:
                    self.close(self.depth({tag}))
                elif tag not in VOID:
                    self.start(tag, m[3])
        self.text.append(page[at:])
        self.flush()
        for node in self.made:  # parents stand before their children
            _weigh(node)

    def unlink(self) -> None:
        if self.link >= 0:
            self.linked += sum(len(t) for t in self.text[self.link :])
            self.link = -1

    def flush(self) -> None:
        open_link = self.link >= 0
        self.unlink()
        raw = "".join(self.text)
        text = " ".join(entities.unescape(raw).split())
        if text:
            node = self.stack[-1]
            self.blocks.append((node, text, min(1.0, self.linked / max(1, len(raw.strip())))))
            if node.article and node.tag in ("p", "h1", "h2", "h3"):
                node.article.own = True
        self.text.clear()
        self.link, self.linked = (0 if open_link else -1), 0

    def depth(self, tags: set[str]) -> int:
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((self.open[t][-1] for t in tags if self.open.get(t)), default=0)

    def close(self, depth: int) -> None:
        while depth and len(self.stack) > depth:
            self.open[self.stack.pop().tag].pop()

    def start(self, tag: str, attributes: str) -> None:
        if self.stack[-1].tag == "p":
            self.close(len(self.stack) - 1)
        closed, fence = CLOSES.get(tag, (set(), set()))
        inner = self.depth(closed)
        if inner > self.depth(fence):
            self.close(inner)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(_child(self.stack[-1], tag, attributes))
        self.made.append(self.stack[-1])


def _odds(entropy: float, lean: float) -> float:
    return 1 / (1 + (1 - entropy) / entropy * math.exp(-lean))


#: Sharpened entropy of a leaf of one page, drawn towards one half.
ONE_PAGE = (1 + NEUTRAL_PAGES * 0.5) / (1 + NEUTRAL_PAGES)


def kept_text(page: str | None, tree: Tree | None = None) -> str:
    """The page's blocks that its host's tree keeps; all of them without a tree."""
    found = _Page(page or "").blocks
    if tree is None:
        return "\n".join(text for _, text, _ in found)
    kept = []
    for node, text, links in found:
        leaf = _signed(node.leaf)
        if leaf in tree.kept or (leaf not in tree.dropped and _odds(ONE_PAGE, node.lean - LINKED * links) >= KEEP):
            kept.append(text)
    if not kept:
        kept = [text for node, text, _ in found if _signed(node.leaf) not in tree.bare and (node.lean >= 0 or not node.sure)]
    return "\n".join(kept)


@dataclass(frozen=True)
class Tree:
    """Leaves of two pages or more of a host: those dropped, those kept against their prior, and those dropped whatever the prior."""

    dropped: frozenset[int] = frozenset()
    kept: frozenset[int] = frozenset()
    bare: frozenset[int] = frozenset()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def node_contents(pages: DataFrame) -> DataFrame:
    """One row per page and node: host, hash of the main content, path, parents' paths, log-odds of the prior, hash of the child elements (of a leaf null), hash of the text (of an element null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for url, html in zip(b.column(0).to_pylist(), b.column(1)):
                page = _Page(html.as_py() or "")
                sure = [text for node, text, _ in page.blocks if node.lean > 0]
                main = _signed(xxhash.xxh64_intdigest("\n".join(sure or [text for _, text, _ in page.blocks])))
                elements: dict[int, list] = {}
                for node in page.made:
                    one = elements.setdefault(node.path, [node, xxhash.xxh64(), node.lean])
                    one[1].update(f"{node.style}\n")
                    one[2] = max(one[2], node.lean)
                leaves: dict[int, list] = {}
                for node, text, links in page.blocks:
                    one = leaves.setdefault(node.leaf, [node, xxhash.xxh64(), 0.0, 0])
                    one[1].update(text + "\n")
                    one[2] += (node.lean - LINKED * links) * len(text)
                    one[3] += len(text)
                host = host_of(url)
                rows = [(host, main, _signed(n.path), n.above(), lean, _signed(style.intdigest()), None) for n, style, lean in elements.values()]
                rows += [(host, main, _signed(leaf), ([_signed(n.path)] if n.parent else []) + n.above()[: LEVELS - 1], lean / size, None, _signed(text.intdigest())) for leaf, (n, text, lean, size) in leaves.items()]
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.int64(), pa.int64())
                columns = list(zip(*rows)) or [[]] * 7
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds)], names=["host", "main", "path", "above", "lean", "style", "content"])

    return pages.select("url", "html").mapInArrow(run, "host string, main long, path long, above array<long>, lean double, style long, content long")


def _chances(entropy: Column, lean: Column | float) -> Column:
    return 1 / (1 + (1 - entropy) / entropy * F.exp(-lean if isinstance(lean, Column) else F.lit(-lean)))


def importance(pages: DataFrame) -> DataFrame:
    """The style trees: host, path, leaf, pages, lean, entropy, own and composite importance of every node, what a leaf is worth, and what it is without its prior."""
    rows = stage_table(node_contents(pages), "style-nodes")
    once = rows.groupBy("host", "path", "main").agg(F.min("style").alias("style"), F.min("content").alias("content"))
    each = once.groupBy("host", "path", F.coalesce("style", "content").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    nodes = each.groupBy("host", "path").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    spread = F.when(F.col("pages") > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")))).otherwise(1.0)
    shape = rows.groupBy("host", "path").agg(F.avg("lean").alias("lean"), F.any_value("above").alias("above"), F.max(F.col("content").isNotNull()).alias("leaf"))
    tree = shape.join(nodes.select("host", "path", "pages", spread.alias("entropy")), ["host", "path"])
    sharp = (F.col("pages") * F.pow("entropy", F.lit(float(SHARP))) + NEUTRAL_PAGES * 0.5) / (F.col("pages") + NEUTRAL_PAGES)
    sharp = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), sharp))
    tree = stage_table(tree.withColumn("bare", sharp).withColumn("own", _chances(sharp, F.col("lean"))), "style-tree")
    # every node counts in itself and in the branches above it, less with each level
    lines = F.array_insert(F.col("above"), 1, F.col("path"))
    parts = tree.select("host", "pages", "own", F.posexplode(lines).alias("level", "path"))
    weight = F.col("pages") * F.pow(F.lit(DECAY), F.col("level"))
    composite = parts.groupBy("host", "path").agg((F.sum(weight * F.col("own")) / F.sum(weight)).alias("composite"))
    tree = tree.join(composite, ["host", "path"])
    branch = composite.select("host", F.col("path").alias("up"), F.col("composite").alias("branch"))
    tree = tree.withColumn("up", F.get("above", 0)).join(branch, ["host", "up"], "left")
    worth = (1 - BRANCH) * F.col("own") + BRANCH * F.coalesce("branch", "own")
    return tree.select("host", "path", "leaf", "pages", "lean", "entropy", "own", "composite", worth.alias("importance"), "bare")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    # a leaf of one page has no say, so there are at most half as many as the host has blocks on its pages
    leaves = importance(pages).filter((F.col("pages") > 1) & F.col("leaf"))
    low = F.col("importance") < KEEP - ROUNDING
    doubtful = _chances(F.lit(ONE_PAGE), F.col("lean")) < KEEP
    marked = leaves.select("host", "path", low.alias("low"), (~low & doubtful).alias("rescued"), (F.col("bare") < KEEP - ROUNDING).alias("bare")).filter("low or rescued or bare")
    sets = [F.collect_set(F.when(F.col(c), F.col("path"))).alias(name) for c, name in (("low", "dropped"), ("rescued", "kept"), ("bare", "bare"))]
    trees = stage_table(marked.groupBy("host").agg(*sets), "style-trees")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, Tree] = {}
        for b in batches:
            texts = []
            for row, (page, host) in enumerate(zip(b.column(2), b.column(3).to_pylist())):
                if host not in trees:
                    if len(trees) >= CACHE_HOSTS:
                        trees.clear()
                    trees[host] = Tree(*(frozenset(b.column(k)[row].as_py() or ()) for k in (4, 5, 6)))
                texts.append(kept_text(page.as_py(), trees[host]))
            yield pa.record_batch(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST.pattern, 1))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), host.alias("host"))
    joined = rows.join(trees, "host", "left").select("page_id", "url", "html", "host", "dropped", "kept", "bare")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
