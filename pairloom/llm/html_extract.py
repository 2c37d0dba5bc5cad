"""HTML extraction with a site style tree.

The DOMs of a host's pages are merged: a node of its tree are the elements with the same path of tags, classes and ids, of
all pages. A node's presentation has the entropy of what child elements pages show there, and its content is important as
far as its texts differ between the pages that have it (one minus the mean entropy, over those pages, of the texts that a
page shows there). Bottom-up, a node's composite importance is that of its presentation and of all contents below it, each by how often it occurs.
Whole branches go from each page: those in which nothing is important, and, outside the article, those with hardly
anything important. Pages that say the same count once, so copies do not make an article look like a template. What the
markup itself says (navigation, footers, adverts, forms, comments) is removed on any page, however few its host has.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize

#: Weight of the contents' importance in a node's, the rest being its presentation's.
CONTENT = 0.9
#: Branches whose most important content leaves them under this go; inside an article only those with a class or id of their own, under the second.
LEAST, LEAST_INSIDE = 0.35, 0.1
#: Branches outside the article whose composite importance is under this go, with the little in them that differs.
LEAST_BRANCH = 0.15
#: Distinct pages that a node must be on to be judged.
LEAST_PAGES = 4
#: Levels of the tree; what is deeper counts as its ancestor there.
LEVELS = 64
#: Low-importance nodes of all hosts up to which they are broadcast; more are joined by a shuffle on the host.
BROADCAST_NODES = 100_000

#: Fixed values of HTML: elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript template svg math canvas audio video object select button datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes first, if one is open, up to the elements that hold it.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "tbody")}
HOLDERS = frozenset("ul ol dl table body html article main section div".split())
#: Elements, roles and words of classes and ids that mark what is not the article.
OUTSIDE = frozenset("nav aside footer menu dialog head".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
OUTSIDE_WORDS = frozenset(
    "nav navbar navigation menu menubar topnav subnav sidebar sidenav footer colophon masthead topbar toolbar ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup login search share sharing sharebar social breadcrumb breadcrumbs pagination pager "
    "related recommended recommendations comment comments commentlist reply replies respond responses discussion disqus widget widgets copyright skip disclaimer".split()
)
#: The same for what may wrap a page's article: an article or main element inside is not outside.
WRAPPERS, WRAPPER_WORDS = frozenset("form header".split()), frozenset("header form".split())
_NOT_WORDS = frozenset("with has no without main content article entry".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/>]|\Z)", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    #: 0: kept, 1: outside but may wrap the article, 2: outside.
    outside: int
    #: Inside an article or main element; whether a node from there on has a class or id.
    article: bool
    marked: bool
    level: int = 0
    #: The block element around it.
    above: Node | None = None
    id: int = 0

    def state(self) -> int:
        return 4 * (self.outside > 0) + 2 * self.article + self.marked

    def up(self) -> list[int]:
        """The ids of the node and the block elements around it."""
        ids, at = [self.id], self
        while (at := at.above) is not None:
            if at.id != ids[-1]:
                ids.append(at.id)
        return ids


@dataclass(slots=True)
class Block:
    node: Node
    text: str

    @property
    def outside(self) -> bool:
        return self.node.outside > 0


def _open(tag: str, attributes: str, parent: Node, block: Node) -> Node:
    names, own, hidden, role = "", 0, False, ""
    if attributes and not attributes.isspace():
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += f" {value}"
            elif key == "role":
                role = value.strip().lower()
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                hidden |= key == "hidden" or value == "true"
    article = parent.article or tag in ("article", "main") or role == "main"
    if tag in OUTSIDE or role in OUTSIDE_ROLES or hidden:
        own = 2
    elif tag in WRAPPERS:
        own = 2 if tag == "form" and parent.article else 0 if parent.article else 1
    if names and own < 2 and tag not in ("html", "body", "main"):
        for name in names.split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if not _NOT_WORDS.isdisjoint(words):
                continue
            if not OUTSIDE_WORDS.isdisjoint(words):
                own = 2
            elif not WRAPPER_WORDS.isdisjoint(words) and not parent.article and tag not in HEADINGS:
                own = max(own, 1)
    above = parent.outside
    if above == 1 and (tag in ("article", "main") or role == "main"):
        above = 0
    path = parent.path
    if parent.level < LEVELS:
        path += f"/{tag}" + (f".{' '.join(sorted(names.split()))}" if names else "")
    node = Node(tag, path, max(above, own), article, bool(parent.article and (parent.marked or names.strip())), parent.level + 1, block)
    node.id = _hash(f"{path}|{node.state()}")
    return node


def blocks(page: str, shown: dict[int, list[int]] | None = None) -> list[Block]:
    """The blocks of text of a page, in order; markup, scripts, styles and comments are gone, references decoded.

    shown gets, for each node, what its elements show in order, repeats once: child elements by id, texts as 0.
    """
    out: list[Block] = []

    def show(at: Node, what: int) -> None:
        if shown is not None and (not (own := shown.setdefault(at.id, [])) or own[-1] != what):
            own.append(what)

    stack = [Node("", "", 0, False, False)]
    parts: list[str] = []
    home = stack[0]

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if text:
                out.append(Block(home, text))
                show(home, 0)

    def enclosing() -> Node:
        return next(n for n in reversed(stack) if n.tag not in INLINE)

    def add(text: str) -> None:
        """Text goes to the block; inline elements that are outside leave theirs out."""
        nonlocal home
        if not text:
            return
        home = enclosing()
        if stack[-1].outside <= home.outside:
            parts.append(text)
        elif not text.isspace():  # an inline element marked as outside is a block of its own
            flush()
            own = " ".join(html.unescape(text).split())
            if own:
                out.append(Block(stack[-1], own))
                show(stack[-1], 0)

    def close(at: int) -> None:
        if any(n.tag not in INLINE for n in stack[at:]):
            flush()
        del stack[at:]

    at = 0
    while m := _TOKEN.search(page, at):
        add(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("body", "html", "p") and not any(n.tag == tag for n in stack):
                flush()
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    if tag in INLINE and any(n.tag not in INLINE for n in stack[k + 1 :]):
                        del stack[k]  # crossing tags: what was opened inside goes on
                    else:
                        close(k)
                    break
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p" or stack[k].tag in CLOSES.get(tag, ()):
                    del stack[k:]
                elif stack[k].tag in HOLDERS:
                    break
        if tag not in VOID:
            around = enclosing()
            stack.append(_open(tag, m[3], stack[-1], around))
            if tag not in INLINE:
                show(around, stack[-1].id)
    add(page[at:])
    flush()
    return out


def host(url: Column) -> Column:
    """The lower-cased host of a URL; empty if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def style_tree(pages: DataFrame) -> DataFrame:
    """The nodes of each host's tree that have text in them: host, node (an id), up (the ids of itself and what is around it), pages (distinct ones that have it), content (null without texts of its own), presentation, below (the contents' importance in it), most (of the most important one), importance, outside, inside (an article), marked and holds (something of an article).

    The counts are aggregated by (host, node, text) and again by (host, node), and contents once for each node around
    them: a host of any size is never gathered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for of, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shown: dict[int, list[int]] = {}
                found = blocks(page or "", shown)
                says = _hash("\n".join(b.text for b in found if not b.outside))
                rows += {(of, b.node.id, None, 0, _hash(b.text), says) for b in found}
                seen = set()
                for b in found:
                    at, ids = b.node, None
                    while at is not None and at.id not in seen:
                        seen.add(at.id)
                        ids = at.up()
                        rows.append((of, at.id, (at.state(), ids), 1, _hash(str(shown.get(at.id))), says))
                        at = at.above
            columns = [*zip(*rows)] or [[]] * 6
            state, up = (pa.array([x and x[k] for x in columns[2]], t) for k, t in ((0, pa.int32()), (1, pa.list_(pa.int64()))))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), state, up, pa.array(columns[3], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[4:])], names=["host", "node", "state", "up", "kind", "value", "says"])

    schema = "host string, node long, state int, up array<long>, kind int, value long, says long"
    rows = arrow_map(pages.select(host(F.col("url")).alias("host"), "html").where("host <> ''"), run, schema)
    k = rows.dropDuplicates(["host", "node", "kind", "value", "says"]).groupBy("host", "node", "kind", "value").agg(F.count("*").alias("k"), F.first("state").alias("state"), F.first("up").alias("up"))
    log, is_text = F.ln("k"), F.col("kind") == 0
    nodes = k.groupBy("host", "node").agg(
        (F.sum(F.when(is_text, F.col("k") * log)) / F.sum(F.when(is_text, F.col("k")))).alias("texts"),
        F.sum(F.when(is_text, F.col("k"))).alias("times"),
        F.sum(F.when(~is_text, F.col("k"))).alias("pages"),
        F.sum(F.when(~is_text, F.col("k") * log)).alias("styles"),
        F.first("state", ignorenulls=True).alias("state"),
        F.first("up", ignorenulls=True).alias("up"),
    )
    most = F.ln(F.greatest(F.col("pages"), F.lit(2)))
    flag = lambda bit: (F.col("state").bitwiseAND(bit) > 0)
    nodes = nodes.select("host", "node", "up", "pages", "times", (1 - F.col("texts") / most).alias("content"), ((F.ln("pages") - F.col("styles") / F.col("pages")) / most).alias("presentation"), flag(4).alias("outside"), flag(2).alias("inside"), flag(1).alias("marked"))
    nodes = materialize(nodes)
    leaves = nodes.where("content IS NOT NULL").select("host", F.explode("up").alias("node"), "content", "times", F.col("inside").alias("article"))
    contents = leaves.groupBy("host", "node").agg((F.sum(F.col("times") * F.col("content")) / F.sum("times")).alias("below"), F.max("content").alias("most"), F.bool_or("article").alias("holds"))
    return nodes.join(contents, ["host", "node"]).withColumn("importance", CONTENT * F.col("below") + (1 - CONTENT) * F.col("presentation"))


def noisy_branches(tree: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host and node of the branches to remove, without those inside others."""
    highest = CONTENT * F.col("most") + (1 - CONTENT) * F.col("presentation")
    empty = F.when(F.col("inside"), F.col("marked") & (highest < LEAST_INSIDE)).otherwise(~F.col("holds") & (highest < LEAST))
    nearly = ~F.col("holds") & (F.col("importance") < LEAST_BRANCH)
    noisy = materialize(tree.where((F.col("pages") >= least_pages) & ~F.col("outside") & (empty | nearly)).select("host", "node", "up"))
    around = noisy.select("host", "node", F.explode(F.slice("up", 2, LEVELS + 2)).alias("other"))
    inner = around.join(noisy.select("host", F.col("node").alias("other")), ["host", "other"], "left_semi").select("host", "node").distinct()
    return noisy.select("host", "node").join(inner, ["host", "node"], "left_anti")


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row: the blocks of the article in page order, one a line.

    A null or empty page has an empty text; a page without a host is judged by its markup alone, and so are nodes that
    fewer than least_pages distinct pages of their host have. Repeated rows count as one page of their host and each get
    their text. Pages of any length are read whole; extra columns are not read.
    """
    noise = noisy_branches(style_tree(pages), least_pages)
    verdicts = materialize(noise.groupBy("host").agg(F.collect_set("node").alias("noise")))
    if (verdicts.agg(F.sum(F.size("noise") + 1)).first()[0] or 0) <= BROADCAST_NODES:
        verdicts = F.broadcast(verdicts)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(verdicts, "host", "left").select("page_id", "url", "html", "noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, noise in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                gone = frozenset(noise or ())
                texts.append("\n".join(b.text for b in blocks(page or "") if not b.outside and (not gone or gone.isdisjoint(b.node.up()))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return arrow_map(rows.select(F.col("page_id").cast("long"), "url", "html", "noise"), run, "page_id long, url string, text string, n_chars long")
