"""Main text of web pages by wrapper induction over the pages of a host.

A page's elements are folded to its shape: the tree of distinct paths of elements (tag and classes), in which repeated
siblings are one node. The most frequent shape of a host is its reference, and simple tree matching aligns the shape of
each page with it; a page's text blocks so fall into slots that the host's pages share. Over all distinct pages of a
host, a text that stands in the same slot of nearly all is constant: it belongs to the template. What varies is content,
unless the slot's place says what it is: a menu, header, footer, sidebar, notice, advert, form or comment by its elements
and class names, or (outside an article) a slot that mostly holds links. If constant texts make up much of what the
host's pages say, the pages are copies of one article and nothing is taken for template.

The wrappers (one row a host: reference, constant texts, link slots) are aggregates of hashes; a host with most of the
pages is counted by many tasks. Pages are parsed once to induce and once to extract; no text is kept in between.

Defined cases: null or empty html gives an empty text. A null url counts as a host of its own. Malformed markup is read
as browsers do where they agree: unclosed elements end with their parent, stray end tags are passed over, a tag cut off at
the end of the page goes. Very long pages are read whole. Repeated rows are extracted alike. An empty table gives an empty
table. Ties between shapes go by hash. Other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from earshot.llm.common import spread_join
from earshot.session import materialize

# Elements of the HTML standard by what they mean for text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
NEVER = frozenset("head nav footer aside form dialog menu search button select option datalist label svg math canvas "
                  "object video audio noscript template fieldset".split())
CLOSES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
          "th": ("tr", "table"), "tbody": ("table",), "thead": ("table",), "tfoot": ("table",)}
GROUP = {"dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
         "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
# Words of class names, ids and roles that name what is no article, and what is one.
APART = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising advertorial sponsor sponsors sponsored promo promos "
    "promotion promoted banner nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidenav aside widget widgets "
    "footer masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup login signin form search social share sharing sharebar related recommended "
    "recommendations teaser teasers pagination pager paging skip contentinfo complementary copyright".split())
PARTS = frozenset("ad ads advert advertisement advertorial sponsored promo related recommended teaser teasers sidebar widget".split())
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
ARTICLES = frozenset("article story entry post".split())
CONTENTS = frozenset("content main maincontent".split())

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*+>|"
    r"<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|"
    r"<(?P<end2>/?)(?P<tag2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SWITCH = re.compile(r"(?:has|with|no|category|cat|tag|topic)[-_]", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DEEPEST = 200  # elements nested deeper share the node of this depth


@dataclass(slots=True)
class Node:
    """A node of a shape: all elements of a page with one path of signatures."""

    sign: str
    depth: int = 0
    children: dict[str, Node] = field(default_factory=dict)
    number: int = -1


@dataclass(slots=True)
class Element:
    tag: str
    node: Node
    region: int
    apart: bool
    comment: bool
    hard: bool


@dataclass(slots=True)
class Block:
    node: Node
    text: str
    links: int


def _labels(attrs: str) -> tuple[str, set[str]]:
    """Signature of the classes, and the words of classes, id and role (not of categories or of layout switches)."""
    classes, words = "", set()
    for name, *values in ATTRIBUTE.findall(attrs):
        value = next((v for v in values if v), "")
        for token in value.split():
            if not SWITCH.match(token):
                words.update(w.lower() for w in WORDS.findall(token))
        if name.lower() == "class":
            classes = ".".join(sorted({re.sub(r"[^a-z_#-]", "", re.sub(r"\d+", "#", c.lower())) for c in value.split()}))
    return classes, words


class Page:
    """The shape of a page and the text blocks that may be content, in page order."""

    def __init__(self, text: str | None):
        self.root = Node("")
        self.best = 0
        self.found: list[tuple[int, Block]] = []
        self._buffer: list[str] = []
        self._links = self._in_link = 0
        self.stack = [Element("", self.root, 0, False, False, False)]
        self._read(text or "")
        self._cut()
        numbered(self.root)
        #: The blocks of the strongest region that has any: articles, a main part, else all that isn't set apart.
        self.blocks = [b for region, b in self.found if region == self.best]

    def shape(self) -> str:
        """Signatures in order; `)` ends a node."""
        parts: list[str] = []

        def write(node: Node) -> None:
            parts.append(node.sign)
            for child in node.children.values():
                write(child)
            parts.append(")")

        write(self.root)
        return " ".join(parts)

    def _cut(self) -> None:
        """A block ends here."""
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text:
                top = self.stack[-1]
                self.best = max(self.best, top.region)
                self.found.append((top.region, Block(top.node, text, self._links)))
            self._buffer = []
        self._links = 0

    def _text(self, raw: str) -> None:
        if raw and not self.stack[-1].apart:
            raw = html.unescape(raw) if "&" in raw else raw
            self._buffer.append(raw)
            if self._in_link:
                self._links += len(raw.strip())

    def _read(self, text: str) -> None:
        last = text.rfind(">") + 1
        cut = re.compile(r"</?[A-Za-z]|<[!?]").search(text, last)  # a tag that the page's end cuts off
        text = text[:cut.start()] if cut else text
        at = 0
        while at < len(text):
            found = TOKEN.search(text, at)
            if not found:
                self._text(text[at:])
                return
            self._text(text[at:found.start()])
            at = found.end()
            if found["cdata"] is not None:
                self._text(found["cdata"])
            tag = (found["tag"] or found["tag2"] or "").lower()
            if not tag:
                continue
            if found["end"] or found["end2"]:
                self._end(tag)
                continue
            self._start(tag, found["attrs"] or found["attrs2"] or "")
            if tag in RAW:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(text, at)
                at = stop.end() if stop else len(text)

    def _start(self, tag: str, attrs: str) -> None:
        top = self.stack[-1]
        if tag in RAW:
            return
        if tag in VOID:
            if tag == "br":
                self._text(" ")
            elif tag == "hr":
                self._cut()
            return
        block = tag in BLOCKS
        if tag == "a":
            self._in_link = 1
        classes, words = _labels(attrs) if attrs else ("", ())
        inside, comment, named = top.region >= 4, False, False
        if words and tag not in ("html", "body"):
            comment = not words.isdisjoint(COMMENTS)
            named = not words.isdisjoint(PARTS if tag in ("article", "main") else APART)
        own = tag in NEVER or named or comment or (tag == "header" and not inside)
        if not block and not own and not (top.apart and top.tag == tag):
            return
        if block:
            self._cut()
            self._imply(tag)
            top = self.stack[-1]
        region, apart, was_comment, hard = top.region, top.apart or own, top.comment or comment, top.hard
        hard = hard or tag in ("nav", "footer", "aside", "header") and own
        if tag in ("article", "main") or "main" in words and "role" in attrs.lower():
            rank = 4 if tag == "article" else 3
            # An article stands for itself, whatever unclosed or wrapping element it is in; not so one among comments.
            if not inside and not (was_comment or hard or own):
                region, apart = max(region, rank), False
        elif words and tag not in ("html", "body") and not apart:
            region = max(region, 2 if not words.isdisjoint(ARTICLES) else 1 if not words.isdisjoint(CONTENTS) else 0)
        sign = f"{tag}.{classes}" if classes else tag
        if top.node.depth >= DEEPEST:
            node = top.node
        else:
            node = top.node.children.get(sign)
            if node is None:
                node = top.node.children[sign] = Node(sign, top.node.depth + 1)
        self.stack.append(Element(tag, node, region, apart, was_comment, hard))

    def _imply(self, tag: str) -> None:
        """Elements that the start of a block ends."""
        if self.stack[-1].tag == "p":
            self.stack.pop()
        if tag == "body" or tag not in ("html", "head"):
            if self.stack[-1].tag == "head":
                self.stack.pop()
        if tag in CLOSES:
            ends = GROUP.get(tag, (tag,))
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].tag in CLOSES[tag] or self.stack[k].tag in ("article", "main"):
                    return
                if self.stack[k].tag in ends:
                    del self.stack[k:]
                    return

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._in_link = 0
        if tag in BLOCKS:
            self._cut()
        elif not self.stack[-1].apart:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return
            # A stray end tag doesn't reach beyond the article or table cell it stands in.
            if self.stack[k].tag in ("article", "main", "td", "th") and tag not in ("body", "html", "table", "tr"):
                return


def read_shape(shape: str) -> Node:
    """The tree of a written shape, numbered as it was."""
    root, path, number = None, [], 0
    for sign in shape.split(" "):
        if sign == ")":
            path.pop()
            continue
        node = Node(sign, number=number)
        number += 1
        if path:
            path[-1].children[sign] = node
        else:
            root = node
        path.append(node)
    return root


def tree_matching(a: Node, b: Node) -> dict[int, int]:
    """Largest order-preserving match of two trees with equal roots: number in `a` to number in `b`."""
    memo: dict[tuple[int, int], list[list[int]]] = {}

    def weight(x: Node, y: Node) -> int:
        if x.sign != y.sign:
            return 0
        key = (x.number, y.number)
        if key not in memo:
            left, right = list(x.children.values()), list(y.children.values())
            table = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
            for i, p in enumerate(left):
                for j, q in enumerate(right):
                    table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + weight(p, q))
            memo[key] = table
        return memo[key][-1][-1] + 1

    found: dict[int, int] = {}

    def trace(x: Node, y: Node) -> None:
        found[x.number] = y.number
        left, right, table = list(x.children.values()), list(y.children.values()), memo[x.number, y.number]
        i, j = len(left), len(right)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                trace(left[i], right[j])

    if weight(a, b):
        trace(a, b)
    return found


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def hashed(text: str) -> int:
    return signed(xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def numbered(root: Node) -> list[Node]:
    """The nodes of a tree in the order in which it is written, numbered so."""
    order, nodes = [root], []
    while order:
        node = order.pop()
        node.number = len(nodes)
        nodes.append(node)
        order.extend(reversed(node.children.values()))
    return nodes


_SLOTS: dict[tuple[str, str], tuple[list[int], set[int]]] = {}


def slots_of(shape: str, reference: str) -> tuple[list[int], set[int]]:
    """Slot of each node of a shape: its match in the reference, else its own path; and the slots that matched."""
    key = (shape, reference)
    if key not in _SLOTS:
        if len(_SLOTS) >= 4096:
            _SLOTS.clear()
        root = read_shape(shape)
        match, nodes, paths = tree_matching(root, read_shape(reference)), numbered(root), {0: ""}
        for node in nodes:
            for child in node.children.values():
                paths[child.number] = f"{paths[node.number]}/{child.sign}"
        slots = [hashed(f"={match[n]}" if n in match else paths[n]) for n in range(len(nodes))]
        _SLOTS[key] = slots, {slots[n] for n in match}
    return _SLOTS[key]


def host_of(url: Column) -> Column:
    """The host of a url, empty for null."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


PARSED = "host string, shape string, page long, open boolean, nodes array<int>, texts array<long>, chars array<long>, links array<long>"


def parsed(pages: DataFrame) -> DataFrame:
    """Shape, hash of the blocks' texts and per block node, text hash, characters and characters in links."""
    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, text in zip(batch["host"], batch["html"]):
                page = Page(text)
                texts = [hashed(b.text) for b in page.blocks]
                rows.append((host, page.shape(), hashed(",".join(map(str, texts))), page.best == 0,
                             [b.node.number for b in page.blocks], texts, [len(b.text) for b in page.blocks],
                             [b.links for b in page.blocks]))
            yield pd.DataFrame(rows, columns=["host", "shape", "page", "open", "nodes", "texts", "chars", "links"])

    return pages.select("host", "html").mapInPandas(job, PARSED)


def induce(pages: DataFrame, url: str = "url", source: str = "html", constant: float = 0.75, fewest: int = 4,
           copies: float = 0.3) -> DataFrame:
    """One wrapper a host: `host`, `reference`, `constants` (slot and text hashes) and `menus` (slots).

    A text is constant if it stands in its slot on the share `constant` of the host's distinct pages, which are at least
    `fewest`; if constant texts are more than the share `copies` of all text, none is. Menus are slots of the reference
    that hold more links than other text.
    """
    read = materialize(parsed(pages.select(host_of(F.col(url)).alias("host"), F.col(source).alias("html"))))
    shapes = read.groupBy("host", "shape").count()
    references = shapes.groupBy("host").agg(F.max_by("shape", F.struct("count", F.xxhash64("shape"))).alias("reference"))
    references = materialize(references)

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            slots, matched = [], []
            for shape, reference, nodes in zip(batch["shape"], batch["reference"], batch["nodes"]):
                known, common = slots_of(shape, reference)
                slots.append([known[n] for n in nodes])
                matched.append([known[n] in common for n in nodes])
            yield batch[["host", "page", "open", "texts", "chars", "links"]].assign(slots=slots, matched=matched)

    placed = spread_join(read, references, "host").mapInPandas(
        job, "host string, page long, open boolean, texts array<long>, chars array<long>, links array<long>, "
             "slots array<long>, matched array<boolean>")
    blocks = materialize(placed.select("host", "page", "open", F.explode(F.arrays_zip("slots", "matched", "texts", "chars", "links"))
                                       .alias("b")).select("host", "page", "open", "b.*"))
    sizes = read.select("host", "page", F.aggregate("chars", F.lit(0).cast("long"), lambda a, c: a + c).alias("size")) \
        .distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.sum("size").alias("size")) \
        .where(F.col("pages") >= fewest)
    repeated = blocks.groupBy("host", "slots", "texts", "page").agg(F.max("chars").alias("chars")) \
        .groupBy("host", "slots", "texts").agg(F.count(F.lit(1)).alias("n"), F.max("chars").alias("chars")) \
        .where(F.col("n") >= F.lit(constant * fewest))
    frequent = spread_join(repeated, sizes, "host").where(F.col("n") >= F.lit(constant) * F.col("pages"))
    constants = frequent.groupBy("host").agg(
        F.collect_list(F.concat_ws(":", "slots", "texts")).alias("constants"), F.sum(F.col("n") * F.col("chars")).alias("said"),
        F.first("size").alias("size")).where(F.col("said") <= F.lit(copies) * F.col("size")).select("host", "constants")
    menus = blocks.where("open AND matched").groupBy("host", "slots").agg(F.sum("links").alias("links"), F.sum("chars").alias("chars")) \
        .where("2 * links > chars").groupBy("host").agg(F.collect_list("slots").alias("menus"))
    return references.join(constants, "host", "left").join(menus, "host", "left")


def content(page: Page, reference: str | None, constants: list[str] | None, menus: list[int] | None) -> str:
    """The varying blocks of a page, joined by empty lines."""
    if not page.blocks:
        return ""
    slots, matched = slots_of(page.shape(), reference or "")
    fixed, lists = set(() if constants is None else constants), set()
    if page.best == 0:  # no article: slots of links go; those the reference lacks are judged by this page alone
        sums: dict[int, tuple[int, int]] = {}
        for b in page.blocks:
            links, chars = sums.get(slots[b.node.number], (0, 0))
            sums[slots[b.node.number]] = links + b.links, chars + len(b.text)
        lists = {s for s, (links, chars) in sums.items() if s not in matched and 2 * links > chars}
        lists.update(() if menus is None else menus)
    return "\n\n".join(b.text for b in page.blocks if slots[b.node.number] not in lists
                       and f"{slots[b.node.number]}:{hashed(b.text)}" not in fixed)


def extract(pages: DataFrame, wrappers: DataFrame, page_id: str = "page_id", url: str = "url",
            source: str = "html") -> DataFrame:
    """`page_id`, `url`, `text` and `n_chars` (its code points) of each page."""
    rows = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(source).alias("html"),
                        host_of(F.col(url)).alias("host"))

    def job(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [content(Page(h), r, c, m) for h, r, c, m in zip(
                batch["html"], batch["reference"], batch["constants"], batch["menus"])]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts,
                                "n_chars": [len(t) for t in texts]})

    found = spread_join(rows, wrappers, "host").mapInPandas(job, "page_id string, url string, text string, n_chars long")
    return found.withColumn("page_id", F.col("page_id").cast(pages.schema[page_id].dataType))


def main_text(pages: DataFrame) -> DataFrame:
    """Wrappers induced from the pages, applied to them."""
    return extract(pages, induce(pages))
