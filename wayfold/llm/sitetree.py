"""Main text of web pages by site style trees.

The pages of a host are merged into one style tree. A node is named by the path of tags and classes that leads to it; nodes are judged
where the markup groups or names something: sections, divs, lists, tables, and whatever has a class or id. Over the pages that have it,
a node has two entropies, both over the logarithm of the number of those pages: presentation, of the elements below it in order, and
content, of its units of text, so that a menu of which one item changes is still a menu. Its importance is content x (1 + presentation) / 2: what every page repeats is
worth nothing, new text in one layout half as much as new text in changing layouts.

What a page loses. A node's importance is taken relative to that of the page's main node (its article or main element with the most text, or
its largest top-level branch), so that a host of copies keeps its text. A branch below LOW goes. That is what pages tell; of a node that few pages have they tell little, so a
prior counts as much as DOUBT further pages: 1, or SUSPECT for a class or id word such as "sidebar" or "comments", times OUTSIDE beside the page's article or main element. A node of one
page is judged by its prior alone. An element that holds the page's article, or more than half of its text where no article is elsewhere, is no suspect, for a layout's wrapper is often named for what else it holds.
Tags and roles that say what they are (nav, footer, aside, form, script ...) are rules of markup and go at once; text that stands in no judged
node goes if articles have at least as much as the rest.

Two passes over the pages: nodes for the trees, then texts. Trees are tables of (host, node), summed with partial
aggregation, so a host of any share is spread by node and text. What the trees decide is joined to pages by the page, broadcast
only where it is small.

Defined results: a null or empty page has empty text; a null URL is a host of its own; a block without text is left out; br is white space; elements left open
end with their parent; unknown references stay as they are; repeated rows are answered each.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, join_ids, landed, read_table, under_own_names

#: A node goes if its importance relative to that of the page's main node, averaged over its pages but one and DOUBT pages of its prior, is below LOW.
LOW, DOUBT = 0.8, 1.0
#: Priors of a suspect and beside the page's article.
SUSPECT, OUTSIDE = 0.25, 0.85

# Elements of HTML by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCKS - frozenset("body html head title td th tr tbody thead tfoot option optgroup legend summary".split())
#: What an opening tag closes, up to what.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
UNIMPORTANT = frozenset("head nav footer aside form script style noscript noembed template iframe object svg math canvas audio video button select datalist input textarea title dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion sidebar sidenav aside menu nav navbar navigation topnav breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "comment comments commentlist disqus respond replies footer header masthead toolbar copyright legal disclaimer pagination pager login search widget widgets skip".split()
)
CONTENT = frozenset(["article", "main"])
#: Elements that are judged with their parents, unless they have a class or id.
PARTS = frozenset("html body h1 h2 h3 h4 h5 h6 p li dt dd tr td th tbody thead tfoot caption summary legend option figcaption pre".split())

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))|(?P<text>[^<]+|<)", re.S
)
ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I) for tag in RAW}
SPLIT = re.compile(r"[^a-z]+")


def _hash(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text, seed)


class _Open:
    """An element that is open."""

    __slots__ = ("tag", "node", "style", "drop", "content", "judged", "suspects", "around")

    def __init__(self, tag: str, node: int, style: str, drop: bool, content: bool, judged: bool = False, suspects: tuple[int, ...] = (), around: int = 0) -> None:
        self.tag, self.node, self.style, self.drop, self.content, self.judged = tag, node, style, drop, content, judged
        #: The nodes of suspects from the outermost on, and how many of them are around its article or main element.
        self.suspects, self.around = suspects, around


def _style(tag: str, rest: str) -> tuple[str, bool, bool]:
    """An element's style, whether it is unimportant from the start, and whether its class or id says so."""
    if not rest or "=" not in rest and "hidden" not in rest:
        return tag, tag in UNIMPORTANT, False
    classes, drop, suspect = "", tag in UNIMPORTANT, False
    for name, a, b, c in ATTRIBUTE.findall(rest):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            drop |= value in ROLES
        elif name == "hidden":
            drop = True
        elif name in ("class", "id"):
            words = SPLIT.split(value)
            if tag not in ("html", "body", "article", "main") and not WORDS.isdisjoint(words):
                suspect = True
            if name == "class":
                classes = "." + ".".join(sorted(w for w in words if w))
            else:
                classes += "#" + ".".join(w for w in words if w)
    return tag + classes, drop, suspect


class Page:
    """The text of a page outside dropped elements, by block: (judged nodes around it, outermost first, pieces, node of its article or main
    element); a piece has its suspects. children has the styles below each judged node in order."""

    def __init__(self, html: str) -> None:
        self.children: dict[int, list[str]] = {}
        self._stack: list[_Open] = [_Open("", 0, "", False, False)]
        self._text: list[tuple[tuple[int, ...], int, str]] = []
        self.blocks: list[tuple[tuple[int, ...], list[tuple[tuple[int, ...], int, str]], int | None]] = []
        at, n = 0, len(html)
        while at < n:
            m = MARKUP.match(html, at)
            at = m.end()
            tag = m["tag"]
            if tag is None:
                piece = m["text"] or m["cdata"]
                if piece and not self._stack[-1].drop:
                    self._add(piece if m["cdata"] or "&" not in piece else entities.unescape(piece))
                continue
            tag = tag.lower()
            if m["end"]:
                self._close(tag)
                continue
            self._start(tag, m["rest"])
            if tag in RAW:
                end = RAW_END[tag].search(html, at)
                at = end.end()
                self._close(tag)
        self._flush()
        self.trusted = self._trusted()

    def _add(self, piece: str) -> None:
        self._text.append((self._stack[-1].suspects, self._stack[-1].around, piece))

    def _flush(self) -> None:
        if self._text:
            around = [e for e in self._stack if e.node and e.tag in BLOCKS]
            content = next((e.node for e in around if e.content), None)
            self.blocks.append((tuple(e.node for e in around if e.judged), self._text, content))
            self._text = []

    def _trusted(self) -> set[int]:
        """The suspects that are kept: while all articles and main elements are in suspects, those that hold one or more than half of the text."""
        trusted: set[int] = set()
        pieces = [(s, around, sum(map(len, piece.split())), content is not None) for _, block, content in self.blocks for s, around, piece in block]
        if not any(s for s, *_ in pieces):
            return trusted
        sizes: dict[int, int] = {}
        holders: set[int] = set()
        for suspects, around, size, content in pieces:
            for node in set(suspects):
                sizes[node] = sizes.get(node, 0) + size
            if content and size:
                holders.update(suspects[:around])
        total = sum(size for _, _, size, _ in pieces)
        while not any(content and size and trusted.issuperset(s) for s, _, size, content in pieces):
            outer = {next((x for x in s if x not in trusted), None) for s, _, _, _ in pieces} - {None}
            new = {x for x in outer if x in holders or 2 * sizes[x] > total}
            if not new:
                break
            trusted |= new
        return trusted

    def _pop_to(self, depth: int) -> None:
        if any(e.tag in BLOCKS for e in self._stack[depth:]):
            self._flush()
        del self._stack[depth:]

    def _close(self, tag: str) -> None:
        for depth in range(len(self._stack) - 1, 0, -1):
            open_tag = self._stack[depth].tag
            if open_tag == tag:
                self._pop_to(depth)
                return
            if tag not in BLOCKS and open_tag in BLOCKS:
                return  # an inline end tag closes nothing beyond its block

    def _start(self, tag: str, rest: str) -> None:
        if tag in VOID:
            if tag == "br":
                if not self._stack[-1].drop:
                    self._add(" ")
            elif tag == "hr":
                self._flush()
            return
        if tag in CLOSES_P:
            for depth in range(len(self._stack) - 1, 0, -1):
                open_tag = self._stack[depth].tag
                if open_tag == "p":
                    self._pop_to(depth)
                    break
                if open_tag in BLOCKS:
                    break
        if tag in ENDS:
            closed, within = ENDS[tag]
            found = None
            for depth in range(len(self._stack) - 1, 0, -1):
                if self._stack[depth].tag in within:
                    break
                if self._stack[depth].tag in closed:
                    found = depth
            if found is not None:
                self._pop_to(found)
        if tag in BLOCKS:
            self._flush()
        style, drop, suspect = _style(tag, rest)
        parent = self._stack[-1]
        if tag == "header" and parent.content and not drop:
            drop = False  # an article's own header has its title
        elif tag == "header":
            drop = True
        content = parent.content or tag in CONTENT and not (drop or parent.drop)
        node = _hash(style, parent.node & 0xFFFFFFFFFFFFFFFF)
        judged = suspect or tag in BLOCKS and (tag not in PARTS or style != tag)
        if not parent.drop:
            for e in self._stack:
                if e.judged:
                    self.children.setdefault(e.node, []).append(style)
        if rest.rstrip(">").endswith("/") and tag not in BLOCKS and tag not in RAW:
            return
        suspects = (*parent.suspects, node) if suspect else parent.suspects
        around = parent.around if parent.content else len(parent.suspects) if content else 0
        self._stack.append(_Open(tag, node, style, drop or parent.drop, content, judged, suspects, around))

    def main(self, low: set[int], high: set[int] = frozenset()) -> str:
        """The text outside nodes that are `low` and suspects that are neither trusted nor `high`."""
        kept = []
        good = self.trusted | high
        for path, pieces, content in self.blocks:
            if low.isdisjoint(path):
                words = " ".join("".join(piece for suspects, _, piece in pieces if good.issuperset(suspects)).split())
                if words:
                    kept.append((words, content is not None, bool(path)))
        inside = sum(len(words) for words, content, _ in kept if content)
        if 2 * inside >= sum(len(words) for words, _, _ in kept) and inside:
            kept = [x for x in kept if x[1] or x[2]]
        return "\n".join(words for words, _, _ in kept)

    def nodes(self) -> Iterator[tuple[int, int, list[int], int, int]]:
        """(node, hash of the styles below it, hashes of its different units of text, main node, priors) of each judged node with text; priors are 1 for a suspect that
        isn't trusted, and 2 beside the page's article."""
        texts: dict[int, dict[int, None]] = {}
        articles: dict[int, int] = {}
        branches: dict[int, int] = {}
        priors: set[int] = set()
        for path, pieces, content in self.blocks:
            for suspects, _, piece in pieces:
                words = " ".join(piece.split())
                untrusted = [x for x in suspects if x not in self.trusted]
                priors.update(untrusted)
                if not words:
                    continue
                unit = _hash(words)
                for node in dict.fromkeys((*path, *suspects)):
                    texts.setdefault(node, {})[unit] = None
                if not untrusted:
                    for sizes, node in ((articles, content), (branches, path[0] if path else None)):
                        if node is not None:
                            sizes[node] = sizes.get(node, 0) + len(words)
        sizes = {k: v for k, v in articles.items() if k in texts} or branches
        root = max(sizes, key=lambda k: (sizes[k], k)) if sizes else 0
        about = {n for path, _, content in self.blocks if content == root for n in path} if root in articles else None
        for node, units in texts.items():
            yield node, _hash(" ".join(self.children.get(node, ()))), list(units), root, (node in priors) + 2 * (about is not None and node not in about)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


_NODES = {"page": pa.int64(), "host": pa.int64(), "node": pa.int64(), "style": pa.int64(), "units": pa.list_(pa.int64()), "root": pa.int64(), "prior": pa.int64()}


def style_nodes(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page, host, node, style, units, root, prior) for each judged node with text of each page; `pages` has page, host and html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page, host, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if body:
                    rows.extend((page, host, _signed(node), _signed(style), list(map(_signed, units)), _signed(root), prior) for node, style, units, root, prior in Page(body).nodes())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _NODES.values(), strict=True)], names=list(_NODES))

    return pages.select("page", "host", html).mapInArrow(run, "page long, host long, node long, style long, units array<long>, root long, prior long")


def importance(nodes: DataFrame) -> DataFrame:
    """(host, node, pages, importance): content x (1 + presentation) / 2, entropies over the pages that have the node: 1 where each has styles, or units, of its own, 0 where all have the same."""

    def surprise(values: DataFrame, name: str) -> DataFrame:
        counts = values.groupBy("host", "node", "value").agg(F.count("*").alias("n"))
        return counts.groupBy("host", "node").agg(F.sum("n").alias(f"{name}_n"), F.sum(F.col("n") * F.log("n")).alias(name))

    styles = surprise(nodes.select("host", "node", F.col("style").alias("value")), "style")
    units = surprise(nodes.select("host", "node", F.explode("units").alias("value")), "unit")
    pages = F.col("style_n")  # a node has one style a page
    of = {n: F.when(pages > 1, F.greatest(1 - F.col(n) / (F.col(f"{n}_n") * F.log(pages)), F.lit(0.0))).otherwise(1.0) for n in ("style", "unit")}
    return styles.join(units, ["host", "node"]).select("host", "node", pages.alias("pages"), (of["unit"] * (1 + of["style"]) / 2).alias("importance"))


def decisions(nodes: DataFrame) -> DataFrame:
    """(page, low, high): of each page that has any, the nodes that go, and the suspects that stay."""
    scored = landed(importance(nodes), "importance")
    of_root = scored.select("host", F.col("node").alias("root"), F.col("importance").alias("of_root"))
    both = join_ids(join_ids(nodes.select("page", "host", "node", "root", "prior"), scored, ["host", "node"], "left"), of_root, ["host", "root"], "left")
    relative = F.when(F.col("of_root") > 0, F.least(F.col("importance") / F.col("of_root"), F.lit(1.0))).otherwise(1.0)
    suspect, outside = (F.col("prior").bitwiseAND(bit) != 0 for bit in (1, 2))
    prior = F.when(suspect, SUSPECT).otherwise(1.0) * F.when(outside, OUTSIDE).otherwise(1.0)
    low = ((F.col("pages") - 1) * relative + DOUBT * prior) / (F.col("pages") - 1 + DOUBT) < LOW
    both = both.withColumn("low", low).filter(suspect != F.col("low"))  # else the page says the same
    lists = [F.collect_set(F.when(F.col("low") == which, F.col("node"))).alias(name) for name, which in (("low", True), ("high", False))]
    return both.groupBy("page").agg(*lists)  # a page's nodes


def extract(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """`pages`, without html, with main_text, the text of each page without its unimportant branches."""
    return under_own_names(pages, lambda p, c: _extract(p, c[url], c[html]), ("main_text",), (html,))


def _extract(pages: DataFrame, url: str, html: str) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    keyed = pages.withColumns({"_page": F.xxhash64(*pages.columns), "_host": F.xxhash64(host)})
    nodes = landed(style_nodes(keyed.select(F.col("_page").alias("page"), F.col("_host").alias("host"), html), html), "style-nodes")
    decided = landed(decisions(nodes).select(F.col("page").alias("_page"), "low", "high"), "decisions")
    found = join_ids(keyed, decided, "_page", "left")

    def make():
        def compute(batch: pa.RecordBatch) -> list[pa.Array]:
            out = []
            for body, *sets in zip(*(batch.column(c).to_pylist() for c in (html, "low", "high")), strict=True):
                out.append(Page(body).main(*({x & 0xFFFFFFFFFFFFFFFF for x in s or ()} for s in sets)) if body else "")
            return [pa.array(out, pa.string())]

        return compute

    return append_columns(found, [html, "low", "high"], [T.StructField("main_text", T.StringType())], make, [c for c in pages.columns if c != html])


def op5_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages."""
    found = extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
