"""Main text of pages by a site style tree.

The elements of all pages of a host are merged by their path of tags, classes
and ids. A node of the merged tree has a presentation importance, the entropy of
how its pages lay it out (how often it stands there, and with which children),
and a content importance, the entropy of its text, each divided by the largest
entropy of so many pages; copies of a page, and of the article that a node is
in, are counted once, so that copied texts don't look like templates. How sure
both are grows with the pages (1 - 1 / pages).

The tree tells first where the text of a page is: in the element of the greatest
product of its share of the page's characters and its presentation importance
(``FLOOR`` added, as some sites write all texts in one form). What a page
declares is a factor of that, ``MAIN`` for an article, ``SIDE`` for a menu,
footer and so on, so a site that lays out its texts in something undeclared, or
declares a teaser to be its article, is read by its layout. Then each branch has
a sum: ``INSIDE`` in that element, ``BESIDE`` out of it, nought where no element
stands out; less where it declares itself a menu, advert, notice and so on
(``SOFT``); and the tree's evidence, up to ``VARIED`` for layouts and ``NEW``
for texts that always differ, down to ``SAME`` for a text that never does. So
entropy overrules a declaration both ways. Only what reader comments and forms
declare stays decided (``HARD``), as they differ from page to page like
articles do. A branch whose sum is below nought goes, with all in it; of the
rest the text stays. Where all text would go, the page is judged alone.

Elements are counted as numbers of (site, path, value) with map-side combining,
so a host with most of the pages is dealt out by its contents. The merged tree
goes back to the pages as a whole where it is small, else each page gets its
own nodes by a join; html is read twice.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, lean, written
from .url_filter import split_url

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style noscript template iframe textarea title svg object select canvas audio video xmp noembed noframes button".split())
ASIDE_TAGS = frozenset("head nav footer aside form menu dialog fieldset".split())
HARD_TAGS = frozenset("head form dialog fieldset".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: What a class or id calls a branch, alone ("ad"), in a box ("comment-list") or of something ("user-comments"); any other word in the name and it says nothing ("history-of-the-menu").
HARD_NAMES = frozenset("comment comments form respond".split())
ASIDE_NAMES = HARD_NAMES | frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs consent cookie cookies footer header masthead "
    "menu menus nav navbar navigation newsletter notice notices popup sidebar sponsor sponsored".split()
)
BOXES = frozenset("area bar block box container group inner list section thread wrap wrapper".split())
OF_WHAT = frozenset("article blog bottom desktop global google left main mobile page post primary privacy reader right secondary side site sub text top user web".split())
MAIN_TAGS = frozenset(("article", "main"))
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"},
}
SCOPE = frozenset("ul ol dl table article main section div nav aside body html".split())

FLOOR, MAIN, SIDE, CLEAR = 0.25, 2.5, 0.5, 0.3  # of where the text is: added to the presentation importance, factors of declarations, importance of an undeclared element
INSIDE, BESIDE, SOFT, HARD = 2.0, -1.5, -3.5, -9.0  # of a branch; beside the text a soft declaration takes SLIGHT
SLIGHT = -0.7
VARIED, NEW, SAME = 2.0, 0.5, -4.0  # evidence of layouts and texts that always differ, and of texts that never do
SHARP = 8  # power by which evidence against a branch falls as its text varies
SENT = 200_000  # nodes of the merged trees that may be sent to all

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]*))?", re.S)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
DIGITS = re.compile(r"\d+")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>?", re.I) for tag in RAW}


def _hash(x: bytes) -> int:
    return xxhash.xxh64_intdigest(x) - (1 << 63)


def _bytes(x: str) -> bytes:
    return x.encode("utf-8", "surrogatepass")


class Element:
    """A block element: its place in the merged tree, what it declares, and digests of what it holds."""

    __slots__ = ("tag", "names", "parent", "main", "aside", "hard", "header", "children", "held", "chars", "content", "holder", "path")

    def __init__(self, tag: str, parent: int, attributes: str):
        self.tag, self.parent = tag, parent
        self.main, self.aside, self.hard, self.header = tag in MAIN_TAGS, tag in ASIDE_TAGS, tag in HARD_TAGS, tag == "header"
        self.children: list[str] = []
        self.held: list[bytes] = []
        self.chars = 0
        self.names = ""
        if attributes and not attributes.isspace():
            self._declared(attributes)

    def _declared(self, attributes: str) -> None:
        found: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(attributes):
            found.setdefault(m[1].lower(), (m[2] or "").strip("\"'"))
        names = [*found.get("class", "").split(), *found.get("id", "").split()]
        self.names = DIGITS.sub("#", " ".join(names)).lower()
        role = found.get("role", "").lower()
        self.main = self.main or role == "main" or found.get("itemprop", "").lower() == "articlebody"
        hidden = "hidden" in found or "display:none" in found.get("style", "").replace(" ", "").lower()
        self.hard = self.hard or hidden or role in ("form", "search", "dialog", "alertdialog")
        self.aside = self.aside or hidden or role in ASIDE_ROLES
        if self.tag not in ("html", "body"):
            for name in names:
                words = [w.lower() for w in NAME_WORD.findall(name)]
                told = [w for w in words if w in ASIDE_NAMES]
                if told and all(w in ASIDE_NAMES or w in BOXES or w in OF_WHAT for w in words):
                    if set(told) == {"header"}:
                        self.header = True
                    else:
                        self.aside, self.hard = True, self.hard or not HARD_NAMES.isdisjoint(told)


def parse(html: str) -> tuple[list[Element], list[tuple[str, int]]]:
    """Block elements in page order, of which the first is the page, and blocks of text with the element around each."""
    elements = [Element("", -1, "")]
    blocks: list[tuple[str, int]] = []
    stack: list[tuple[str, int]] = [("", 0)]  # tag, nearest block element
    buffer: list[str] = []

    def flush() -> None:
        if buffer:
            text = " ".join(unescape("".join(buffer)).split())
            buffer.clear()
            if text:
                at = stack[-1][1]
                blocks.append((text, at))
                elements[at].held.append(b"t" + _bytes(text))
                elements[at].chars += len(text)

    def close() -> None:
        if stack[-1][0] in BLOCK:
            flush()
        stack.pop()

    at, end = 0, len(html)
    while at < end:
        m = MARKUP.search(html, at)
        if m is None:
            buffer.append(html[at:])
            break
        if m.start() > at:
            buffer.append(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                buffer.append(m[0][9:-3])
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                buffer.append(" ")
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    while len(stack) > k:
                        close()
                    break
            continue
        attributes = m[3] or ""
        if tag in RAW and not attributes.rstrip().endswith("/"):
            stop = _RAW_END[tag].search(html, at)
            at = stop.end() if stop else (end if tag in ("script", "style") else at)
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            shut = CLOSES.get(tag)
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p" or (shut and stack[k][0] in shut):
                    while len(stack) > k:
                        close()
                    if not shut:
                        break
                elif stack[k][0] in SCOPE:
                    break
        if tag in VOID or attributes.rstrip().endswith("/"):
            if tag == "br":
                buffer.append(" ")
            continue
        parent = stack[-1][1]
        if tag not in BLOCK:
            stack.append((tag, parent))
            continue
        elements[parent].children.append(tag)
        elements[parent].held.append(b"")  # to be the child's digest
        stack.append((tag, len(elements)))
        elements.append(Element(tag, parent, attributes))
    while len(stack) > 1:
        close()
    flush()
    _finish(elements)
    return elements, blocks


def _finish(elements: list[Element]) -> None:
    """Digests and lengths from the leaves up, then paths and holders from the root down."""
    inner: list[list[bytes]] = [[] for _ in elements]
    for i in range(len(elements) - 1, -1, -1):
        e = elements[i]
        below = iter(reversed(inner[i]))
        digest = xxhash.xxh64(b"\n".join(h or next(below) for h in e.held)).digest()
        e.content = int.from_bytes(digest, "big") - (1 << 63)
        if i:
            inner[e.parent].append(digest)
            elements[e.parent].chars += e.chars
    best, region, above = _declared_text(elements)
    inside = [False] * len(elements)
    for i, e in enumerate(elements):
        inside[i] = i == region or (i > 0 and inside[e.parent])
        e.holder = elements[region if inside[i] and i != region else 0].content
        teaser = e.tag == "article" and i not in above
        e.path = _hash(_bytes(f"{elements[e.parent].path if i else 0} {e.tag} {e.names}{' +' if teaser else ''}"))


def _above(elements: list[Element], i: int | None) -> set[int]:
    out = set()
    while i is not None and i >= 0:
        out.add(i)
        i = elements[i].parent
    return out


def _declared_text(elements: list[Element]) -> tuple[int | None, int | None, set[int]]:
    """The longest declared article, the outermost declared element that it is in, and all that it is in; not in what declares itself beside the text."""
    within = [False] * len(elements)
    for i, e in enumerate(elements):
        within[i] = e.aside or (i > 0 and within[e.parent])
    mains = [i for i, e in enumerate(elements) if e.main and not within[i]]
    articles = [i for i in mains if elements[i].tag != "main"] or mains
    best = max(articles, key=lambda i: (elements[i].chars, -i), default=None)
    above = _above(elements, best)
    return best, min((i for i in above if elements[i].main), default=None), above


Node = tuple[float, float]  # presentation importance, as sure as it is, and evidence


def _text_in(elements: list[Element], nodes: dict[int, Node], declared: bool) -> tuple[int | None, set[int]]:
    """The element that the page's text is in (None where none stands out), and all that this, or the article in it, is in."""
    total = max(1, elements[0].chars)

    def score(i: int) -> float:
        e = elements[i]
        factor = (MAIN if e.main else SIDE if e.aside or e.header else 1.0) if declared else 1.0
        return e.chars / total * (FLOOR + nodes.get(e.path, (0.0, 0.0))[0]) * factor

    told, region, above = _declared_text(elements) if declared else (None, None, set())
    whole = [i for i, e in enumerate(elements) if e.tag in ("", "html", "body")]
    clear = [i for i, e in enumerate(elements) if e.tag not in ("", "html", "body") and i not in above and nodes.get(e.path, (0.0, 0.0))[0] >= CLEAR]
    best = max(clear, key=lambda i: (score(i), -i), default=None)
    if best is not None and score(best) > max((score(i) for i in whole), default=0.0) and (region is None or (region not in _above(elements, best) and score(best) > score(region))):
        return best, _above(elements, best)
    return region, above


def node_rows(elements: list[Element]) -> Iterator[tuple[int, int, int, int]]:
    """``path, kind, value, holder`` of each element's text (kind 0), and of how the page lays out each path that holds elements (kind 1: the children of all its elements there); the holder is the text of its article or page."""
    laid_out: dict[tuple[int, int], list[str]] = {}
    for e in elements[1:]:
        yield e.path, 0, e.content, e.holder
        laid_out.setdefault((e.path, e.holder), []).append(" ".join(e.children))
    for (path, holder), shapes in laid_out.items():
        if any(shapes):
            yield path, 1, _hash("|".join(shapes).encode()), holder


def chosen(html: str, nodes: dict[int, Node], declared: bool = True) -> list[str]:
    """Texts of the blocks whose branches all have a sum of nought or more; without ``declared`` by the tree alone."""
    elements, blocks = parse(html)

    def kept(nodes: dict[int, Node]) -> list[str]:
        region, above = _text_in(elements, nodes, declared)
        inside, stays = [False] * len(elements), [True] * len(elements)
        for i, e in enumerate(elements[1:], 1):
            inside[i] = i == region or inside[e.parent]
            told = INSIDE if inside[i] or i in above else 0.0 if region is None else BESIDE
            if declared:
                teaser = e.tag == "article" and e.main and i not in above and region is not None  # another article, or a comment in the article
                if e.hard or teaser:
                    told += HARD
                elif (e.aside or (e.header and not inside[i])) and i not in above:
                    told += SLIGHT if told == BESIDE else SOFT
            stays[i] = stays[e.parent] and told + nodes.get(e.path, (0.0, 0.0))[1] >= 0
        return [t for t, i in blocks if stays[i]]

    return kept(nodes) or kept({})


def tree_nodes(pages: DataFrame) -> DataFrame:
    """``site, path, kind, value, holder`` of the elements of ``pages (site, html)``."""
    names = ["site", "path", "kind", "value", "holder"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(s, *r) for s, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in node_rows(parse(h or "")[0])}
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return pages.select("site", "html").mapInArrow(lean(run), "site long, path long, kind int, value long, holder long")


def importance(nodes: DataFrame) -> DataFrame:
    """``site, path, n, presentation, content, evidence`` of the merged tree's nodes.

    ``n``: pairs of its text and the article or page that holds it. The
    importances are the entropies of its layouts and of its texts over these,
    divided by their logarithm (1 for a single text, 0 for a single layout, and
    for nodes that hold no elements).
    """
    each = nodes.distinct().groupBy("site", "path", "kind", "value").agg(F.count(F.lit(1)).alias("c"))
    sums = [F.sum(F.when(F.col("kind") == k, v)).alias(f"{a}{k}") for k in (0, 1) for a, v in (("n", F.col("c")), ("s", F.col("c") * F.log("c")))]
    found = each.groupBy("site", "path").agg(*sums)

    def relative(k: int, alone: float) -> F.Column:
        n = F.col(f"n{k}")
        return F.coalesce(F.when(n > 1, 1 - F.col(f"s{k}") / (n * F.log(n))), F.lit(alone))

    out = found.select("site", "path", F.col("n0").alias("n"), "n1", relative(1, 0.0).alias("presentation"), relative(0, 1.0).alias("content"))
    sure = 1 - 1 / F.col("n")
    layouts = VARIED * F.coalesce(1 - 1 / F.col("n1"), F.lit(0.0)) * F.col("presentation")
    texts = sure * (NEW - (NEW - SAME) * (1 - F.col("content")) ** SHARP)
    # a text that never differs is a template however it is laid out
    return out.withColumn("evidence", texts + F.col("content") * layouts).drop("n1")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", declared: bool = True) -> DataFrame:
    """``<id_col>, <url_col>, text, n_chars`` of every row.

    Null and empty pages have an empty text; pages without a host make one
    site, and a site of one page has no evidence, so there declarations decide
    alone. Branches with a sum of nought stay. Of elements that are as likely
    to hold the text the first one does. Repeated rows stay repeated and count
    once; extra columns are ignored; an empty table gives an empty one.
    Without ``declared`` the tree decides alone.
    """
    host, _ = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.xxhash64(host).alias("site"), F.col(html_col).alias("html"))
    # of one page nothing is known
    told = importance(tree_nodes(rows)).where("n > 1").select("site", "path", "n", (F.col("presentation") * (1 - 1 / F.col("n"))).alias("presentation"), "evidence")
    tree = written(told)

    def text_of(html: str | None, nodes: dict[int, Node]) -> str:
        return "\n".join(chosen(html or "", nodes, declared)).encode("utf-8", "replace").decode()

    names, kinds = ["id", "url", "text"], "id long, url string, text string"
    if tree.count() <= SENT:
        sites: dict[int, dict[int, Node]] = {}
        got = tree.toArrow()
        for site, path, *node in zip(*(got.column(c).to_pylist() for c in ("site", "path", "presentation", "evidence")), strict=True):
            sites.setdefault(site, {})[path] = tuple(node)
        sent = pages.sparkSession.sparkContext.broadcast(sites)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [text_of(h, sent.value.get(s, {})) for s, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names)

        out = rows.mapInArrow(lean(run), kinds)
    else:
        keyed = rows.withColumn("page", F.xxhash64("site", "html"))

        def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = {(s, p, e.path) for s, p, h in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) for e in parse(h or "")[0][1:]}
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["site", "page", "path"])

        held = written(keyed.select("site", "page", "html").mapInArrow(lean(paths), "site long, page long, path long").distinct())
        size = written(held.groupBy("site", "path").agg(F.count(F.lit(1)).alias("pages")).join(tree, ["site", "path"]))
        met = by_key(held, size, ["site", "path"], "pages")
        lists = met.groupBy("site", "page").agg(F.collect_list(F.struct("path", "presentation", "evidence")).alias("nodes"))  # of one page

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [text_of(h, {x["path"]: (x["presentation"], x["evidence"]) for x in nodes or ()}) for h, nodes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names)

        out = keyed.join(lists, ["site", "page"], "left").select("id", "url", "html", "nodes").mapInArrow(lean(joined), kinds)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text").withColumn("n_chars", F.length("text").cast("long"))


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return main_text(pages)
