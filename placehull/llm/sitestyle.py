"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of tags with their classes. Over the pages that have a
node, the presentation entropy (how its sequences of children differ) and the content entropy (how its texts differ) are scaled to 0..1 by the
logarithm of the number of pages, and importance = 0.1 * presentation + 0.9 * content. Branches below ``IMPORTANT``, seen on at
least ``PAGES`` pages of the host, are the site's own furniture and are removed from each page, inside articles as well. An article
or main element as a whole is never judged, and where its own content is of low importance (a copied article is an article still) neither
are its branches. Parts that say what they are (navigation, headers, footers, asides, forms, adverts, notices, reader comments, scripts,
styles) are removed by tag, class, id or role on every page; inside articles a class like ``related-work`` says nothing unless
every word of it does, and the tree decides. If a page has an article or main element, only that is main text.

Only sums over (host, node, feature) are shuffled, partly summed before; the list of low branches per host is joined back. No page is shuffled while
that list is small enough for Spark to send it along.

White space inside a block becomes one space, blocks are joined by one space in page order; character references are decoded. Nulls and
ties: null html counts as empty and gives an empty text; a null url is a host of its own; equal rows get equal texts. An empty table returns an
empty one. Input columns named ``text`` or ``n_chars`` are replaced. Broken and deep pages: a ``<`` that begins no whole tag is
text; time and memory grow with the page's length, whatever its depth.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placehull.llm.base import table
from placehull.session import stage

IMPORTANT, PAGES = 0.1, 8
PRESENTATION, CONTENT = 0, 1

#: HTML element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - {"option", "html", "head", "body"}
NOISE_TAGS = set("head title nav aside footer form dialog menu button select option fieldset noscript template svg iframe object canvas audio video datalist".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
NOISE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs "
    "sidebar side aside footer header masthead topbar cookie cookies consent gdpr notice notification popup modal overlay newsletter subscribe signup share sharing "
    "social related recommended recommendations widget toolbar pagination pager login search form skip".split()
)
ADVERT_NAMES = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr newsletter popup".split())
COMMENT_NAMES = set("comment comments commentlist replies reply respond disqus discussion reviews".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|xmp|title)\b[^<>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*+\"|'[^']*+'|[^<>\"'])*+)>|<[!?][^<>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


PRIME, BASE = (1 << 61) - 1, 0x1F0E1D2C3B4A5968


class Sequence:
    """Hash of a sequence of texts, which two neighbours' hashes make together in one step."""

    __slots__ = ("hash", "factor")

    def __init__(self):
        self.hash, self.factor = 0, 1

    def add(self, value: int, factor: int = BASE) -> None:
        self.hash = (self.hash * factor + value) % PRIME
        self.factor = self.factor * factor % PRIME


class Element:
    """``said``: it, or one around it, says that it is no main text; ``low``: the tree does; ``fixed``: the tree is not asked."""

    __slots__ = ("tag", "path", "said", "low", "main", "fixed", "children", "texts")

    def __init__(self, tag: str, path: int, said: bool, low: bool, main: bool, fixed: bool):
        self.tag, self.path, self.said, self.low, self.main, self.fixed = tag, path, said, low, main, fixed
        self.children: list[str] = []
        self.texts = Sequence()


def names_of(attributes: dict[str, str]) -> set[str]:
    """Words of class and id, split at case and punctuation, in lower case."""
    return {w.lower() for k in ("class", "id") for w in _NAME.findall(attributes.get(k, ""))}


def is_noise(tag: str, attributes: dict[str, str], main: bool) -> bool:
    """Whether an element says that it is no main text; ``main``: it stands in an article or main element."""
    names = names_of(attributes)
    if names & COMMENT_NAMES:
        return True
    if tag in ("article", "main", "body", "html", "h1"):
        return False
    style = attributes.get("style", "").replace(" ", "").lower()
    if tag in NOISE_TAGS or "hidden" in attributes or "display:none" in style or (tag == "header" and not main):
        return True
    named = bool(names & ADVERT_NAMES) or (bool(names) and names <= NOISE_NAMES) if main else bool(names & NOISE_NAMES)
    return named or attributes.get("role", "").lower() in NOISE_ROLES


def parse(page: str, low: frozenset[int] | set[int] = frozenset()):
    """(blocks, elements): main-text candidates as (in article, text), and every element closed, with its path, children and texts.

    Elements whose path is in ``low`` are removed, but for articles and what is in an article whose own path is in it.
    """
    blocks: list[tuple[bool, str]] = []
    done: list[Element] = []
    stack = [Element("", 0, False, False, False, False)]
    opened: Counter[str] = Counter([""])  # elements on the stack by tag: a search that finds nothing is not begun
    piece: list[str] = []

    def flush() -> None:
        if not piece:
            return
        text = " ".join(entities.unescape("".join(piece)).split())
        piece.clear()
        if text:
            top = stack[-1]
            top.texts.add(xxhash.xxh3_64_intdigest(text))
            if not (top.said or top.low):
                blocks.append((top.main, text))

    def pop(to: int) -> None:
        """Close elements; a closed one's texts go on to the one around it."""
        flush()
        while len(stack) > to:
            closed = stack.pop()
            opened[closed.tag] -= 1
            done.append(closed)
            if stack:
                stack[-1].texts.add(closed.texts.hash, closed.texts.factor)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        closing, tag = m[2], (m[3] or "").lower()
        if not tag:
            continue
        if closing:
            if opened[tag]:
                pop(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                piece.append(" ")
            continue
        raw = m[4]
        attributes = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(raw)} if len(raw) > 1 else {}
        top = stack[-1]
        noise = is_noise(tag, attributes, top.main)
        if tag not in BLOCK and not noise:
            continue  # inline elements neither break a block nor make a node
        if tag in BLOCK:
            flush()
            alike = tag in ("li", "option", "tr", "td", "th", "dt", "dd") and opened[tag]
            for i in range(len(stack) - 1, 0, -1) if alike or opened["p"] else ():
                open_tag = stack[i].tag
                if (open_tag == "p" and tag in CLOSES_P) or (open_tag == tag and alike):
                    pop(i)
                    break
                if open_tag in ("div", "section", "article", "table", "ul", "ol", "td", "th", "body", "main"):
                    break
            top = stack[-1]
        label = f"{tag}.{attributes.get('class', '')}"
        path = xxhash.xxh3_64_intdigest(label, seed=top.path) >> 1
        main = top.main or tag in ("article", "main")
        top.children.append(label)
        if raw.endswith("/") and tag not in BLOCK:
            continue
        opened[tag] += 1
        if main and not top.main:  # an article begins: what is said of the parts around it by the tree does not hold
            stack.append(Element(tag, path, top.said or noise, False, True, path in low))
        else:
            judged = path in low and not top.fixed and tag not in ("html", "body")
            stack.append(Element(tag, path, top.said or noise, top.low or judged, main, top.fixed))
    if at < len(page):
        piece.append(page[at:])
    pop(0)
    return blocks, done


def main_text(page: str | None, low=frozenset()) -> str:
    blocks, _ = parse(page or "", low)
    if any(main for main, _ in blocks):
        blocks = [b for b in blocks if b[0]]
    return " ".join(text for _, text in blocks)


def host(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, node, kind, feature): per page and node one presentation and one content feature."""
    for batch in batches:
        hosts, nodes, kinds, features = [], [], [], []
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            merged: dict[int, tuple[list[str], Sequence]] = {}
            for e in parse(page or "")[1]:
                children, texts = merged.setdefault(e.path, ([], Sequence()))
                children += ["(", *e.children]
                texts.add(e.texts.hash, e.texts.factor)
            for path, (children, texts) in merged.items():
                hosts += [h, h]
                nodes += [path, path]
                kinds += [PRESENTATION, CONTENT]
                features.append(xxhash.xxh3_64_intdigest(" ".join(children)) >> 1)
                features.append(texts.hash)
        columns = [pa.array(hosts, pa.string()), pa.array(nodes, pa.int64()), pa.array(kinds, pa.int32()), pa.array(features, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["host", "node", "kind", "feature"])


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, node, pages, importance) of the merged trees, from (host, html)."""
    rows = pages.select("host", "html").mapInArrow(_nodes, "host string, node long, kind int, feature long")
    seen = rows.groupBy("host", "node", "kind", "feature").count()
    n = F.col("count")
    sums = seen.groupBy("host", "node").agg(
        (F.sum(n) / 2).alias("pages"),
        *[F.sum(F.when(F.col("kind") == k, n * F.log(n))).alias(name) for k, name in ((PRESENTATION, "p"), (CONTENT, "c"))],
    )
    m = F.col("pages")
    entropy = lambda s: F.when(m > 1, (F.log(m) - F.col(s) / m) / F.log(m)).otherwise(1.0)
    return sums.select("host", "node", "pages", (0.1 * entropy("p") + 0.9 * entropy("c")).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html) with text and n_chars."""
    rows = pages.drop("text", "n_chars").withColumn("__host", host(F.col("url")))
    tree = style_tree(rows.select(F.col("__host").alias("host"), "html"))
    low = tree.filter((F.col("importance") < IMPORTANT) & (F.col("pages") >= PAGES))
    low = stage(low.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("__low")), "low")
    joined = rows.join(low, F.col("__host") == F.col("host"), "left").drop("__host", "host")
    names = [c for c in joined.columns if c != "__low"]

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, last, mine = [], None, frozenset()
            for page, nodes in zip(batch.column("html"), batch.column("__low")):
                nodes = nodes.as_py()
                if nodes != last:
                    last, mine = nodes, frozenset(nodes or ())
                found.append(main_text(page.as_py(), mine))
            columns = [batch.column(c) for c in names] + [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "text", "n_chars"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "__low")
    return joined.mapInArrow(texts, f"{kinds}, text string, n_chars long")


def op5_site_style_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", "n_chars")
