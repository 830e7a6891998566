"""Main text of web pages through a site style tree.

The distinct pages of a host are merged by the styles of their nodes: a style node is a path of block elements with their classes
(but for names with digits, which differ from page to page). Two things tell what a node is worth. Its *contents*: a text that c of the
node's m pages have has the entropy log_m c, and a content is worth 1 less that. Its *presentation*: the entropy of the sequences of
child elements that the node has over its pages. A branch takes the contents of all nodes in it, each by how often it occurs, and its
own presentation; its importance is

    prior * (1 - (1 - contents) * (1 - (1 - 0.9 ** styles) * presentation)).

What says the same in the same form on page after page has importance 0. Branches below MIN_IMPORTANCE are removed from each page, as
long as they hold less than half of what is important on their host, and wherever they are, inside the article too. The prior is 0 for
branches whose element, role, class or id names them as menus, headers, footers, sidebars, notices, adverts, forms or comments, and for
what is outside the article of a page that marks one; else it is 1.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .components import Shelf

MIN_PAGES, MIN_IMPORTANCE, GAMMA, MAX_SHARE = 8, 0.3, 0.9, 0.5
MAX_DEPTH = 64  # deeper nodes have the style of their ancestor there; their text is text like any other
BROADCAST_ROWS = 100_000

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=\"']++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)>")
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements whose content is dropped whole: to the end tag; RAW ones hold no elements.
RAW = frozenset("script style noscript template iframe title textarea".split())
DROPPED = frozenset("svg select button object".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"body", "html", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th")}
NOISE_TAGS = frozenset("nav footer aside form menu head dialog".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies notice notices consent gdpr popup modal overlay newsletter subscribe signup login share sharing social related recommended comment comments reply replies respond disqus "
    "form search toolbar pagination pager copyright legal disclaimer skip alert".split()
)
#: Words beside which a noise name still names furniture: "comments-area", "site-footer"; not "share-price".
PLACE_NAMES = frozenset(
    "area article articles bar block body bottom box button buttons container content dfp entry form global google group icon icons inner item items left link links list main message outer page post posts primary "
    "reader right row secondary section site slot text thread title top unit user wrap wrapper x".split()
)
#: Beginnings of names that tell something of the page's layout, not of the element.
LAYOUT_NAMES = frozenset("has no with without is not".split())
#: Elements that hold text themselves: furniture only if all of a name says so.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th pre blockquote figcaption caption".split())
ARTICLE_NAMES = frozenset("articlebody article-body post-content entry-content".split())
NAME, DIGIT = re.compile(r"[A-Za-z]+"), re.compile(r"\d")


class Closings:
    """Where an element's next start or end tag is; every stretch of the page is searched once for each element."""

    def __init__(self, page: str):
        self.page, self.found = page, {}

    def next(self, tag: str, at: int, closing: bool) -> int:
        """The first place from ``at``, or the page's length."""
        place = self.found.get((tag, closing), -1)
        if place < at:
            m = re.compile(rf"<{'/' * closing}{tag}\b", re.I).search(self.page, at)
            place = self.found[tag, closing] = m.start() if m else len(self.page)
        return place

    def end_of(self, tag: str, at: int) -> int:
        """Where reading goes on behind an element whose start tag ends at ``at``. Without an end tag only the start tag goes,
        with the text that follows a raw one."""
        page, stop = self.page, self.next(tag, at, True)
        if stop < len(page) and not (tag in DROPPED and self.next(tag, at, False) < stop):
            return (page.find(">", stop) + 1) or len(page)
        if tag in DROPPED:
            return at
        stop = page.find("<", at)
        return len(page) if stop < 0 else stop


def is_furniture(tag: str, names: list[str], inside: bool) -> bool:
    """Whether a class or id names the element as furniture; ``inside`` an article, a header is the article's own."""
    for name in names:
        words = [w.lower() for w in NAME.findall(name)]
        if not words or words[0] in LAYOUT_NAMES:
            continue
        noise = [w for w in words if w in NOISE_NAMES and not (inside and w == "header")]
        if len(noise) == len(words) or (noise and tag not in TEXT_TAGS and all(w in NOISE_NAMES or w in PLACE_NAMES for w in words)):
            return True
    return False


class _Node:
    __slots__ = ("tag", "label", "parent", "chain", "noise", "article", "children")

    def __init__(self, tag: str, attributes: str, parent: "_Node | None"):
        names, role, style = [], "", set()
        if attributes and "=" in attributes:
            for m in ATTRIBUTE.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                if m[1].lower() == "role":
                    role = value
                else:
                    names += value.split()
                    if m[1].lower() == "class":
                        style.update(w for w in value.split() if not DIGIT.search(w))
        self.tag, self.label, self.parent, self.children = tag, ".".join([tag, *sorted(style)]), parent, []
        up = parent.chain if parent else ()
        self.chain = (*up, xxhash.xxh64_intdigest(f"{up[-1] if up else ''}>{self.label}") >> 1) if len(up) < MAX_DEPTH else up
        up_noise, up_article = (parent.noise, parent.article) if parent else (False, False)
        marks = tag in ("article", "main") or role in ("main", "article")
        self.article = up_article or marks or any(w in ARTICLE_NAMES for w in names)
        own = tag in NOISE_TAGS or (tag == "header" and not up_article) or role in NOISE_ROLES
        if not own and names and not marks and tag not in ("html", "body"):
            own = is_furniture(tag, names, up_article)
        self.noise = up_noise or own


Block = tuple[_Node | None, str]


def blocks(page: str) -> list[Block]:
    """(node, text) of the blocks of a page with text, in order, as a tolerant reader sees them; linear in the page's length."""
    out: list[Block] = []
    stack: list[_Node] = []
    held: list[str] = []
    closings, at, n = Closings(page), 0, len(page)
    last, opened = page.rfind(">"), Counter()

    def close() -> str:
        tag = stack.pop().tag
        opened[tag] -= 1
        return tag

    def end() -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            node = stack[-1] if stack else None
            if node and (not node.children or node.children[-1] != "#"):
                node.children.append("#")
            out.append((node, text))

    def hold(raw: str) -> None:
        if raw:
            held.append(html.unescape(raw) if "&" in raw else raw)

    while at < n:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            break
        m = TAG.match(page, lt)
        if not m:
            hold(page[at:lt])
            if page.startswith("<!--", lt):
                stop = page.find("-->", lt + 4)
                at = n if stop < 0 else stop + 3
            elif page[lt + 1 : lt + 2] in ("!", "?", "/") and (stop := page.find(">", lt)) > 0:
                at = stop + 1
            else:
                held.append("<")
                at = lt + 1
            continue
        hold(page[at:lt])
        at, tag = m.end(), m[2].lower()
        if not m[1] and (tag in RAW or tag in DROPPED) and not m[3].endswith("/"):
            at = closings.end_of(tag, at)
            held.append(" " if tag in ("textarea", "select", "button") else "")
            continue
        if tag == "br" or tag == "img":
            held.append(" ")
        if tag not in BLOCKS:
            continue
        end()
        if m[1]:
            while opened[tag] and close() != tag:  # an end tag without its element is nothing
                pass
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack and stack[-1].tag == "p":
            close()
        if tag in SIBLINGS and stack and stack[-1].tag in SIBLINGS[tag]:
            close()
        if tag == "body" and stack and stack[-1].tag == "head":
            close()
        node = _Node(tag, m[3], stack[-1] if stack else None)
        if stack and (not stack[-1].children or stack[-1].children[-1] != node.label):
            stack[-1].children.append(node.label)  # the same element again and again is one step of the sequence
        stack.append(node)
        opened[tag] += 1
    hold(page[at:])
    end()
    return out


def read(page: str) -> tuple[list[str], list[tuple[int, ...]], list[tuple[int, int, tuple[int, ...]]]]:
    """The blocks with a prior above 0: their texts, their chains of style nodes from the root, and (node, presentation, chain) of all nodes in the chains."""
    found = [b for b in blocks(page) if not (b[0] and b[0].noise)]
    marked = [b for b in found if b[0] and b[0].article]
    texts, chains, looks, seen = [], [], {}, set()
    for node, text in marked or found:
        texts.append(text)
        chains.append(node.chain if node else ())
        while node and id(node) not in seen:
            seen.add(id(node))
            looks.setdefault(node.chain, set()).add(" ".join(node.children))
            node = node.parent
    return texts, chains, [(c[-1], xxhash.xxh64_intdigest("|".join(sorted(x))) >> 1, c) for c, x in looks.items()]


CHAIN = pa.list_(pa.int64())
READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("digest", pa.int64()), ("texts", pa.list_(pa.string())), ("contents", CHAIN), ("chains", pa.list_(CHAIN)),
                  ("nodes", pa.list_(pa.struct([("path", pa.int64()), ("style", pa.int64()), ("chain", CHAIN)])))])
READ_DDL = "page_id long, url string, host string, digest long, texts array<string>, contents array<long>, chains array<array<long>>, nodes array<struct<path: long, style: long, chain: array<long>>>"


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every page read once: its host, texts, and what the tree needs of them. Map only; memory is that of one slice of pages."""
    url = F.col(url_col).cast("string")
    host = F.coalesce(F.lower(F.regexp_extract(url, r"://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"), host.alias("host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                cols: list[list] = [[], [], [], [], []]
                for page in part.column(2).to_pylist():
                    texts, chains, nodes = read(page)
                    contents = [xxhash.xxh64_intdigest(t) >> 1 for t in texts]
                    digest = xxhash.xxh64_intdigest(repr(sorted(set(zip(chains, contents))))) >> 1
                    for to, x in zip(cols, (digest, texts, contents, chains, [{"path": p, "style": s, "chain": c} for p, s, c in nodes])):
                        to.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(3), *(pa.array(c, f.type) for c, f in zip(cols, list(READ)[3:]))], schema=READ)

    return rows.mapInArrow(run, READ_DDL)


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, path, pages, importance, share) of every style node of parsed pages: how many pages have it, what it is worth without the
    prior, and which share of what is important on the host its branch holds. Pages of a host with the same blocks count once, so that
    copies of an article don't make it furniture. Digests alone are exchanged, counted before they are.
    """
    distinct = pages.select("host", "digest", "contents", "chains", "nodes").dropDuplicates(["host", "digest"])
    seen = distinct.select("host", F.explode(F.array_distinct(F.arrays_zip(F.transform("chains", lambda c: F.try_element_at(c, F.lit(-1))).alias("path"), F.col("contents").alias("content")))).alias("b"))
    counts = seen.select("host", F.col("b.path").alias("path"), F.col("b.content").alias("content")).groupBy("host", "path", "content").agg(F.count("*").alias("n"))
    contents = counts.groupBy("host", "path").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.log("n")).alias("n_log"))
    looks = distinct.select("host", F.explode("nodes").alias("x")).groupBy("host", F.col("x.path").alias("path"), F.col("x.style").alias("style")).agg(F.count("*").alias("n"), F.first("x.chain").alias("chain"))
    nodes = looks.groupBy("host", "path").agg(F.sum("n").cast("double").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("n_log"), F.count("*").alias("styles"), F.first("chain").alias("chain"))
    alone = F.col("pages") <= 1
    leaf = nodes.drop("n_log").join(contents, ["host", "path"]).select("host", "chain", "n", F.when(alone, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.col("n_log") / (F.col("n") * F.log("pages")))).alias("worth"))
    branch = leaf.select("host", F.explode("chain").alias("path"), "n", (F.col("n") * F.col("worth")).alias("mass")).groupBy("host", "path").agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    whole = leaf.groupBy("host").agg(F.sum(F.col("n") * F.col("worth")).alias("whole"))
    presentation = F.when(alone, 1.0).otherwise(1 - F.col("n_log") / (F.col("pages") * F.log("pages")))
    importance = 1 - (1 - F.col("mass") / F.col("n")) * (1 - (1 - F.pow(F.lit(GAMMA), "styles")) * presentation)
    told = nodes.join(branch, ["host", "path"]).join(whole, "host")
    return told.select("host", "path", "pages", importance.alias("importance"), F.coalesce(F.try_divide("mass", "whole"), F.lit(0.0)).alias("share"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, min_importance: float = MIN_IMPORTANCE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every whole page.

    A null or empty page has an empty text; a null url, or one without a host, belongs to the host "". Nodes on fewer
    than ``min_pages`` distinct pages are never low, and a page whose blocks are all in low branches keeps them: where all pages of a host
    hold one article, it is no furniture. Repeated rows and null ids come back one by one; other columns aren't
    read. An empty table gives no rows.
    """
    shelf = Shelf(pages.sparkSession, "styletree")
    read_ = shelf.keep(parsed(pages, id_col, url_col, html_col))
    nodes = style_tree(read_).where((F.col("pages") >= min_pages) & (F.col("importance") < min_importance) & (F.col("share") < MAX_SHARE))
    low = shelf.keep(nodes.groupBy("host").agg(F.collect_list("path").alias("low")))  # as many as a template has nodes
    small = low.agg(F.coalesce(F.sum(F.size("low") + 4), F.lit(0))).first()[0] <= BROADCAST_ROWS
    joined = read_.select("page_id", "url", "host", "texts", "chains").join(F.broadcast(low) if small else low, "host", "left")
    zipped = F.arrays_zip("texts", "chains")
    left = F.when(F.col("low").isNull(), F.col("texts")).otherwise(F.filter(zipped, lambda b: ~F.arrays_overlap(b["chains"], F.col("low")))["texts"])
    text = F.array_join(F.when(F.size(left) > 0, left).otherwise(F.col("texts")), " ")
    return joined.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def main_text(page: str, low: frozenset[int] = frozenset()) -> str:
    """The text of one page, with the low style nodes of its host."""
    texts, chains, _ = read(page)
    left = [t for t, c in zip(texts, chains) if low.isdisjoint(c)]
    return " ".join(left or texts)
