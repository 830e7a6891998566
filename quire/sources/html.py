"""HTML documents to leaf blocks, and targets put back in their place."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements that hold a paragraph, ancestors whose text isn't one, and blocks that a copy can stand beside.
BLOCK_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote figcaption dt dd td th caption div".split())
SKIP_ANCESTORS = frozenset("pre script style nav".split())
SIBLING_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote div figcaption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BILINGUAL_CSS = ".bt-src{color:#777;font-size:0.9em;font-style:italic;}"

SLICE_BYTES = 2 << 20

#: Attributes up to the tag's end: a quoted value may hold ``>``.
INSIDE = r"(?:[^>=\"']++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b{INSIDE}>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)({INSIDE})>", re.S | re.I)
TAGS = re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style)\b{INSIDE}>.*?(?:</\1\s*>|\Z)|</?[a-zA-Z]{INSIDE}>|<[^>]*>", re.S | re.I)
OPENING = re.compile(rf"<([a-zA-Z][^\s/>]*+)({INSIDE})>")
ATTRIBUTE = re.compile(r"\s+([^\s=\"'/>]+)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")
SCHEMA = "page_id long, pos int, tag string, src_html string, text string"


@dataclass
class Leaf:
    tag: str
    start: int  # of the opening tag
    inner: int
    end: int  # of the inner part
    close: int  # behind the closing tag


def leaves(page: str) -> list[Leaf]:
    """Elements among BLOCK_TAGS that hold no other of them and have no skipped ancestor, in the order they open. A closing
    tag ends its element and all still open in it; elements never closed end with what holds them."""
    stack: list[list] = []  # tag, start, inner, has a block inside, is skipped
    out: list[Leaf] = []

    def end(item: list, at: int, close: int) -> None:
        tag, start, inner, parent_of_block, skipped = item
        if tag in BLOCK_TAGS and not parent_of_block and not skipped:
            out.append(Leaf(tag, start, inner, at, close))

    for m in TOKEN.finditer(page):
        if not m[3]:
            continue
        tag = m[3].lower()
        if m[2]:
            if any(item[0] == tag for item in stack):
                while True:
                    item = stack.pop()
                    end(item, m.start(), m.end() if item[0] == tag else m.start())
                    if item[0] == tag:
                        break
            continue
        skipped = bool(stack) and (stack[-1][4] or stack[-1][0] in SKIP_ANCESTORS)
        if tag in BLOCK_TAGS:
            for item in reversed(stack):
                if item[3]:
                    break  # those outside know already
                item[3] = True
        if tag in VOID or m[4].rstrip().endswith("/"):
            if tag in BLOCK_TAGS and not skipped:
                out.append(Leaf(tag, m.start(), m.end(), m.end(), m.end()))
            continue
        stack.append([tag, m.start(), m.end(), False, skipped])
    while stack:
        end(stack.pop(), len(page), len(page))
    return sorted(out, key=lambda x: x.start)


def text_of(inner: str, closed_only: bool = False) -> str:
    """Without tags, references decoded: by HTML's rule, by which old names need no semicolon (``&amp<``), or with
    ``closed_only`` those alone that end in one, as in XML; others stay as they are written."""
    bare = TAGS.sub("", inner)
    if not closed_only:
        return html.unescape(bare)
    return REFERENCE.sub(lambda m: html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0], bare)


def blocks_of(page: str, closed_only: bool = False) -> list[tuple[int, str, str, str]]:
    """(pos, tag, inner html, text) of leaves with a letter; pos counts all leaves."""
    found = ((i, x.tag, page[x.inner : x.end].strip()) for i, x in enumerate(leaves(page)))
    return [(i, tag, inner, t) for i, tag, inner in found if any(map(str.isalpha, t := text_of(inner, closed_only)))]


def page_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in row ranges of about SLICE_BYTES of html, so that a worker's memory doesn't follow the batch; a longer page stands alone."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("html")), 0), np.int64))
    first = 0
    while first < batch.num_rows:
        held = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, held + SLICE_BYTES, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def leaf_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", closed_only: bool = False) -> DataFrame:
    """(page_id, pos, tag, src_html, text) of every page. Map only: pages are parsed where they are read, without an exchange
    of their tokens. A null page has no blocks. ``closed_only``: see text_of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in page_slices(whole)):
            rows = [(i, *x) for i, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in blocks_of(page or "", closed_only)]
            cols = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()))], [x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, SCHEMA)


def without_anchors(inner: str) -> str:
    """Without ids and names of anchors: a copy must not repeat them."""
    gone = lambda tag, name: name == "id" or (name == "name" and tag == "a")
    return OPENING.sub(lambda t: f"<{t[1]}{ATTRIBUTE.sub(lambda m: '' if gone(t[1].lower(), m[1].lower()) else m[0], t[2])}>", inner)


def put_back(page: str, targets: dict[int, str], bilingual: bool = False, lang: str = "vi") -> str:
    """The page with the inner parts of its leaves replaced by ``targets`` (by pos); the rest stays byte for byte, but for the
    language. ``bilingual`` adds the source: a sibling where the block allows one, else a span inside."""
    out, at = [], 0
    for i, x in enumerate(leaves(page)):
        if i not in targets:
            continue
        source = without_anchors(page[x.inner : x.end].strip())
        out.append(page[at : x.inner])
        if bilingual and x.tag in SIBLING_TAGS:
            closing = page[x.end : x.close] or f"</{x.tag}>"
            out.append(f'{targets[i]}{closing}<p class="bt-src">{source}</p>')
        elif bilingual:
            out.append(f'{targets[i]}<br/><span class="bt-src">{source}</span>{page[x.end : x.close]}')
        else:
            out.append(targets[i] + page[x.end : x.close])
        at = x.close
    done = "".join(out) + page[at:]
    if m := re.search(rf"<html\b{INSIDE}>", done, re.I):
        tag = ATTRIBUTE.sub(lambda x: "" if x[1].lower() in ("lang", "xml:lang") else x[0], m[0])
        done = done[: m.start()] + tag[:-1] + f' lang="{lang}">' + done[m.end() :]
    if bilingual and targets and (m := re.search(r"</head\s*>", done, re.I)):
        done = f"{done[: m.start()]}<style>{BILINGUAL_CSS}</style>{done[m.start() :]}"
    return done


def apply_targets(pages: DataFrame, targets: DataFrame, bilingual: bool = False) -> DataFrame:
    """(page_id, html): pages with the targets (page_id, pos, dst_html) put back. Targets are grouped by page before the join,
    so a page's text is exchanged once at most; pages without any stay as they are."""
    entries = targets.where("dst_html IS NOT NULL").groupBy("page_id").agg(F.collect_list(F.struct("pos", "dst_html")).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in page_slices(whole)):
            done = [put_back(p or "", {x["pos"]: x["dst_html"] for x in t or ()}, bilingual) for p, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(done, pa.string())], ["page_id", "html"])

    return pages.select("page_id", "html").join(entries, "page_id", "left").mapInArrow(run, "page_id long, html string")
