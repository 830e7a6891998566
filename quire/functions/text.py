"""Text expressions as Spark columns: everything stays in the JVM's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAG = r"<[^>]+>"
OPEN_TAG = r"<\s*([a-zA-Z][a-zA-Z0-9:_-]*)"
SEGMENT = r'(?s)<seg id="(\d+)"[^>]*>(.*?)</seg>'


def strip(c: Column) -> Column:
    """Without white space (Unicode) at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_tags(c: Column) -> Column:
    return F.regexp_replace(c, TAG, "")


def plain_tail(c: Column, n: int = 600) -> Column:
    """The last n characters of the text without tags."""
    return F.right(strip_tags(c), F.lit(n))


def visible_length(c: Column) -> Column:
    return F.length(strip(strip_tags(c)))


def collapse(c: Column, limit: int = 90) -> Column:
    """White space collapsed; beyond ``limit`` characters cut, with an ellipsis as the last one."""
    t = strip(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.when(F.length(t) > limit, F.concat(F.left(t, F.lit(limit - 1)), F.lit("…"))).otherwise(t)


def escape_html(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def unescape_html(c: Column) -> Column:
    """The predefined entities and the no-break space; ``&amp;`` last, so nothing is decoded twice."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def html_to_text(c: Column) -> Column:
    return strip(unescape_html(strip_tags(c)))


def has_letters(c: Column) -> Column:
    return c.rlike(r"\p{L}")


def digit_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?U)\d+"), F.lit(0))


def opening_tags(c: Column) -> Column:
    """Bag of the names of opening tags, in lower case, sorted."""
    return F.sort_array(F.regexp_extract_all(F.lower(c), F.lit(OPEN_TAG), F.lit(1)))


def not_covered(a: Column, b: Column) -> Column:
    """True if the bag a has an element more often than the bag b."""
    count = lambda bag, d: F.size(F.filter(bag, lambda z: z == d))
    return F.exists(F.array_distinct(a), lambda d: count(a, d) > count(b, d))


def segments(c: Column) -> Column:
    """array<struct<id, body>> of the answer's segments; of an id given twice, the last body."""
    ids = F.regexp_extract_all(c, F.lit(SEGMENT), F.lit(1))
    bodies = F.regexp_extract_all(c, F.lit(SEGMENT), F.lit(2))
    back = F.reverse(bodies)
    return F.transform(F.array_distinct(ids), lambda i: F.struct(i.cast("long").alias("id"), F.element_at(back, F.array_position(F.reverse(ids), i).cast("int")).alias("body")))


def pad_text(c: Column, ratio: float = 0.25, least_words: int = 4) -> Column:
    """The text with its first words once more, about ``ratio`` of them; short texts stay as they are."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    n = F.greatest(F.lit(1), F.floor(F.size(words) * F.lit(ratio)).cast("int"))
    return F.when(F.size(words) < least_words, c).otherwise(F.concat(c, F.lit(" "), F.array_join(F.slice(words, 1, n), " ")))


def is_prose(c: Column) -> Column:
    """Mostly letters and spaces, and long or of three words of two letters or more."""
    t = strip(c)
    letters = F.length(F.regexp_replace(t, r"[^\p{L} ]", ""))
    words = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(F.regexp_replace(w, r"[^\p{L}]", "")) >= 2))
    return (F.length(t) > 0) & (letters >= 0.8 * F.length(t)) & ((F.length(t) >= 25) | (words >= 3))


def is_caption(c: Column) -> Column:
    return c.rlike(r"(?iU)^[^\w]*(Figure|Fig\.)\s+\d+")


def is_page_number(c: Column) -> Column:
    return strip(c).rlike(r"(?iU)^(\d{1,3}|[ivxlc]{1,6})$")


def is_bold(font: Column) -> Column:
    return F.coalesce(F.lower(font).contains("bold"), F.lit(False))


def is_italic(font: Column) -> Column:
    low = F.lower(font)
    return F.coalesce(low.contains("italic") | low.contains("oblique"), F.lit(False))


def is_bold_heading(html: Column, text: Column, longest: int = 80, share: float = 0.85) -> Column:
    """All in one bold element, short, and nearly all its letters capitals."""
    t = strip(text)
    letters, capitals = F.length(F.regexp_replace(t, r"\P{L}", "")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    return strip(html).rlike(r"(?s)^<b>(.*)</b>$") & (F.length(t).between(1, longest)) & (letters > 0) & (capitals >= share * letters)


def system_prompt(style: str, glossary: str) -> str:
    return f"{style}\n\n{glossary}"


def user_prompt(context: Column, segments_html: Column, note: Column | None = None) -> Column:
    """Context of the preceding blocks, the segments to work on, and on a retry what was wrong."""
    parts = [F.concat(F.lit("<context>\n"), F.coalesce(context, F.lit("")), F.lit("\n</context>")), segments_html]
    return F.concat_ws("\n\n", *parts, *([note] if note is not None else []))


def segment(block_id: Column, html: Column) -> Column:
    return F.concat(F.lit('<seg id="'), block_id.cast("string"), F.lit('">'), html, F.lit("</seg>"))
