"""Fitting and placing layout items on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scales tried for a page, and (scale, line height) tried for a box; below, the item overflows.
PAGE_SCALES = (1.00, 0.95, 0.90, 0.85, 0.80, 0.75)
BOX_LADDER = ((1.00, 1.00), (1.00, 0.95), (0.85, 0.95), (0.75, 0.95), (0.70, 0.95))
FLOOR = 0.70
GAP_SHARE, WIDE_SHARE, NARROW_SHARE = 0.4, 0.6, 0.25
PICTURE_LEAST, PICTURE_SHARE = 30.0, 0.5
MARGIN = 22.0


def font_size(kind: Column, size: Column, body: Column) -> Column:
    """Text has the body's size; headings lie between it and twice it; the rest between four fifths of it and it."""
    heading = F.least(F.greatest(size, body), 2 * body)
    return F.when(kind == "text", body).when(kind == "heading", heading).otherwise(F.least(F.greatest(size, F.lit(0.8) * body), body))


def frame(x0: Column, x1: Column, left: Column, right: Column) -> tuple[Column, Column]:
    """Horizontal frame of an item between two margins: wide items take all, narrow ones a quarter around their centre."""
    room = right - left
    least = F.lit(NARROW_SHARE) * room
    narrow = (x1 - x0) < least
    width = F.when(narrow, least).otherwise(x1 - x0)
    start = F.when(narrow, (x0 + x1) / 2 - least / 2).otherwise(x0)
    a = F.least(F.greatest(start, left), right - width)
    wide = (x1 - x0) >= F.lit(WIDE_SHARE) * room
    return F.when(wide, left).otherwise(a), F.when(wide, right).otherwise(a + width)


def clip(box: dict[str, Column], page: dict[str, Column]) -> dict[str, Column]:
    """Part of the box on the page; all zero where they are apart."""
    a = {k: (F.greatest if k in ("x0", "y0") else F.least)(box[k], page[k]) for k in ("x0", "y0", "x1", "y1")}
    apart = (a["x1"] <= a["x0"]) | (a["y1"] <= a["y0"])
    return {k: F.when(apart, F.lit(0.0)).otherwise(v) for k, v in a.items()}


def usable(box: dict[str, Column], page: dict[str, Column]) -> Column:
    """Positive size, top left corner on the page, and something of it on the page."""
    corner = box["x0"].between(page["x0"], page["x1"]) & box["y0"].between(page["y0"], page["y1"])
    meets = (box["x0"] < page["x1"]) & (page["x0"] < box["x1"]) & (box["y0"] < page["y1"]) & (page["y0"] < box["y1"])
    return (box["x1"] > box["x0"]) & (box["y1"] > box["y0"]) & corner & meets


def box_fit(natural: Column, room: Column) -> Column:
    """struct<ratio, line_height, overflow> of the first rung of the ladder on which a text of ``natural`` height fits.

    Height goes with the square of the scale and with the line height; a measuring function can replace ``natural``.
    """
    out = F.struct(F.lit(FLOOR).alias("ratio"), F.lit(BOX_LADDER[-1][1]).alias("line_height"), F.lit(True).alias("overflow"))
    for scale, height in reversed(BOX_LADDER):
        out = F.when(natural * scale * scale * height <= room, F.struct(F.lit(scale).alias("ratio"), F.lit(height).alias("line_height"), F.lit(False).alias("overflow"))).otherwise(out)
    return out


def picture_height(height: Column, scale: Column) -> Column:
    return F.greatest(F.lit(PICTURE_LEAST), F.lit(PICTURE_SHARE) * height) * scale


def stack(anchor: str, height: str, left: str, right: str, top: float, bottom: float | str, gap: float | str) -> Column:
    """Tops of a page's items as array<double>, or null if they can't all be on it. The arguments name array columns.

    Down: every item at its anchor, or below all earlier items that share some of its width. If that runs over the
    bottom: up from the last, each item raised just so far that it and the later ones sharing its width fit.
    """
    n, g = f"size({anchor})", f"double({gap})"
    every, end = f"sequence(0, {n} - 1)", f"double({bottom})"
    shares = f"({left}[_i] < {right}[_j] AND {left}[_j] < {right}[_i])"
    down = (
        f"aggregate({every}, cast(array() AS array<double>), (_t, _i) -> array_append(_t, greatest({anchor}[_i], {float(top)}D, "
        f"coalesce(array_max(transform(filter({every}, _j -> _j < _i AND {shares}), _j -> _t[_j] + {height}[_j] + {g})), -1e18D))))"
    )
    later = f"coalesce(array_min(transform(filter({every}, _j -> _j > _i AND {shares}), _j -> _m[{n} - 1 - _j] - {g} - {height}[_i])), 1e18D)"
    up = f"reverse(aggregate(sequence({n} - 1, 0, -1), cast(array() AS array<double>), (_m, _i) -> array_append(_m, least(_y[_i], {end} - {height}[_i], {later}))))"
    ends = f"array_max(transform({every}, _i -> _y[_i] + {height}[_i]))"
    # _y and _z are bound by transforms of one element: what they stand for is evaluated once.
    packed = f"transform(array({down}), _y -> CASE WHEN {ends} <= {end} + 1e-6D THEN _y ELSE {up} END)[0]"
    return F.expr(f"CASE WHEN {n} = 0 THEN cast(array() AS array<double>) ELSE transform(array({packed}), _z -> CASE WHEN array_min(_z) >= {float(top)}D - 1e-6D THEN _z END)[0] END")


def insert_figures(items: DataFrame, figures: DataFrame) -> DataFrame:
    """Items and figures of each page in reading order: a figure stands before the first item that is lower than it."""
    w = Window.partitionBy("book_id", "page_no")
    placed = items.withColumn("is_figure", F.lit(0)).withColumn("anchor", F.col("ord").cast("double"))
    lower = figures.alias("f").join(items.select("book_id", "page_no", "ord", F.col("y0").alias("item_y")).alias("i"), ["book_id", "page_no"], "left")
    own = [c for c in figures.columns if c not in ("book_id", "page_no")]
    at = lower.groupBy("book_id", "page_no", *own).agg(F.min(F.when(F.col("item_y") > F.col("y0"), F.col("ord"))).alias("first"))
    fig = at.select("book_id", "page_no", *own, F.lit(1).alias("is_figure"), (F.coalesce(F.col("first"), F.lit(1 << 30)) - F.lit(0.5)).alias("anchor"))
    both = placed.unionByName(fig, allowMissingColumns=True)
    return both.withColumn("place", F.row_number().over(w.orderBy("anchor", F.when(F.col("is_figure") == 1, F.col("y0")), "ord"))).drop("anchor")


def page_scale(feasible: DataFrame) -> DataFrame:
    """(book_id, page_no, scale): the largest scale that a page's items fit at; null where the page needs the fallback."""
    return feasible.groupBy("book_id", "page_no").agg(F.max(F.when(F.col("fits"), F.col("scale"))).alias("scale"))


def text_height(html: Column, size: Column, width: Column) -> Column:
    """A stand-in for a measuring library: lines of letters half as wide as the size, 1.2 sizes high."""
    per_line = F.greatest(F.lit(1.0), F.floor(width / (size * 0.5)))
    return F.ceil(F.greatest(F.length(html), F.lit(1)) / per_line) * size * 1.2


def place_pages(items: DataFrame, measure=text_height, margin: float = MARGIN) -> DataFrame:
    """Items of pages with their places: scale, left, right, top, height; scale is null where no scale of the ladder fits, and
    the item then keeps its own box.

    ``items``: book_id, page_no, ord, kind (``picture`` for a picture's box), html, size, x0..y1, page_width, page_height,
    body_size. Sizes, frames, heights and the vertical order are worked out for each scale; the largest that fits counts.
    """
    scaled = items.withColumn("scale", F.explode(F.array(*map(F.lit, PAGE_SCALES))))
    left, right = F.lit(margin), F.col("page_width") - margin
    picture = F.col("kind") == "picture"
    a, b = frame(F.col("x0"), F.col("x1"), left, right)
    pa, pb = F.greatest("x0", left), F.least(F.col("x1"), right)
    thin = (pb - pa) < 1
    size = font_size(F.col("kind"), F.col("size"), F.col("body_size")) * F.col("scale")
    told = scaled.withColumn("l", F.when(~picture, a).when(thin, left).otherwise(pa)).withColumn("r", F.when(~picture, b).when(thin, right).otherwise(pb))
    told = told.withColumn("h", F.when(picture, picture_height(F.col("y1") - F.col("y0"), F.col("scale"))).otherwise(measure(F.col("html"), size, F.col("r") - F.col("l"))))
    row = F.struct("ord", F.col("y0").alias("y"), "h", "l", "r")
    page = told.groupBy("book_id", "page_no", "scale").agg(F.sort_array(F.collect_list(row)).alias("i"), F.first("page_height").alias("ph"), F.first("body_size").alias("bs"))
    arrays = page.selectExpr("book_id", "page_no", "scale", "ph", "bs", "i", "i.y AS y", "i.h AS h", "i.l AS l", "i.r AS r")
    bottom = f"(ph - {float(margin)}D)"
    fits = F.expr(f"array_max(h) <= {bottom} - {float(margin)}D")
    tops = arrays.withColumn("tops", F.when(fits, stack("y", "h", "l", "r", margin, bottom, f"{GAP_SHARE}D * bs * scale")))
    best = tops.groupBy("book_id", "page_no").agg(F.max_by(F.struct("scale", "tops", "i"), F.when(F.col("tops").isNotNull(), F.col("scale"))).alias("b"))
    flat = best.where("b IS NOT NULL").select("book_id", "page_no", "b.scale", F.explode(F.arrays_zip(F.col("b.i").alias("i"), F.col("b.tops").alias("top"))).alias("z"))
    placed = flat.select("book_id", "page_no", F.col("z.i.ord").alias("ord"), "scale", F.col("z.i.l").alias("left"), F.col("z.i.r").alias("right"), F.col("z.top").alias("top"), F.col("z.i.h").alias("height"))
    out = items.join(placed, ["book_id", "page_no", "ord"], "left")
    own = {"left": "x0", "right": "x1", "top": "y0"}
    return out.withColumns({k: F.coalesce(k, v) for k, v in own.items()}).withColumn("height", F.coalesce("height", F.col("y1") - F.col("y0")))
