"""Boxes on pages as rows: overlap, reading order, suppression, groups, projections.

A box is four columns x0, y0, x1, y1 (x0 < x1, y0 < y1; a box with null or crossed sides has no area and
overlaps nothing). Joins run within a page (the ``key`` columns), never across pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .registry import _cut

SIDES = ("x0", "y0", "x1", "y1")


def side(df: DataFrame, key: Sequence[str], prefix: str, *more: str) -> DataFrame:
    """Key columns as they are, sides and others with a prefix."""
    return df.select(*key, *(F.col(c).alias(f"{prefix}_{c}") for c in (*SIDES, *more)))


def area(prefix: str = "") -> Column:
    c = lambda s: F.col(f"{prefix}{s}")
    return F.greatest(c("x1") - c("x0"), F.lit(0)) * F.greatest(c("y1") - c("y0"), F.lit(0))


def shared_area(a: str, b: str) -> Column:
    """Area of the overlap of the boxes whose columns start with a and b."""
    c = lambda p, s: F.col(f"{p}{s}")
    wide = F.least(c(a, "x1"), c(b, "x1")) - F.greatest(c(a, "x0"), c(b, "x0"))
    high = F.least(c(a, "y1"), c(b, "y1")) - F.greatest(c(a, "y0"), c(b, "y0"))
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def iou(a: str, b: str) -> Column:
    """Intersection over union, 0 where both are empty."""
    both = shared_area(a, b)
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def contained(inner: DataFrame, outer: DataFrame, key: Sequence[str], share: float = 0.6) -> DataFrame:
    """``key, inner_id, outer_id``: boxes of which at least ``share`` of the area lies in another."""
    pairs = side(inner, key, "a", "id").join(side(outer, key, "b", "id"), list(key))
    keep = (area("a_") > 0) & (shared_area("a_", "b_") >= share * area("a_"))
    return pairs.where(keep).select(*key, F.col("a_id").alias("inner_id"), F.col("b_id").alias("outer_id"))


def suppressed(regions: DataFrame, key: Sequence[str], score: float = 0.25, overlap: float = 0.45) -> DataFrame:
    """Detections left by greedy suppression: the best score first, ties by id; one overlapping a kept one by more than ``overlap`` goes.

    A page's detections are gathered in one row, as a detector gives few of them for a page.
    """
    fields = ["id", *SIDES]
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), *fields)))
    pages = regions.where(F.col("score") >= score).groupBy(*key).agg(ranked.alias("all"))
    kind = pages.schema["all"].dataType.simpleString()

    def over(p: Column, q: Column) -> Column:
        wide = F.least(p["x1"], q["x1"]) - F.greatest(p["x0"], q["x0"])
        high = F.least(p["y1"], q["y1"]) - F.greatest(p["y0"], q["y0"])
        both = F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))
        size = lambda r: (r["x1"] - r["x0"]) * (r["y1"] - r["y0"])
        return both > overlap * (size(p) + size(q) - both)

    kept = F.aggregate("all", F.expr(f"cast(array() as {kind})"), lambda acc, e: F.when(F.exists(acc, lambda o: over(o, e)), acc).otherwise(F.array_append(acc, e)))
    return pages.select(*key, F.explode(kept).alias("r")).select(*key, "r.id")


def unreadable_lines(lines: DataFrame, planned: DataFrame, regions: DataFrame, key: Sequence[str], least: float = 0.8, share: float = 0.6) -> DataFrame:
    """Recognised lines to cover whole: a poor score, two characters at least, no planned entity on them, not inside a region.

    planned: key, line id of lines that an entity covers; the result is numbered along the page.
    """
    poor = lines.where((F.col("score") < least) & (F.length(F.trim("text")) >= 2))
    poor = poor.join(planned.select(*key, "id").distinct(), [*key, "id"], "left_anti")
    inside = contained(poor, regions, key, share).select(*key, F.col("inner_id").alias("id")).distinct()
    left = poor.join(inside, [*key, "id"], "left_anti")
    return left.withColumn("number", F.row_number().over(Window.partitionBy(*key).orderBy("y0", "x0", "id"))).select(*key, "id", "number")


def text_in_rect(words: DataFrame, rects: DataFrame, key: Sequence[str], band: float = 1.0) -> DataFrame:
    """``key, rect_id, place, text``: words whose middle lies in a rectangle, in reading order (bands of ``band`` height, then x)."""
    pairs = side(words, key, "w", "id", "text").join(side(rects, key, "r", "id"), list(key))
    mx, my = (F.col("w_x0") + F.col("w_x1")) / 2, (F.col("w_y0") + F.col("w_y1")) / 2
    hit = (mx >= F.col("r_x0")) & (mx < F.col("r_x1")) & (my >= F.col("r_y0")) & (my < F.col("r_y1"))
    order = Window.partitionBy(*key, "r_id").orderBy(F.floor(my / band), "w_x0", "w_id")
    return pairs.where(hit).select(*key, F.col("r_id").alias("rect_id"), F.row_number().over(order).alias("place"), F.col("w_text").alias("text"))


def sealed(words: DataFrame, areas: DataFrame, key: Sequence[str]) -> DataFrame:
    """Words that no sealed rectangle touches, all columns as they were. An area whose last key column (the page) is null holds for every page."""
    *doc, page = key
    pairs = side(words, key, "a", "id").join(side(areas.withColumnRenamed(page, "__page"), [*doc, "__page"], "b"), list(doc))
    hit = pairs.where((F.col("__page").isNull() | (F.col("__page") == F.col(page))) & (shared_area("a_", "b_") > 0))
    return words.join(hit.select(*key, F.col("a_id").alias("id")).distinct(), [*key, "id"], "left_anti")


def column_bands(headings: DataFrame, words: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, letter, id``: the lettered column of each word.

    headings: key, letter, x0, x1 of the lettered headings of a page; a column reaches halfway to its neighbours, and a word
    belongs to the column that its middle lies in.
    """
    w = Window.partitionBy(*key).orderBy("x0", "letter")
    low = (F.lag("x1").over(w) + F.col("x0")) / 2
    high = (F.lead("x0").over(w) + F.col("x1")) / 2
    bands = headings.select(*key, "letter", low.alias("low"), high.alias("high"))
    middle = (F.col("x0") + F.col("x1")) / 2
    hit = (F.col("low").isNull() | (middle >= F.col("low"))) & (F.col("high").isNull() | (middle < F.col("high")))
    return words.select(*key, "id", "x0", "x1").join(bands, list(key)).where(hit).select(*key, "letter", "id")


def match_rectangles(chars: DataFrame, matches: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, match_id, line, x0, y0, x1, y1``: one rectangle per line for each match of characters [start, end)."""
    hit = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    pairs = chars.select(*key, "pos", "line", *SIDES).join(matches.select(*key, F.col("id").alias("match_id"), "start", "end"), list(key)).where(hit)
    return pairs.groupBy(*key, "match_id", "line").agg(*(F.min(s).alias(s) for s in SIDES[:2]), *(F.max(s).alias(s) for s in SIDES[2:]))


def uncovered(rects: DataFrame, covers: DataFrame, key: Sequence[str], share: float = 0.85) -> DataFrame:
    """Rectangles of which no cover holds ``share`` of the area."""
    done = contained(rects, covers, key, share).select(*key, F.col("inner_id").alias("id")).distinct()
    return rects.join(done, [*key, "id"], "left_anti")


def sub_box(start: Column, end: Column, length: Column) -> list[Column]:
    """Sides of the box of characters [start, end) of a line of ``length`` characters, in proportion along the line's longer side."""
    x0, y0, x1, y1 = (F.col(s) for s in SIDES)
    flat = (x1 - x0) >= (y1 - y0)
    lo, hi = start / F.greatest(length, F.lit(1)), end / F.greatest(length, F.lit(1))
    return [F.when(flat, x0 + (x1 - x0) * lo).otherwise(x0).alias("x0"), F.when(flat, y0).otherwise(y0 + (y1 - y0) * lo).alias("y0"), F.when(flat, x0 + (x1 - x0) * hi).otherwise(x1).alias("x1"), F.when(flat, y1).otherwise(y0 + (y1 - y0) * hi).alias("y1")]


def project_regions(regions: DataFrame, images: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, region_id, image_id, x0, y0, x1, y1``: regions of a page in the pixels of every image they touch.

    images: key, id, sides on the page, width and height in pixels.
    """
    pairs = side(regions, key, "r", "id").join(side(images, key, "i", "id", "width", "height"), list(key)).where(shared_area("r_", "i_") > 0)
    along = lambda at, lo, hi, n: F.least(F.greatest((F.col(at) - F.col(lo)) * F.col(n) / (F.col(hi) - F.col(lo)), F.lit(0.0)), F.col(n).cast("double"))
    return pairs.select(*key, F.col("r_id").alias("region_id"), F.col("i_id").alias("image_id"), along("r_x0", "i_x0", "i_x1", "i_width").alias("x0"), along("r_y0", "i_y0", "i_y1", "i_height").alias("y0"), along("r_x1", "i_x0", "i_x1", "i_width").alias("x1"), along("r_y1", "i_y0", "i_y1", "i_height").alias("y1"))


def groups(edges: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, id, root``: connected components of edges (key, a, b); root is the smallest id. Labels spread until none changes, doubling as they go."""
    both = _cut(edges.select(*key, "a", "b").union(edges.select(*key, F.col("b"), F.col("a"))).distinct())
    now = _cut(both.groupBy(*key, F.col("a").alias("id")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        near = both.join(now.select(*key, F.col("id").alias("b"), "root"), [*key, "b"]).groupBy(*key, F.col("a").alias("id")).agg(F.min("root").alias("near"))
        met = now.join(near, [*key, "id"]).select(*key, "id", F.least("root", "near").alias("low"), F.col("root").alias("was"))
        up = now.select(*key, F.col("id").alias("low"), F.col("root").alias("up"))
        new = _cut(met.join(up, [*key, "low"], "left").select(*key, "id", F.least("low", F.coalesce("up", "low")).alias("root"), "was"))
        now = new.drop("was")
        if new.where("root <> was").isEmpty():
            return now


def tile_groups(images: DataFrame, key: Sequence[str], gap: float = 1.0, share: float = 0.9) -> DataFrame:
    """``key, root, n, x0, y0, x1, y1``: images cut into tiles, put together where two of them share nearly a whole edge; two tiles at least."""
    p = side(images, key, "a", "id").join(side(images, key, "b", "id"), list(key)).where("a_id < b_id")
    c = F.col
    along = lambda lo, hi: F.least(c(f"a_{hi}"), c(f"b_{hi}")) - F.greatest(c(f"a_{lo}"), c(f"b_{lo}"))
    size = lambda lo, hi: F.greatest(c(f"a_{hi}") - c(f"a_{lo}"), c(f"b_{hi}") - c(f"b_{lo}"))
    meet = lambda lo, hi: F.least(F.abs(c(f"a_{hi}") - c(f"b_{lo}")), F.abs(c(f"b_{hi}") - c(f"a_{lo}"))) <= gap
    touch = (meet("x0", "x1") & (along("y0", "y1") >= share * size("y0", "y1"))) | (meet("y0", "y1") & (along("x0", "x1") >= share * size("x0", "x1")))
    found = groups(p.where(touch).select(*key, c("a_id").alias("a"), c("b_id").alias("b")), key)
    return _extents(images, found, key)


def united(regions: DataFrame, key: Sequence[str]) -> DataFrame:
    """``key, root, n, x0, y0, x1, y1``: overlapping detections of several passes as one extent each; lone ones stay."""
    p = side(regions, key, "a", "id").join(side(regions, key, "b", "id"), list(key)).where((F.col("a_id") <= F.col("b_id")) & ((F.col("a_id") == F.col("b_id")) | (shared_area("a_", "b_") > 0)))
    return _extents(regions, groups(p.select(*key, F.col("a_id").alias("a"), F.col("b_id").alias("b")), key), key)


def _extents(boxes: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    return boxes.select(*key, "id", *SIDES).join(found, [*key, "id"]).groupBy(*key, "root").agg(F.count(F.lit(1)).alias("n"), *(F.min(s).alias(s) for s in SIDES[:2]), *(F.max(s).alias(s) for s in SIDES[2:]))


def nearest_signature(probes: DataFrame, known: DataFrame, key: Sequence[str], most: float = 20.0, margin: float = 2.0) -> DataFrame:
    """``key, id, match_id, distance``: for each probe the known signature at the least mean distance, if near enough and clearly nearer than the next.

    Signatures are arrays of one length; probes meet the known ones of their own key.
    """
    pairs = probes.select(*key, "id", F.col("signature").alias("p")).join(known.select(*key, F.col("id").alias("match_id"), F.col("signature").alias("q")), list(key))
    apart = F.aggregate(F.zip_with("p", "q", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, v: s + v) / F.size("p")
    w = Window.partitionBy(*key, "id").orderBy("distance", "match_id")
    ranked = pairs.where(F.size("p") == F.size("q")).select(*key, "id", "match_id", apart.alias("distance")).withColumn("next", F.lead("distance").over(w)).withColumn("place", F.row_number().over(w))
    sure = (F.col("place") == 1) & (F.col("distance") <= most) & (F.col("next").isNull() | (F.col("next") - F.col("distance") >= margin))
    return ranked.where(sure).select(*key, "id", "match_id", "distance")


def vector_page(text_chars: Column, drawings: Column, image_share: Column, least: int = 50, cover: float = 0.5) -> Column:
    """A page that is drawn, not written: no text to take, enough drawing commands, images that do not cover it."""
    return (F.coalesce(text_chars, F.lit(0)) == 0) & (F.coalesce(drawings, F.lit(0)) >= least) & (F.coalesce(image_share, F.lit(0.0)) < cover)
