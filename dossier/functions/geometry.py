"""Rectangles as structs of four doubles, and what is computed on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import half_even
from .text import FIGURE_NUMBER, col


def rect(x0: Column | str, y0: Column | str, x1: Column | str, y1: Column | str) -> Column:
    return F.struct(*(col(c).cast("double").alias(n) for c, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))))


def width(r: Column) -> Column:
    return r["x1"] - r["x0"]


def height(r: Column) -> Column:
    return r["y1"] - r["y0"]


def area(r: Column) -> Column:
    """0 if it is empty."""
    return F.greatest(width(r), F.lit(0.0)) * F.greatest(height(r), F.lit(0.0))


def expanded(r: Column, dx: Column | float, dy: Column | float | None = None) -> Column:
    dy = dx if dy is None else dy
    return rect(r["x0"] - dx, r["y0"] - dy, r["x1"] + dx, r["y1"] + dy)


def clipped(r: Column, page: Column) -> Column:
    return rect(F.greatest(r["x0"], page["x0"]), F.greatest(r["y0"], page["y0"]), F.least(r["x1"], page["x1"]), F.least(r["y1"], page["y1"]))


def intersects(a: Column, b: Column) -> Column:
    """Whether they share an area."""
    return (F.least(a["x1"], b["x1"]) > F.greatest(a["x0"], b["x0"])) & (F.least(a["y1"], b["y1"]) > F.greatest(a["y0"], b["y0"]))


def above_caption(r: Column, caption: Column, padding: float) -> Column:
    """A region whose bottom is moved up to a caption that overlaps it, under these conditions:
    they share 35 percent of the narrower width, the caption begins inside it or at most 12 below, and 10 remain."""
    shared = F.greatest(F.lit(0.0), F.least(r["x1"], caption["x1"]) - F.greatest(r["x0"], caption["x0"]))
    bottom = F.least(r["y1"], F.greatest(r["y0"] + 20, caption["y0"] - max(2.0, padding * 0.35)))
    trim = (shared >= 0.35 * F.least(width(r), width(caption))) & (caption["y0"] <= r["y1"] + 12) & (caption["y0"] > r["y0"]) & (bottom > r["y0"] + 10)
    return F.when(F.coalesce(trim, F.lit(False)), rect(r["x0"], r["y0"], r["x1"], bottom)).otherwise(r)


def is_visual_text(text: Column, lines: Column, box: Column, page: Column) -> Column:
    """Short text that can belong to a picture: no figure label in front, up to 120 characters and 4 lines, not a wide line."""
    wide = width(box) / F.greatest(F.lit(1.0), width(page)) > 0.72
    return (text != "") & ~text.rlike("^" + FIGURE_NUMBER.replace("(?i)", "(?i:") + ")") & (F.length(text) <= 120) & (lines <= 4) & ~(wide & (F.length(text) > 40))


def pixel_box(box: Column, image_width: Column, image_height: Column, scale: int = 1000, least: int = 24) -> Column:
    """Pixels of a box in thousandths: halves round to even, sides stay in the image, no side below `least` if there is room."""

    def at(c: Column, size: Column) -> Column:
        return half_even(c.cast("double") / scale * size).cast("long")

    left, top = F.greatest(F.lit(0).cast("long"), at(box["x0"], image_width)), F.greatest(F.lit(0).cast("long"), at(box["y0"], image_height))
    right, bottom = F.least(image_width, at(box["x1"], image_width)), F.least(image_height, at(box["y1"], image_height))
    right = F.when(right - left < least, F.least(image_width, left + least)).otherwise(right)
    bottom = F.when(bottom - top < least, F.least(image_height, top + least)).otherwise(bottom)
    return F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def is_box(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """A box in thousandths: all sides in 0..1000, right of left and below top."""
    return left.between(0, 1000) & top.between(0, 1000) & right.between(0, 1000) & bottom.between(0, 1000) & (right > left) & (bottom > top)
