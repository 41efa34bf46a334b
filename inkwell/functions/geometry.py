"""Box arithmetic as column expressions.  A box is a struct (x1, y1, x2, y2), origin top left.

Three spaces occur: screenshot pixels, 72-dpi viewport points, and shares of the page (0 to 1).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "viewport_points_top_left_72dpi"


def box(x1: Column | str, y1: Column | str, x2: Column | str, y2: Column | str) -> Column:
    named = zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"), strict=True)
    return F.struct(*[(F.col(c) if isinstance(c, str) else c).cast("double").alias(n) for c, n in named])


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where boxes don't overlap."""
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    both = wide * high
    return F.when((wide > 0) & (high > 0), both / (area(a) + area(b) - both)).otherwise(F.lit(0.0))


def is_valid(b: Column) -> Column:
    return (b["x1"] >= 0) & (b["y1"] >= 0) & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"])


def touch(a: Column, b: Column, gap: Column | float) -> Column:
    """Boxes that overlap or lie at most ``gap`` apart, borders included."""
    gap = F.lit(gap) if not isinstance(gap, Column) else gap
    return (a["x1"] <= b["x2"] + gap) & (b["x1"] <= a["x2"] + gap) & (a["y1"] <= b["y2"] + gap) & (b["y1"] <= a["y2"] + gap)


def center_inside(inner: Column, outer: Column) -> Column:
    x, y = (inner["x1"] + inner["x2"]) / 2, (inner["y1"] + inner["y2"]) / 2
    return x.between(outer["x1"], outer["x2"]) & y.between(outer["y1"], outer["y2"])


def hull(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def clamp(b: Column, width: Column, height: Column) -> Column:
    """The box cut to an image; a degenerate one becomes null."""
    limit = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    cut = box(limit(b["x1"], width), limit(b["y1"], height), limit(b["x2"], width), limit(b["y2"], height))
    return F.when((cut["x2"] > cut["x1"]) & (cut["y2"] > cut["y1"]), cut)


def clamp_polygon(points: Column, width: Column, height: Column) -> Column:
    """Points of at least two coordinates cut to the image; null unless three are left."""
    whole = F.filter(points, lambda p: F.size(p) >= 2)
    cut = F.transform(whole, lambda p: F.array(F.least(F.greatest(p[0], F.lit(0.0)), width.cast("double")), F.least(F.greatest(p[1], F.lit(0.0)), height.cast("double"))))
    return F.when(F.size(cut) >= 3, cut)


def rescale(b: Column, from_width: Column, from_height: Column, to_width: Column, to_height: Column) -> Column:
    """A box from one space into another (pixels to points and back)."""
    across, down = to_width / from_width, to_height / from_height
    return box(b["x1"] * across, b["y1"] * down, b["x2"] * across, b["y2"] * down)


def crop_shares(b: Column, width: Column, height: Column, padding: float = 0.02) -> Column:
    """Shares of the page to cut off (top, right, bottom, left) so that the padded box stays."""
    cut = lambda v: F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
    return F.struct(cut(b["y1"] / height - padding).alias("top"), cut(1 - b["x2"] / width - padding).alias("right"), cut(1 - b["y2"] / height - padding).alias("bottom"), cut(b["x1"] / width - padding).alias("left"))


def annotation_frame(b: Column, source: Column, across: Column, down: Column) -> Column:
    """Pixel frame and line width of a line's box: repaired lines get a padded thin frame, others a thicker one."""
    pad = F.when(source == "repair_400", 2.0).otherwise(0.0)
    low = lambda v: F.greatest(v, F.lit(0.0))
    width = F.when(source == "repair_400", 1).otherwise(F.greatest(F.lit(2), F.bround(F.least(across, down) * 0.75, 0).cast("int")))
    frame = box(low(b["x1"] * across - pad * across), low(b["y1"] * down - pad * down), b["x2"] * across + pad * across, b["y2"] * down + pad * down)
    colour = F.when(source == "native", "blue").when(source == "ocr_300", "green").when(source == "repair_400", "red").otherwise("violet")
    return F.struct(frame.alias("frame"), width.alias("width"), colour.alias("colour"))
