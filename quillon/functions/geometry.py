"""Box expressions.  A box is a struct (x1, y1, x2, y2) in pixels; a reader's box has 0..1000 units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BOX


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.struct(x1.cast("int").alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))


def valid(b: Column) -> Column:
    return F.coalesce((b["x2"] > b["x1"]) & (b["y2"] > b["y1"]) & (b["x1"] >= 0) & (b["y1"] >= 0), F.lit(False))


def or_zero(b: Column) -> Column:
    zero = F.lit(0)
    return F.when(valid(b), b).otherwise(box(zero, zero, zero, zero))


def union_of(b: Column) -> Column:
    """Aggregate: the least box around all non-null boxes of a group."""
    return F.when(F.count(b["x1"]) > 0, box(F.min(b["x1"]), F.min(b["y1"]), F.max(b["x2"]), F.max(b["y2"])))


def union_array(boxes: Column) -> Column:
    some = F.filter(boxes, lambda b: b.isNotNull())
    side = lambda name, f: f(F.transform(some, lambda b: b[name]))
    return F.when(F.size(some) > 0, box(side("x1", F.array_min), side("y1", F.array_min), side("x2", F.array_max), side("y2", F.array_max)))


def to_pixels(ymin: Column, xmin: Column, ymax: Column, xmax: Column, width: Column, height: Column) -> Column:
    """A reader's box in pixels, clamped to the image; null without an area.  Halves round to even."""
    at = lambda v, size: F.greatest(F.lit(0), F.least(size, F.bround(v.cast("decimal(20,4)") * size / 1000, 0).cast("int")))
    x1, y1, x2, y2 = at(xmin, width), at(ymin, height), at(xmax, width), at(ymax, height)
    ok = (width > 0) & (height > 0) & (x2 > x1) & (y2 > y1)
    return F.when(ok, box(x1, y1, x2, y2))


def of_polygon(points: Column) -> Column:
    """The least box around an array of (x, y) structs."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, box(F.floor(F.array_min(xs)), F.floor(F.array_min(ys)), F.ceil(F.array_max(xs)), F.ceil(F.array_max(ys))))


def to_original(b: Column, angle: Column, width: Column, height: Column) -> Column:
    """A box on an image turned clockwise by 0, 90, 180 or 270 degrees, on the unturned width x height image."""

    def turn(x: Column) -> Column:
        x1, y1, x2, y2 = x["x1"], x["y1"], x["x2"], x["y2"]
        return (
            F.when(angle == 90, box(y1, height - x2, y2, height - x1))
            .when(angle == 180, box(width - x2, height - y2, width - x1, height - y1))
            .when(angle == 270, box(width - y2, x1, width - y1, x2))
            .otherwise(x)
        )

    return clamped(bound(b, turn), width, height)


def from_original(b: Column, angle: Column, width: Column, height: Column) -> Column:
    """The inverse of to_original()."""

    def turn(x: Column) -> Column:
        x1, y1, x2, y2 = x["x1"], x["y1"], x["x2"], x["y2"]
        return (
            F.when(angle == 90, box(height - y2, x1, height - y1, x2))
            .when(angle == 180, box(width - x2, height - y2, width - x1, height - y1))
            .when(angle == 270, box(y1, width - x2, y2, width - x1))
            .otherwise(x)
        )

    quarter = angle.isin(90, 270)
    return clamped(bound(b, turn), F.when(quarter, height).otherwise(width), F.when(quarter, width).otherwise(height))


def bound(x: Column, f) -> Column:
    """f(x) with x computed once: nested expressions would repeat it in every place."""
    return F.element_at(F.transform(F.array(x), f), 1)


def clamped(b: Column, width: Column, height: Column) -> Column:
    inside = lambda v, most: F.greatest(F.lit(0), F.least(v, most))
    cut = lambda x: box(inside(x["x1"], width), inside(x["y1"], height), inside(x["x2"], width), inside(x["y2"], height))
    return bound(bound(b, cut), lambda x: F.when(valid(x), x))


def centre(b: Column) -> tuple[Column, Column]:
    return (b["x1"] + b["x2"]) / 2.0, (b["y1"] + b["y2"]) / 2.0


def distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.hypot(ax - bx, ay - by)


def overlaps(a: Column, b: Column) -> Column:
    return (F.least(a["x2"], b["x2"]) > F.greatest(a["x1"], b["x1"])) & (F.least(a["y2"], b["y2"]) > F.greatest(a["y1"], b["y1"]))


def nearby(a: Column, b: Column, line_height: Column, diagonal: Column) -> Column:
    return F.coalesce(overlaps(a, b) | (distance(a, b) <= F.greatest(line_height * 1.8, diagonal * 0.015)), F.lit(False))


def axis_distance(a: Column, b: Column) -> Column:
    """Distance of centres, 0.45 of it where the boxes share 15 % of the smaller side on an axis."""
    shared = lambda lo, hi: F.greatest(F.lit(0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    least = lambda lo, hi: F.greatest(F.lit(1), F.least(a[hi] - a[lo], b[hi] - b[lo]))
    aligned = (shared("x1", "x2") / least("x1", "x2") >= 0.15) | (shared("y1", "y2") / least("y1", "y2") >= 0.15)
    return distance(a, b) * F.when(aligned, 0.45).otherwise(1.0)


# Floor, start and slope of each relation's score over distance / diagonal.
RELATIONS = {"same_row": (0.68, 0.96, 0.65), "same_column": (0.60, 0.88, 0.75), "same_block": (0.54, 0.78, 0.70), "nearby": (0.18, 0.62, 0.80)}


def relation(same_row: Column, same_column: Column, same_block: Column) -> Column:
    return F.when(same_row, "same_row").when(same_column, "same_column").when(same_block, "same_block").otherwise("nearby")


def relation_score(kind: Column, share: Column) -> Column:
    """share: distance over the panel's diagonal."""
    out = None
    for name, (floor, start, slope) in RELATIONS.items():
        score = F.greatest(F.lit(floor), F.lit(start) - share * slope)
        out = F.when(kind == name, score) if out is None else out.when(kind == name, score)
    return out


def span_box(b: Column, start: Column, end: Column, length: Column) -> Column:
    """The part of a line's box that a span of its text takes, with 4 pixels more on both sides."""
    width = b["x2"] - b["x1"]
    at = lambda v: F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), v / length)) * width).cast("int")
    return box(F.greatest(b["x1"], b["x1"] + at(start) - 4), b["y1"], F.least(b["x2"], b["x1"] + at(end) + 4), b["y2"])


def retry_region(anchor: Column, line_height: Column, wide: Column) -> Column:
    """Where to read again around an anchor; wide: for a price."""
    cx, cy = centre(anchor)
    w, h = F.greatest(F.lit(1), anchor["x2"] - anchor["x1"]), F.greatest(F.lit(1), anchor["y2"] - anchor["y1"])
    rx = F.when(wide, F.greatest(line_height * 18, w * 6.0, F.lit(300.0))).otherwise(F.greatest(line_height * 14, w * 3.5, F.lit(180.0))).cast("int")
    ry = F.greatest(line_height * 5.5, h * 4.0, F.lit(90.0)).cast("int")
    return box(F.greatest(F.lit(0), F.floor(cx - rx)), F.greatest(F.lit(0), F.floor(cy - ry)), F.floor(cx + rx), F.floor(cy + ry))


NO_BOX = f"cast(null as {BOX})"
