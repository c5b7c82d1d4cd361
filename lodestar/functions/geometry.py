"""Boxes (x1, y1, x2, y2) and polygons as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box:
    """Four corner columns, by prefix."""

    def __init__(self, prefix: str = "") -> None:
        self.x1, self.y1, self.x2, self.y2 = (F.col(prefix + n) for n in ("x1", "y1", "x2", "y2"))

    @property
    def width(self) -> Column:
        return self.x2 - self.x1

    @property
    def height(self) -> Column:
        return self.y2 - self.y1

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def center(self) -> tuple[Column, Column]:
        return (self.x1 + self.x2) / 2, (self.y1 + self.y2) / 2

    @property
    def diagonal(self) -> Column:
        return F.sqrt(self.width * self.width + self.height * self.height)


def overlap(a: Box, b: Box) -> Column:
    """Area of the intersection."""
    return F.greatest(F.lit(0), F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)) * F.greatest(F.lit(0), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for empty boxes."""
    both = overlap(a, b)
    union = a.area + b.area - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def center_distance(a: Box, b: Box) -> Column:
    """Distance of the centres over the longest diagonal, at least 1."""
    (ax, ay), (bx, by) = a.center, b.center
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)) / F.greatest(F.lit(1.0), a.diagonal, b.diagonal)


def padded(box: Box, width: Column, height: Column, ratio: float, least: int = 0) -> list[Column]:
    """The box grown by a share of its longer side, rounded half to even, and clamped to the image."""
    margin = F.greatest(F.lit(least).cast("double"), F.bround(F.greatest(box.width, box.height) * ratio))
    return [F.greatest(F.lit(0), box.x1 - margin), F.greatest(F.lit(0), box.y1 - margin), F.least(width, box.x2 + margin), F.least(height, box.y2 + margin)]


def to_center_format(box: Box, width: Column, height: Column) -> list[Column]:
    """Centre and size as shares of the image."""
    x, y = box.center
    return [x / width, y / height, box.width / width, box.height / height]


def polygon_area(xs: Column, ys: Column) -> Column:
    """Shoelace area; 0 for fewer than three points."""
    n = F.size(xs)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, F.pmod(i + 1, n)) - F.get(xs, F.pmod(i + 1, n)) * F.get(ys, i))
    return F.when(n < 3, F.lit(0.0)).otherwise(F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2)


def polygon_box(xs: Column, ys: Column) -> list[Column]:
    return [F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)]


def polygon_box_iou(xs: Column, ys: Column, box: Box) -> Column:
    """Intersection over union of a polygon's bounding box and a box; 0 if both are empty."""
    x1, y1, x2, y2 = polygon_box(xs, ys)
    zero = F.lit(0.0)
    both = F.greatest(zero, F.least(x2, box.x2) - F.greatest(x1, box.x1)) * F.greatest(zero, F.least(y2, box.y2) - F.greatest(y1, box.y1))
    area = lambda a, b, c, d: F.greatest(zero, c - a) * F.greatest(zero, d - b)
    return F.coalesce(F.try_divide(both, area(x1, y1, x2, y2) + area(box.x1, box.y1, box.x2, box.y2) - both), zero)


def polygon_fault(xs: Column, ys: Column, box: Box, width: Column, height: Column, least_iou: float, least_area: float, most_area: float) -> Column:
    """Why a mask polygon is no good, null if it is: too few points, coordinates that are not finite or outside the image, an area that is too small or large a share of the box's (of 1 at least), a bounding box too unlike it."""
    finite = lambda v: F.forall(v, lambda x: F.coalesce((x == x) & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    ratio = polygon_area(xs, ys) / F.greatest(F.lit(1.0), (box.x2 - box.x1) * (box.y2 - box.y1))
    outside = (F.array_min(xs) < 0) | (F.array_min(ys) < 0) | (F.array_max(xs) > width) | (F.array_max(ys) > height)
    cases = [(F.least(F.size(xs), F.size(ys)) < 3, "fewer than three points"), (~finite(xs) | ~finite(ys), "not finite"), (outside, "outside the image"), ((ratio < least_area) | (ratio > most_area), "area ratio"), (polygon_box_iou(xs, ys, box) < least_iou, "box overlap")]
    return F.coalesce(*[F.when(test, reason) for test, reason in cases])


def truncated_padding(box: Box, width: Column, height: Column, ratio: float, least: int = 0) -> list[Column]:
    """The box grown along each axis by a share of its own side, cut to whole pixels, and clamped to the image."""
    grow = lambda side: F.greatest(F.lit(least), (side * ratio).cast("int"))
    x, y = grow(box.width), grow(box.height)
    return [F.greatest(F.lit(0), box.x1 - x), F.greatest(F.lit(0), box.y1 - y), F.least(width, box.x2 + x), F.least(height, box.y2 + y)]


def from_center_format(cx: Column, cy: Column, w: Column, h: Column, width: Column, height: Column) -> list[Column]:
    """The corners of a box told by centre and size as shares of the image."""
    return [(cx - w / 2) * width, (cy - h / 2) * height, (cx + w / 2) * width, (cy + h / 2) * height]
