"""Box arithmetic as column expressions; a box is struct<x1:int,y1:int,x2:int,y2:int> in pixels from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.col(c).cast("int").alias(n) if isinstance(c, str) else c.cast("int").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))))


def from_numbers(a: Column) -> Column:
    """array<double> of four to a box, halves to even; null unless there are exactly four numbers."""
    four = F.struct(*(F.rint(F.get(a, i)).cast("int").alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))))
    return F.when((F.size(a) == 4) & ~F.exists(a, lambda v: v.isNull() | F.isnan(v)), four)


def area(b: Column) -> Column:
    return (F.greatest(F.lit(0), b.x2 - b.x1) * F.greatest(F.lit(0), b.y2 - b.y1)).cast("long")


def intersection(a: Column, b: Column) -> Column:
    w, h = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return (F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)).cast("long")


def iou(a: Column, b: Column) -> Column:
    """Intersection over union, 0.0 where they do not meet."""
    both = intersection(a, b)
    return F.when(both > 0, both.cast("double") / (area(a) + area(b) - both)).otherwise(0.0)


def coverage(source: Column, target: Column) -> Column:
    """Share of the source box inside the target; 0.0 for an empty source."""
    return F.when(area(source) > 0, intersection(source, target).cast("double") / area(source)).otherwise(0.0)


def union(boxes: Column) -> Column:
    """Smallest box around an array of boxes."""
    return F.struct(
        F.array_min(F.transform(boxes, lambda b: b.x1)).alias("x1"), F.array_min(F.transform(boxes, lambda b: b.y1)).alias("y1"),
        F.array_max(F.transform(boxes, lambda b: b.x2)).alias("x2"), F.array_max(F.transform(boxes, lambda b: b.y2)).alias("y2"),
    )


def y_center(b: Column) -> Column:
    return (b.y1 + b.y2) / 2.0


def height(b: Column) -> Column:
    return F.greatest(F.lit(1), b.y2 - b.y1)


def padded(b: Column, padding: int, width: Column, height_: Column) -> Column:
    """The box grown by padding and cut to the image; null if nothing is left."""
    low = lambda v, most: F.greatest(F.lit(0), F.least(most, v))
    grown = F.struct(low(b.x1 - padding, width).alias("x1"), low(b.y1 - padding, height_).alias("y1"), low(b.x2 + padding, width).alias("x2"), low(b.y2 + padding, height_).alias("y2"))
    return F.when((grown.x2 > grown.x1) & (grown.y2 > grown.y1), grown)


def is_inside(b: Column, width: Column, height_: Column) -> Column:
    """A positive area inside the image."""
    return (b.x2 > b.x1) & (b.y2 > b.y1) & (b.x1 >= 0) & (b.y1 >= 0) & (b.x2 <= width) & (b.y2 <= height_)
